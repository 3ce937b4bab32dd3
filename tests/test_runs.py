"""Ranks, draws, runs by configuration, the command line, and sources that no query covers."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmix import cli
from maskmix.config import Loader, RunConfig, Splits, iterate
from maskmix.functions import arrays as A
from maskmix.operators import balance, rank, split
from maskmix.operators import transforms as X
from maskmix.operators.unify import with_index
from maskmix.plans import strategies as S
from maskmix.schema import DatasetSchema, TensorSpec, UnifiedSchema
from maskmix.sources import hdf5, npy
from maskmix.sources.factory import from_tensors, materialise
from maskmix.streaming import unified_stream

SCHEMA = {"features": [{"name": "x", "time_dim": 12}], "targets": [{"name": "y", "dtype": "int64", "placeholder": -1}]}


# Ranks


def test_rank_by_columns_is_dense_in_pieces(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") != 5, F.concat(F.lit("k"), F.col("id"))).alias("b"), F.col("id").alias("wide"))
    want = sorted(((r.a, r.b is not None, r.b or "", r.wide) for r in rows.collect()))
    got = rank.rank_by_columns(rows, ["a", "b"], small=10).orderBy("rank").collect()
    assert [(r.a, r.b is not None, r.b or "", r.wide) for r in got] == want and [r["rank"] for r in got] == list(range(3000))
    assert rank.rank_by_columns(rows.limit(0), ["a", "b"], small=-1).count() == 0
    skewed = spark.range(500).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    assert sorted(r["rank"] for r in rank.rank_by_columns(skewed, ["a", "b"], small=10).collect()) == list(range(500))


def test_large_index_has_no_task_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(rank, "SMALL", 10)
    rows = with_index(spark.range(1000).withColumn("text", F.lit("wide")), ["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.local_ix) for r in rows.collect()) == [(i, i) for i in range(1000)]
    # The one exchange to a single partition is that of the buckets' counts.
    assert plan.count("SinglePartition") <= 1 and "_c" in plan.split("SinglePartition")[1].split("\n")[1]


def test_rank_by_digest_in_groups(spark):
    rows = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = rank.rank_by_digest(rows, A.digest(1, F.col("id")), ["id"], ["g"], total="n").collect()
    for g in (None, 1, 2):
        mine = [r for r in got if r.g == g]
        assert sorted(r["rank"] for r in mine) == list(range(300)) and {r.n for r in mine} == {300}


def test_apportion():
    assert S.apportion([1, 1, 2], 10) == [3, 2, 5] and S.apportion([0.1, 0.2, 0.7], 10) == [1, 2, 7]
    assert S.apportion([1, 0, 1], 3) == [2, 0, 1] and S.apportion([5], 0) == [0]
    for w in ([3, 3, 3, 1], [2.5, 0.1, 9], [1e-9, 1]):
        for n in (1, 7, 100, 12345):
            got = S.apportion(w, n)
            assert sum(got) == n and all(abs(g - x / sum(w) * n) < 1 for g, x in zip(got, w, strict=True))
    with pytest.raises(ValueError):
        S.apportion([0, 0], 3)


def test_weighted_draws_fall_by_cumulative_weight(spark):
    weights = np.array([0.0, 1.0, 3.0, 0.0, 2.0, 4.0] * 300)
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "local_ix long, weight double")
    got = S.IndexPool(spark, 0, 3, S.SubsampleConfig(replacement=True), table).draw(4000, 0).orderBy("draw").collect()
    points = [r.u * weights.sum() for r in spark.range(4000).select("id", A.uniform(3, 0, "replace", F.col("id")).alias("u")).orderBy("id").collect()]
    assert [r.local_ix for r in got] == np.searchsorted(np.cumsum(weights), points, side="right").tolist()
    once = S.IndexPool(spark, 0, 3, None, table).draw(500, 0).collect()
    assert len({r.local_ix for r in once}) == 500 and all(weights[r.local_ix] > 0 for r in once) and sorted(r.draw for r in once) == list(range(500))


def test_fill_gaps_of_long_values(spark):
    n = 20_000
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("v"))
    got = row.select(A.fill_gaps(F.col("v"), F.transform("v", lambda x: x % 1000 == 7)).alias("f")).first().f
    assert got == [float(max(7, (i - 7) // 1000 * 1000 + 7)) for i in range(n)]


# Runs


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Two datasets of parquet files with values of different lengths, and a run over them."""
    at = tmp_path_factory.mktemp("run")
    entries = []
    for k, n in enumerate((40, 25)):
        rows = [(i, [float(i)] * (1 + (7 * i + k) % 12), i % 3) for i in range(n)]
        spark.createDataFrame(rows, "local_ix long, x array<float>, y long").write.parquet(f"{at}/{k}")
        entries.append({"adapter": "parquet", "args": {"path": f"{at}/{k}"}, "schema": SCHEMA})
    return at, {"batch_size": 8, "datasets": entries, "strategy": {"name": "proportional"}, "pad_features": False}


def test_bucketing_by_configuration(spark, run):
    bucketing = {"key": "x", "batch_size": 5, "bucket_multiplier": 20, "drop_last": True, "shuffle": True}
    got = RunConfig.from_dict({**run[1], "bucketing": bucketing}).build_batches(spark).collect()
    assert {len([r for r in got if r.batch_id == b]) for b in {r.batch_id for r in got}} == {5} and len(got) == 65
    for b in {r.batch_id for r in got}:
        lengths = [len(r.x) for r in got if r.batch_id == b]
        assert max(lengths) - min(lengths) <= 2
    # Evaluation is bucketed too: in order, nothing dropped unless it is asked for.
    config = RunConfig.from_dict({**run[1], "bucketing": {"key": "x"}, "drop_last_batch": True})
    got = config.build_batches(spark, training=False).collect()
    assert sorted(r.gix for r in got) == list(range(65)) and {r.batch_id for r in got} == set(range(9))
    spread = [max(v) - min(v) for v in ([len(r.x) for r in got if r.batch_id == b] for b in range(9))]
    assert max(spread) <= 2


def test_evaluation_order_and_last_batch(spark, run):
    got = RunConfig.from_dict({**run[1], "drop_last_batch": True}).build_batches(spark, training=False).collect()
    assert sorted((r.batch_id, r.slot, r.gix) for r in got) == [(i // 8, i % 8, i) for i in range(65)]
    assert RunConfig.from_dict({**run[1], "drop_last_batch": True}).build_batches(spark).count() == 64


def test_collated_batches(spark, run):
    config = RunConfig.from_dict({**run[1], "collate": {"name": "dynamic"}})
    for r in config.build_collated(spark, training=False).orderBy("batch_id").collect():
        assert r.batch_size == len(r.x) == len(r.gix) and len({len(x) for x in r.x}) == 1 and r.gix == sorted(r.gix)
        assert [sum(m) for m in r.x_mask] == [1 + (7 * i + k) % 12 for g in r.gix for k, i in [(int(g >= 40), g - 40 * (g >= 40))]]
    mixed = RunConfig.from_dict({**run[1], "collate": {"name": "mixup", "base": "dynamic", "alpha": 1.0}}).build_batches(spark).collect()
    assert len(mixed) == 65 and all(0 <= r.mixup_lambda <= 1 for r in mixed)
    with pytest.raises(ValueError):
        RunConfig.from_dict({**run[1], "collate": {"name": "none"}}).build_batches(spark)


def test_splits_and_iteration(spark, run):
    config = RunConfig.from_dict(run[1])
    splits = Splits(config, config.build_loader(spark), config.build_loader(spark))
    assert splits.batches("test") is None
    first = [r.gix for r in splits.batches("train").orderBy("pos").collect()]
    splits.set_epoch(1)
    assert sorted(first) == sorted(r.gix for r in splits.batches("train").collect()) and first != [r.gix for r in splits.batches("train").orderBy("pos").collect()]
    assert [g for b in iterate(splits.batches("valid"), ["gix"]) for g in b.gix] == list(range(65))


def test_one_sample_by_index(spark, run):
    loader = RunConfig.from_dict(run[1]).build_loader(spark)
    assert loader.sample(41)["x"] == [1.0] * 9 and loader.sample(-1)["y"] == 0 and loader.sample(0)["dataset"] == "dataset_0"
    with pytest.raises(IndexError):
        loader.sample(65)
    assert {r.gix: r.length for r in loader.lengths("x").collect()}[41] == 9


def test_command_line(spark, run, capsys):
    at, data = run
    path = str(at / "run.json")
    with open(path, "w") as f:
        json.dump({**data, "pad_features": True}, f)
    assert cli.main(["describe", path]) == 0 and "65 samples" in capsys.readouterr().out
    assert cli.main(["validate", path]) == 0 and "no issues" in capsys.readouterr().out
    assert cli.main(["compute-stats", path, "-o", f"{at}/stats.json", "--keys", "x"]) == 0
    values = np.concatenate([[float(i)] * (1 + (7 * i + k) % 12) for k, n in enumerate((40, 25)) for i in range(n)])
    assert json.load(open(f"{at}/stats.json"))["x"]["mean"] == [pytest.approx(values.mean())]
    assert cli.main(["compute-stats", path, "-o", f"{at}/by.json", "--per-dataset"]) == 0 and set(json.load(open(f"{at}/by.json"))) == {"dataset_0", "dataset_1"}
    assert cli.main(["class-weights-for-loss", path, "--target", "y", "-o", f"{at}/w.json"]) == 0
    found = json.load(open(f"{at}/w.json"))
    assert found["counts"] == [23, 21, 21] and np.mean(found["weights"]) == pytest.approx(1)
    with open(path, "w") as f:
        json.dump({}, f)
    with pytest.raises(SystemExit):
        cli.main(["describe", path])


def test_saved_splits_and_weights(spark, tmp_path):
    rows = split.split(spark.range(100), "id", seed=4)
    info = split.save_split_info(rows, "id", f"{tmp_path}/s.json", seed=4)
    assert info["counts"] == {"train": 80, "valid": 10, "test": 10} and split.load_split_info(f"{tmp_path}/s.json") == info["splits"]
    assert sorted(i for v in info["splits"].values() for i in v) == list(range(100))
    weights = spark.createDataFrame([(1, 3, 0.5), (0, 1, 1.5)], "cls long, n long, weight double")
    assert balance.save_weights(weights, f"{tmp_path}/w.json", "y", "inverse")["weights"] == [1.5, 0.5]
    assert materialise(rows, f"{tmp_path}/m", "split").where("split = 'test'").count() == 10


def test_structured_values_are_rejected(spark):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("img", shape=(2, 2), time_dim=3),))])
    for kind in (X.TimeWarp, X.FeatureMasking):
        with pytest.raises(ValueError):
            kind(keys=["img"], schema=schema)(Loader(spark, [from_tensors(spark, {"img": [[[1.0] * 4] * 3]})], [schema.schemas[0] if hasattr(schema, "schemas") else DatasetSchema((TensorSpec("img", shape=(2, 2), time_dim=3),))], [["local_ix"]]).unified(), True, 0, 0)


# Sources


def test_stream_is_unified(spark, tmp_path):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("x", time_dim=3),), (TensorSpec("y", dtype="int64", placeholder=-1),))])
    rows = spark.createDataFrame([(0, [1.0], None), (1, [1.0, 2.0, 3.0, 4.0], 5)], "gix long, x array<float>, y long")
    rows.write.parquet(f"{tmp_path}/in")
    made = unified_stream(spark, f"{tmp_path}/in", rows, schema)
    query = made.writeStream.format("memory").queryName("unified_rows").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    query.awaitTermination(60)
    got = {r.gix: r for r in spark.table("unified_rows").collect()}
    assert got[0].x == [1, 0, 0] and got[0].x_mask == [True, False, False] and got[0].y == -1 and got[1].x == [1, 2, 3] and got[1].y == 5


def test_npy_over_any_path(spark, tmp_path):
    for i in range(3):
        d = tmp_path / f"sample_{i}"
        d.mkdir()
        np.save(d / "v.npy", np.full((2, 2), i, np.float32))
        if i:
            np.save(d / "y.npy", np.int64(i))
    kinds = {"v": T.ArrayType(T.ArrayType(T.FloatType())), "y": T.LongType()}
    got = {r.key: r for r in npy.read_binary(spark, str(tmp_path), kinds).collect()}
    assert got["sample_0"].y is None and got["sample_2"].y == 2 and got["sample_1"].v == [[1.0, 1.0], [1.0, 1.0]]


FAKE = '''
"""The calls of h5py that the source makes, over a numpy archive."""
import numpy as np

class Dataset:
    def __init__(self, a):
        self.a, self.dtype, self.ndim = a, a.dtype, a.ndim
    def __getitem__(self, _):
        return self.a[()].item() if self.a.dtype.kind == "S" and not self.a.ndim else self.a[()]

class File(dict):
    def __init__(self, path, mode):
        for k, a in np.load(path, allow_pickle=False).items():
            at, parts = self, k.split("|")
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = Dataset(a)
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
'''


def test_hdf5_by_a_stand_in(spark, tmp_path, monkeypatch):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "h5py.py").write_text(FAKE)
    monkeypatch.syspath_prepend(str(tmp_path / "lib"))
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
    spark.sparkContext.addPyFile(str(tmp_path / "lib" / "h5py.py"))
    held = {}
    for i in range(5):
        held |= {f"train|sample_{i:03d}|video": np.full((2, 3), i, np.float32), f"train|sample_{i:03d}|emotion": np.int64(i % 3), f"train|sample_{i:03d}|name": np.bytes_(f"clip_{i}"), f"train|sample_{i:03d}|flag": np.bool_(i % 2)}
    del held["train|sample_003|emotion"]
    with open(tmp_path / "data.h5", "wb") as f:
        np.savez(f, **held)
    got = hdf5.read_hdf5(spark, str(tmp_path / "data.h5"), "train").orderBy("local_ix").collect()
    assert [r.emotion for r in got] == [0, 1, 2, None, 1] and got[4].video == [[4.0] * 3] * 2 and got[1].name == "clip_1" and got[1].flag is True
    assert hdf5.read_hdf5(spark, str(tmp_path / "data.h5"), "train", ["video"]).columns == ["video", "local_ix"]
    with pytest.raises(Exception, match="none"):
        hdf5.read_hdf5(spark, str(tmp_path / "data.h5"), "none").count()
