"""Operators on samples, against hand-computed values."""

import bisect
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.config import RunConfig, template_path
from maskmix.functions import arrays as A
from maskmix.operators import balance, batch, rank, report, stats
from maskmix.operators import transforms as X
from maskmix.operators.split import split
from maskmix.operators.unify import concatenate, locate, unify
from maskmix.plans import catalog
from maskmix.plans import strategies as S
from maskmix.schema import DatasetSchema, TensorSpec, UnifiedSchema, resolve_dtype
from maskmix.sources.factory import build_dataset, from_tensors, schema_from_dict
from maskmix.sources.npy import read_npy
from maskmix.sources.tables import read

A_ = DatasetSchema((TensorSpec("video", feature_dim=2, time_dim=3),), (TensorSpec("valence", time_dim=3, placeholder=-5.0),))
B_ = DatasetSchema((TensorSpec("audio", feature_dim=2, time_dim=3),), (TensorSpec("sentiment", placeholder=-5.0),))


def test_schema_rules():
    u = UnifiedSchema([A_, B_])
    assert u.keys == ["video", "audio", "valence", "sentiment"] and len(u) == 4
    assert u.spec("video").value_shape == (3, 2) and u.spec("video").mask_shape == (3,)
    with pytest.raises(KeyError):
        u.spec("none")
    with pytest.raises(ValueError):
        TensorSpec("x", feature_dim=2, shape=(2,))
    with pytest.raises(ValueError):
        TensorSpec("x", time_dim=0)
    with pytest.raises(ValueError):
        resolve_dtype("complex")
    with pytest.raises(ValueError):
        UnifiedSchema([A_, DatasetSchema((TensorSpec("video", feature_dim=3, time_dim=3),))])
    # A vector and a structured value of one shape agree; the first placeholder stays.
    assert len(UnifiedSchema([DatasetSchema((TensorSpec("x", feature_dim=4),)), DatasetSchema((TensorSpec("x", shape=(4,), placeholder=9),))])) == 1


def test_unify_pads_crops_and_masks(spark):
    a = from_tensors(spark, {"video": [[[1.0, 2.0]], [[1.0, 1.0]] * 5], "valence": [[1.0], [2.0] * 5], "valence_mask": [[True], [True, False, True, True, True]]})
    b = from_tensors(spark, {"audio": [[[3.0, 3.0]] * 3], "sentiment": [0.5]})
    u = UnifiedSchema([A_, B_])
    rows = concatenate([a, b], u, [["local_ix"]] * 2).orderBy("gix").collect()
    assert [r.gix for r in rows] == [0, 1, 2] and [r.dataset for r in rows] == ["dataset_0", "dataset_0", "dataset_1"]
    assert rows[0].video == [[1, 2], [0, 0], [0, 0]] and rows[0].video_mask == [True, False, False]
    assert rows[0].valence == [1, -5, -5] and len(rows[1].video) == 3
    assert rows[1].valence_mask == [True, False, True]
    assert rows[2].valence == [-5] * 3 and rows[2].valence_mask == [False] * 3 and rows[2].sentiment_mask is True
    assert rows[0].sentiment == -5 and rows[0].sentiment_mask is False
    native = unify(a, u, pad_features=False).orderBy("local_ix").collect()
    assert len(native[1].video) == 5 and len(native[0].audio) == 3


def test_padding_helpers(spark):
    row = spark.createDataFrame([([0.0, 4.0, 0.0, 0.0, 5.0, 0.0], [1.0, 2.0])], "v array<double>, s array<double>")
    valid = A.nonzero_steps(F.col("v"), None)
    got = row.select(A.fill_gaps(F.col("v"), valid).alias("f"), A.repeat_pad(F.col("s"), 4).alias("r"), A.repeat_pad(F.col("v"), 2).alias("k")).first()
    assert got.f == [4, 4, 4, 4, 5, 5] and got.r == [1, 2, 2, 2] and len(got.k) == 6
    with pytest.raises(Exception, match="no valid step"):
        row.select(A.fill_gaps(F.col("s"), F.transform("s", lambda _: F.lit(False)))).collect()
    with pytest.raises(Exception, match="empty sequence"):
        row.select(A.repeat_pad(F.array().cast("array<double>"), 2)).collect()


def test_locate():
    assert [locate(i, [40, 200]) for i in (0, 39, 40, -1)] == [(0, 0), (0, 39), (1, 0), (1, 199)]
    with pytest.raises(IndexError):
        locate(240, [40, 200])


def test_strategies_counts():
    assert S.apportion([1, 1, 2], 10) in ([3, 2, 5], [2, 3, 5]) and sum(S.apportion([1, 1, 1], 10)) == 10
    assert S.FixedWeightStrategy([100, 400], [1, 3], 100).counts(0) == [25, 75]
    assert S.TemperatureStrategy([100, 400], 2).counts(0) == [167, 333]
    annealed = S.AnnealedTemperatureStrategy([1, 1], 5, 1, 5)
    assert [annealed.temperature_at(e) for e in (0, 2, 4, 99)] == [5, 3, 1, 1]
    with pytest.raises(ValueError):
        S.TemperatureStrategy([1], 0.5)
    with pytest.raises(ValueError):
        S.FixedWeightStrategy([1, 1], [1])


def test_plans_cover_and_repeat(spark):
    plan = S.ProportionalStrategy([30, 70], seed=1).plan(spark, 0)
    rows = plan.orderBy("pos").collect()
    assert sorted(r.gix for r in rows) == list(range(100)) and [r.pos for r in rows] == list(range(100))
    assert rows == S.ProportionalStrategy([30, 70], seed=1).plan(spark, 0).orderBy("pos").collect()
    assert [r.gix for r in rows] != [r.gix for r in S.ProportionalStrategy([30, 70], seed=1).plan(spark, 1).orderBy("pos").collect()]
    shards = [{(r.pos, r.gix) for r in S.shard(plan, 100, 3, k).collect()} for k in range(3)]
    assert [len(s) for s in shards] == [34] * 3
    assert [S.shard(plan, 100, 3, k, True).count() for k in range(3)] == [33] * 3
    few = S.ProportionalStrategy([2]).plan(spark)
    assert [S.shard(few, 2, 5, k).count() for k in range(5)] == [1] * 5
    turns = [r.dataset_ix for r in S.RoundRobinStrategy([3, 5]).plan(spark).orderBy("pos").collect()]
    assert turns == [0, 1] * 3


def test_exhaust_goes_through_everything(spark):
    config = S.SubsampleConfig(policy=S.ExhaustionPolicy.EXHAUST, effective_size=3)
    seen = [r.gix for e in range(7) for r in S.ProportionalStrategy([7], 2, config).plan(spark, e).collect()]
    assert sorted(seen) == sorted(list(range(7)) * 3)


def test_bucketing_spread(spark):
    plan = spark.range(40).select(F.col("id").alias("pos"), (F.col("id") % 20 + 1).alias("length"))
    batches = S.bucket_batches(plan, 4).groupBy("batch_id").agg((F.max("length") - F.min("length")).alias("d"), F.count("*").alias("n")).collect()
    assert len(batches) == 10 and max(r.d for r in batches) <= 3 and all(r.n == 4 for r in batches)


def test_splits(spark):
    rows = spark.range(100).withColumn("y", (F.col("id") >= 80).cast("int"))
    assert {r.split: r["count"] for r in split(rows, "id").groupBy("split").count().collect()} == {"train": 80, "valid": 10, "test": 10}
    half = split(rows, "id", (0.5, 0.5), stratify="y", names=("a", "b")).groupBy("split", "y").count().collect()
    assert {(r.split, r.y): r["count"] for r in half} == {("a", 0): 40, ("a", 1): 10, ("b", 0): 40, ("b", 1): 10}


def _classes(spark):
    schema = UnifiedSchema([DatasetSchema((), (TensorSpec("y", dtype="int64", placeholder=-1),))])
    return unify(from_tensors(spark, {"y": [0, 0, 0, 1]}), schema), schema


def test_balance(spark):
    rows, schema = _classes(spark)
    weights = [r.weight for r in balance.sampler_weights(rows, schema, "y", "local_ix").orderBy("local_ix").collect()]
    assert weights == pytest.approx([1 / 3] * 3 + [1])
    w = [r.weight for r in balance.loss_weights(balance.class_histogram(rows, schema, "y")).orderBy("cls").collect()]
    assert sum(w) / 2 == pytest.approx(1) and w[1] / w[0] == pytest.approx(3)
    with pytest.raises(Exception, match="out of range"):
        balance.class_histogram(rows, schema, "y", 1).collect()
    steps = UnifiedSchema([DatasetSchema((), (TensorSpec("y", time_dim=3, dtype="int64"),))])
    s = unify(from_tensors(spark, {"y": [[2, 2, 5]], "y_mask": [[True, True, False]]}), steps)
    assert [r.n for r in balance.class_histogram(s, steps, "y", 6).orderBy("cls").collect()] == [0, 0, 2, 0, 0, 0]
    assert balance.sample_classes(s, steps, "y").first().cls == 2


def test_stats_and_normalizers(spark, tmp_path):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("x", feature_dim=2, time_dim=2),))])
    a = from_tensors(spark, {"x": [[[1.0, 10.0], [3.0, 30.0]], [[5.0, 50.0], [7.0, 70.0]]]}, {"dataset": ["A", "A"]})
    b = from_tensors(spark, {"x": [[[0.0, 0.0], [2.0, 2.0]]]}, {"dataset": ["B"]})
    rows = concatenate([a, b], schema, [["local_ix"]] * 2)
    by = stats.collect_stats(stats.dataset_stats(rows, schema))
    assert by["A"]["x"]["mean"] == [4, 40] and by["B"]["x"]["mean"] == [1, 1]
    stats.save_stats(by, str(tmp_path / "s.json"))
    assert stats.load_stats(str(tmp_path / "s.json")) == by
    one = UnifiedSchema([DatasetSchema((TensorSpec("v", feature_dim=1),))])
    v = concatenate([from_tensors(spark, {"v": [[2.0], [4.0]]})], one, [["local_ix"]])
    assert [r.v[0] for r in X.Normalize({"v": (2, 2)}, one)(v).orderBy("gix").collect()] == pytest.approx([0, 1], abs=1e-5)
    assert math.isnan(X.InstanceNormalize(["v"], schema=one)(v).first().v[0])
    per = X.PerDatasetNormalize(by, schema, "identity")(rows).where("dataset_ix = 1").first()
    assert np.allclose(per.x, [[-0.7071, -0.7071], [0.7071, 0.7071]], atol=1e-3)
    with pytest.raises(ValueError):
        X.PerDatasetNormalize({}, schema, "union")


def test_exact_quartiles_are_narrowed_down(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    draws = np.random.default_rng(5)
    groups = {
        "one": [3.5], "two": [2.0, 7.0], "constant": [50000.1] * 9, "none": [None, None], "some": [None, 1.0, 4.0, None, 9.0, 11.0],
        "signs": [-3.0, -0.0, 0.0, 0.0, 2.0, -1e-300, 5e-324], "wide": [*(10.0 ** draws.uniform(-300, 300, 400)), *(-(10.0 ** draws.uniform(-9, 9, 300)))],
        "narrow": list(1e9 + draws.integers(0, 50000, 700) / 1e3), "outlier": [*draws.normal(size=500), 1e200], "hot": [*[7.0] * 500, *draws.normal(size=100)],
        "nans": [nan, 1.0, 2.0, nan, nan], "ends": [-inf, -2.0, 0.0, 2.0, inf],
    }
    rows = spark.createDataFrame([(i % 2, k, 0, float(x) if x is not None else None) for k, xs in groups.items() for i, x in enumerate(xs)], "d int, key string, channel int, x double")
    quartile = F.percentile("x", F.array(*map(F.lit, stats.QUARTILES)))
    said = rows.groupBy("key").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), quartile.alias("q"))
    want = {r.key: r for r in said.collect()}
    same = lambda a, b, rel=1e-12: (a is None and b is None) or (a is not None and b is not None and (a == b or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=rel)))
    for factor, cell in ((stats.PER_FACTOR, stats.PER_CELL), (0, 1), (1, 3)):
        monkeypatch.setattr(stats, "PER_FACTOR", factor)
        monkeypatch.setattr(stats, "PER_CELL", cell)
        for union, by in ((False, ["key", "channel"]), (True, ["d", "key", "channel"])):
            made = stats._measured(rows, by, 1e-6, "eps", None, union)
            got = {r.key: r for r in made.collect() if not union or r.d is None}
            assert set(got) == set(groups)
            for k, r in got.items():
                w = want[k]
                assert r.n == w.n and all(same(r[f], w[f]) for f in ("min", "max")) and (k == "wide" or same(r.mean, w["mean"])), k
                assert same(r["median"], None if w.q is None else w.q[1]) and same(r.iqr, 1e-6 if w.q is None else w.q[2] - w.q[0] if math.isnan(w.q[2] - w.q[0]) else max(w.q[2] - w.q[0], 1e-6)), k
                assert k == "wide" or same(r.std, max(w.std, 1e-6) if w.std is not None and not math.isnan(w.std) else (w.std or 1e-6), 1e-9), k
    schema = UnifiedSchema([DatasetSchema((TensorSpec("v", feature_dim=1),))])
    v = concatenate([from_tensors(spark, {"v": [[2.0], [4.0], [5.0], [9.0]]})], schema, [["local_ix"]])
    for df in (stats.full_stats(v, schema), stats.dataset_stats(v, schema, union=True)):
        # No aggregate holds the values of a whole group.
        assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert {(r.n, r["median"], r.iqr) for r in df.collect()} == {(4, 4.5, 2.5)}


def test_instance_moments_are_bound_as_they_divide(spark):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("x", feature_dim=2, time_dim=3, dtype="float64"),))])
    raw = from_tensors(spark, {"x": [[[1.0, 5.0], [3.0, 5.0]], [[2.0, 7.0]], [[float("nan"), 1.0], [0.0, 3.0]]]})
    rows = concatenate([raw], schema, [["local_ix"]])
    got = {single: X.InstanceNormalize(["x"], schema=schema, single=single)(rows) for single in ("nan", "eps")}
    # No element tests its deviation again.
    assert all("isnan" not in df._jdf.queryExecution().analyzed().toString().lower() for df in got.values())
    nan, eps = ([r.x for r in got[s].orderBy("gix").collect()] for s in ("nan", "eps"))
    root = math.sqrt(0.5)
    assert np.allclose(nan[0], [[-root, 0], [root, 0], [0, 0]]) and np.allclose(eps[0], nan[0])
    assert np.isnan(nan[1][0]).all() and eps[1] == [[0, 0]] * 3 and nan[1][1:] == [[0, 0]] * 2
    assert math.isnan(nan[2][0][0]) and math.isnan(nan[2][1][0]) and np.allclose([nan[2][0][1], nan[2][1][1]], [-root, root])


def test_order_columns_of_a_sequence_travel_once(spark):
    lines = read(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey", "lines")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(" in plan and "AS _lines" not in plan
    got = {r.o_orderkey: r.lines for r in lines.collect()}
    names = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    want: dict = {}
    for r in sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", *names).collect()):
        want.setdefault(r[0], []).append([float(v) for v in (r[6], r[5], r[7], r[8])])
    assert all(v == want.get(k) for k, v in got.items()) and set(want) <= set(got)


def test_random_transforms(spark):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("f", feature_dim=3, time_dim=10),), (TensorSpec("t", time_dim=10, placeholder=-1),))])
    raw = from_tensors(spark, {"f": [[[3.0 * t + 1, 3.0 * t + 2, 3.0 * t + 3] for t in range(8)]] * 20, "t": [[float(t) for t in range(8)]] * 20})
    rows = concatenate([raw], schema, [["local_ix"]])
    crop = X.RandomCrop(4, schema=schema)(rows, seed=3).collect()
    assert all(r.t == [r.t[0] + i for i in range(4)] and r.f[0][0] == 3 * r.t[0] + 1 for r in crop) and len({r.t[0] for r in crop}) > 1
    assert X.CenterCrop(4, schema=schema)(rows).first().t == [2, 3, 4, 5]
    noisy = X.GaussianNoise(["f"], std=1.0, p=1.0, schema=schema)(rows).first()
    assert noisy.f[0][0] != 1 and noisy.f[9] == [0, 0, 0]
    assert X.GaussianNoise(["f"], schema=schema)(rows, training=False).first().f == rows.first().f
    gone = X.FeatureDropout(["f"], p=1.0, keep_at_least_one=False, schema=schema)(rows).first()
    assert gone.f == [[0] * 3] * 10 and not any(gone.f_mask)
    assert X.FeatureDropout(["f"], p=1.0, schema=schema)(rows).first().f == rows.first().f
    span = X.SpanMasking(["f"], span_len=2, p=1.0, schema=schema)(rows).collect()
    assert all(1 <= sum(s == [0, 0, 0] for s in r.f[:8]) <= 2 for r in span)
    band = X.FeatureMasking(max_width=2, keys=["f"], p=1.0, schema=schema)(rows).collect()
    assert any(r.f[0][j] == 0 for r in band for j in range(3))
    assert len(X.TimeWarp(keys=["f"], p=1.0, schema=schema)(rows).first().f) == 10
    both = X.build_transform([{"name": "center_crop", "length": 4}, {"name": "gaussian_noise", "keys": ["f"]}], schema)
    assert len(both(rows, training=True).first().f) == 4
    assert X.build_transform([], schema) is None
    with pytest.raises(ValueError):
        X.build_transform([{"name": "nothing"}], schema)


def test_batches(spark):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("f", time_dim=9),), (TensorSpec("y", dtype="int64"),))])
    raw = from_tensors(spark, {"f": [[1.0] * 5, [2.0] * 9], "y": [0, 1]})
    rows = batch.fixed_batches(batch.evaluation_order(concatenate([raw], schema, [["local_ix"]], pad_features=False)), 2)
    padded = batch.dynamic_padding(rows, schema).orderBy("gix").collect()
    assert [len(r.f) for r in padded] == [9, 9] and sum(padded[0].f_mask) == 5
    one = batch.collate(rows, ["y"]).first()
    assert one.y == [0, 1] and one.batch_size == 2
    mixed = batch.mix(batch.dynamic_padding(rows, schema), schema, alpha=1.0).collect()
    assert all(0 <= r.mixup_lambda <= 1 and r.y_b == r.mixup_index for r in mixed)


def test_mix_keeps_the_permutation_where_a_drawn_blend_rounds_to_one(spark):
    schema = UnifiedSchema([DatasetSchema((TensorSpec("f"),), (TensorSpec("y", dtype="int64"),))])
    n = 7296  # batch 455 of seed 9 draws a blend that rounds to 1
    raw = from_tensors(spark, {"f": [float(i) for i in range(n)], "y": list(range(n))})
    rows = batch.fixed_batches(batch.evaluation_order(concatenate([raw], schema, [["local_ix"]])), 16).where("batch_id = 455")
    mixed = batch.mix(rows, schema, seed=9).collect()
    order = {r.slot: r.mixup_index for r in batch.partners(rows, 9).collect()}
    assert all(r.mixup_lambda == 1 and r.f == r.gix and r.mixup_index == order[r.slot] and r.y_b == 455 * 16 + r.mixup_index for r in mixed)
    assert len(mixed) == 16 and any(r.mixup_index != r.slot for r in mixed)
    assert all(r.mixup_index == r.slot and r.mixup_lambda == 1 for r in batch.mix(rows, schema, p=0.0, seed=9).collect())


def test_mixup_query_leaves_out_a_batch_of_one_like_its_sql(spark, tmp_path):
    spark.range(33).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding"), (F.col("id") % 3).cast("int").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.ix for r in catalog.QUERIES["mixup"](spark, str(tmp_path)).collect()) == list(range(32))


def test_rows_find_their_range_by_halving(spark):
    keys = [0, *range(3, 600, 5), 700, 700, 10**9]
    rows = spark.createDataFrame([(k, k % 7) for k in keys], "k long, r int")
    for cuts in ([], [5], [3, 3, 8], list(range(-1, 699, 3))):
        got = rank.cut_at(rows, F.col("k"), [F.lit(c) for c in cuts], "n")
        assert all(r.n == bisect.bisect_right(cuts, r.k) for r in got.collect())
        # Steps of the search grow with the logarithm of the cuts, one projection each.
        assert got._jdf.queryExecution().analyzed().toString().count("CASE WHEN") == len(cuts).bit_length()
    pairs = [(k, k % 3) for k in range(0, 600, 4)]
    got = rank.cut_at(rows, F.struct("k", "r"), [F.struct(F.lit(a).cast("long"), F.lit(b)) for a, b in pairs], "n")
    assert all(r.n == bisect.bisect_right(pairs, (r.k, r.r)) for r in got.collect())
    ranked = rank.rank_by_columns(rows.dropDuplicates(), ["k"], small=10).collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(set(keys))


def test_sources_config_and_report(spark, tmp_path):
    for i in range(3):
        d = tmp_path / "npy" / f"sample_{i:02d}"
        d.mkdir(parents=True)
        np.save(d / "video.npy", np.full((2, 3), i, np.float32))
        if i:
            np.save(d / "label.npy", np.int64(i))
    rows = read_npy(spark, str(tmp_path / "npy"), ["video", "label"]).orderBy("local_ix").collect()
    assert [r.key for r in rows] == ["sample_00", "sample_01", "sample_02"] and rows[0].label is None and rows[2].video == [[2.0] * 3] * 2
    schema = {"features": [{"name": "video", "time_dim": 2, "feature_dim": 3}], "targets": [{"name": "label", "dtype": "int64", "placeholder": -1}]}
    assert schema_from_dict(schema).keys == ["video", "label"]
    with pytest.raises(ValueError):
        build_dataset(spark, {"adapter": "none"})
    run = {"batch_size": 2, "datasets": [{"adapter": "npy", "args": {"root": str(tmp_path / "npy"), "keys": ["video", "label"]}, "schema": schema}], "strategy": {"name": "proportional"}, "unknown": 1, "seed": None}
    (tmp_path / "c.json").write_text(json.dumps(run))
    config = RunConfig.from_file(str(tmp_path / "c.json"))
    assert config.seed == 0 and RunConfig.from_file(template_path()).strategy["name"] == "temperature"
    got = config.build_batches(spark).collect()
    assert sorted(r.gix for r in got) == [0, 1, 2] and {r.batch_id for r in got} == {0, 1}
    loader = config.build_loader(spark)
    found = loader.describe()
    assert found.valid[0, "label"] == pytest.approx(2 / 3) and "label" in str(found)
    assert loader.validate() == ["dataset 0, sample 0, label: missing"]
    with pytest.raises(ValueError):
        report.validate([loader.datasets[0]], [loader.schemas[0]], strict=True)
