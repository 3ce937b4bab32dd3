"""A declarative run: datasets, strategy, transforms, batches, from one JSON or YAML file."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmix.operators import batch as B
from maskmix.operators.transforms import Compose, build_transform
from maskmix.operators.unify import concatenate, fetch, locate, sequence_lengths, with_index
from maskmix.plans.strategies import STRATEGIES, ExhaustionPolicy, MixingStrategy, SubsampleConfig, bucket_batches, shard, shard_length
from maskmix.schema import DatasetSchema, UnifiedSchema
from maskmix.sources.factory import build_datasets

COLLATES = ("unified", "dynamic", "mixup")


def subsample_from_dict(data: Mapping | None) -> SubsampleConfig:
    args = dict(data or {})
    if isinstance(args.get("policy"), str):
        args["policy"] = ExhaustionPolicy(args["policy"])
    return SubsampleConfig(**args)


def template_path() -> str:
    """The annotated template of a configuration file."""
    return os.path.join(os.path.dirname(__file__), "template.yaml")


@dataclass
class RunConfig:
    """All fields have defaults; a null in a file means the default. The last six only matter to the consumer of
    batches: they are accepted and kept, and Spark's tasks stand in for them."""

    seed: int = 0
    batch_size: int = 32
    datasets: list = field(default_factory=list)
    strategy: dict = field(default_factory=lambda: {"name": "proportional"})
    subsample: dict | None = None
    transforms: list = field(default_factory=list)
    eval_transforms: list | None = None
    collate: dict = field(default_factory=lambda: {"name": "unified"})
    bucketing: dict | None = None
    pad_features: bool = True
    num_replicas: int = 1
    rank: int = 0
    drop_last: bool = False
    drop_last_batch: bool = False
    num_workers: int = 0
    pin_memory: bool = False
    prefetch_factor: int | None = None
    persistent_workers: bool = False
    timeout: float = 0
    shuffle: bool = True

    @classmethod
    def from_dict(cls, data: Mapping) -> RunConfig:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known and v is not None})

    @classmethod
    def from_json(cls, path: str) -> RunConfig:
        with open(path) as f:
            return cls.from_dict(json.load(f))

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})

    @classmethod
    def from_file(cls, path: str) -> RunConfig:
        ending = os.path.splitext(path)[1].lower()
        if ending == ".json":
            return cls.from_json(path)
        if ending in (".yaml", ".yml"):
            return cls.from_yaml(path)
        raise ValueError(f"unknown kind of configuration file: {path}")

    def to_dict(self) -> dict:
        return asdict(self)

    def build_subsample(self) -> SubsampleConfig:
        return subsample_from_dict(self.subsample)

    def build_strategy(self, sizes: Sequence[int], subsample: SubsampleConfig | None = None) -> MixingStrategy:
        args = dict(self.strategy)
        name = args.pop("name")
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
        return STRATEGIES[name](sizes, seed=self.seed, subsample=subsample or self.build_subsample(), **args)

    def build_transform(self, schema: UnifiedSchema, training: bool = True) -> Compose | None:
        """Evaluation takes its own list if there is one, else the same list without the training-only ones."""
        own = not training and self.eval_transforms is not None
        return build_transform(self.eval_transforms if own else self.transforms, schema)

    def build_datasets(self, spark: SparkSession):
        return build_datasets(spark, self.datasets)

    def build_loader(self, spark: SparkSession, datasets: Sequence[DataFrame] | None = None, schemas: Sequence[DatasetSchema] | None = None, orders=None) -> Loader:
        if datasets is None:
            datasets, schemas, orders = self.build_datasets(spark)
        elif schemas is None:
            raise ValueError("schemas are needed with datasets")
        return Loader(spark, datasets, schemas, orders or [["local_ix"]] * len(datasets), self.pad_features)

    def build_batches(self, spark: SparkSession, datasets=None, schemas=None, orders=None, training: bool = True, epoch: int = 0) -> DataFrame:
        """Unified, transformed rows with ``pos, batch_id, slot``, padded and mixed by batch as configured."""
        return self.batches_of(self.build_loader(spark, datasets, schemas, orders), training, epoch)

    def batches_of(self, loader: Loader, training: bool = True, epoch: int = 0) -> DataFrame:
        spark = loader.spark
        if training:
            strategy = self.build_strategy(loader.sizes)
            length = sum(strategy.counts(epoch))
            plan = strategy.plan(spark, epoch)
            if self.num_replicas > 1:
                plan = shard(plan, length, self.num_replicas, self.rank, self.drop_last)
                plan = plan.withColumn("pos", F.floor(F.col("pos") / self.num_replicas).cast("long"))
                length = shard_length(length, self.num_replicas, self.drop_last)
            rows = plan
        else:
            rows, length = B.evaluation_order(loader.index()), len(loader)
        if self.bucketing:
            options = {"batch_size": self.batch_size, "drop_last": training and self.drop_last_batch, "shuffle": training, "seed": self.seed, "epoch": epoch, **self.bucketing}
            lengths = loader.lengths(options.pop("key"))
            rows = bucket_batches(rows.join(lengths, "gix"), **options).drop("length")
        else:
            rows = B.fixed_batches(rows, self.batch_size, length, training and self.drop_last_batch)
        rows = fetch(rows, loader.unified())
        transform = self.build_transform(loader.schema, training)
        if transform is not None:
            rows = transform(rows, training, self.seed, epoch)
        return self.collated(rows, loader.schema, training, epoch)

    def build_collated(self, spark: SparkSession, datasets=None, schemas=None, orders=None, training: bool = True, epoch: int = 0) -> DataFrame:
        """``build_batches``, with one row a batch: ``batch_id, batch_size`` and each column as the array of its samples' values."""
        rows = self.build_batches(spark, datasets, schemas, orders, training, epoch)
        return B.collate(rows, [c for c in rows.columns if c not in ("batch_id", "slot")])

    def collated(self, rows: DataFrame, schema: UnifiedSchema, training: bool, epoch: int) -> DataFrame:
        args = dict(self.collate)
        name = args.pop("name", "unified")
        if name not in COLLATES:
            raise ValueError(f"unknown collate {name!r}; known: {', '.join(COLLATES)}")
        base = args.pop("base", "unified")
        if name == "dynamic" or name == "mixup" and base == "dynamic":
            rows = B.dynamic_padding(rows, schema, args.pop("keys", None))
        if name == "mixup" and training:
            rows = B.mix(rows, schema, seed=self.seed, epoch=epoch, **args)
        return rows


class Loader:
    """The concatenated datasets: sizes, union schema, unified rows."""

    def __init__(self, spark: SparkSession, datasets: Sequence[DataFrame], schemas: Sequence[DatasetSchema], orders: Sequence[Sequence[str]], pad_features: bool = True, names: Sequence[str] | None = None):
        if not datasets or len(datasets) != len(schemas):
            raise ValueError("one schema a dataset is needed")
        self.spark, self.datasets, self.schemas, self.orders, self.pad_features, self.names = spark, list(datasets), list(schemas), list(orders), pad_features, names
        self.schema = UnifiedSchema(self.schemas)
        self.sizes = [d.count() for d in self.datasets]

    def __len__(self) -> int:
        return sum(self.sizes)

    def unified(self) -> DataFrame:
        return concatenate(self.datasets, self.schema, self.orders, self.sizes, self.names, self.pad_features)

    def index(self) -> DataFrame:
        """``gix`` of every sample."""
        return self.spark.range(len(self)).select(F.col("id").alias("gix"))

    def sample(self, gix: int, transform: Compose | None = None, training: bool = False, seed: int = 0, epoch: int = 0) -> dict:
        """One sample by its global index (negative ones count from the end), transformed if asked."""
        _, local = locate(gix, self.sizes)
        at = gix + len(self) if gix < 0 else gix
        rows = self.unified().where((F.col("gix") == at) & (F.col("local_ix") == local))
        if transform is not None:
            rows = transform(rows, training, seed, epoch)
        return rows.first().asDict()

    def lengths(self, key: str) -> DataFrame:
        """``gix, length`` of the raw values."""
        parts, offset = [], 0
        for df, order, n in zip(self.datasets, self.orders, self.sizes, strict=True):
            df = with_index(df, order)
            parts.append(df.select((F.col("local_ix") + offset).alias("gix"), sequence_lengths(df, key).alias("length")))
            offset += n
        return reduce(DataFrame.unionByName, parts)

    def describe(self, max_samples: int | None = 64):
        from maskmix.operators.report import describe

        return describe(self.datasets, self.schemas, self.orders, self.names, max_samples)

    def validate(self, num_samples: int | None = 4, strict: bool = False):
        from maskmix.operators.report import validate

        return validate([with_index(d, o) for d, o in zip(self.datasets, self.orders, strict=True)], self.schemas, num_samples, strict)


class Splits:
    """Batches of the train, valid and test splits of a run; an absent split gives None."""

    def __init__(self, config: RunConfig, train: Loader | None = None, valid: Loader | None = None, test: Loader | None = None):
        self.config, self.loaders, self.epoch = config, {"train": train, "valid": valid, "test": test}, 0

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    def batches(self, split: str) -> DataFrame | None:
        loader = self.loaders[split]
        return None if loader is None else self.config.batches_of(loader, split == "train", self.epoch)


def iterate(batches: DataFrame, columns: Sequence[str]):
    """Collated batches in order, a partition at a time, the next one read ahead."""
    yield from B.collate(batches, columns).orderBy("batch_id").toLocalIterator(prefetchPartitions=True)
