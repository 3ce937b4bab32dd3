"""Command line: describe, validate, compute-stats, class-weights-for-loss."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from maskmix.config import Loader, RunConfig
from maskmix.operators import balance, stats


def _load(spark: SparkSession, path: str) -> Loader:
    config = RunConfig.from_file(path)
    if not config.datasets:
        raise SystemExit(f"{path} names no datasets")
    # Statistics are over the padded union, whatever the run's own padding.
    config.pad_features = True
    return config.build_loader(spark)


def _describe(spark, args) -> int:
    print(_load(spark, args.config).describe(args.max_samples))
    return 0


def _validate(spark, args) -> int:
    found = _load(spark, args.config).validate(args.num_samples)
    print("\n".join(found) or "no issues")
    return int(bool(found))


def _compute_stats(spark, args) -> int:
    loader = _load(spark, args.config)
    keys = args.keys or loader.schema.feature_keys
    compute = stats.dataset_stats if args.per_dataset else stats.full_stats
    stats.save_stats(stats.collect_stats(compute(loader.unified(), loader.schema, keys), None if args.per_dataset else keys), args.output)
    return 0


def _class_weights(spark, args) -> int:
    loader = _load(spark, args.config)
    histogram = balance.class_histogram(loader.unified(), loader.schema, args.target, args.num_classes)
    balance.save_weights(balance.loss_weights(histogram, args.scheme, args.beta), args.output, args.target, args.scheme)
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="maskmix")
    commands = parser.add_subparsers(required=True)

    def command(name, run, **options):
        p = commands.add_parser(name)
        p.add_argument("config")
        p.set_defaults(run=run)
        return p

    command("describe", _describe).add_argument("--max-samples", type=int, default=64)
    command("validate", _validate).add_argument("--num-samples", type=int, default=4)
    p = command("compute-stats", _compute_stats)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--keys", nargs="*")
    p.add_argument("--per-dataset", action="store_true")
    p = command("class-weights-for-loss", _class_weights)
    p.add_argument("--target", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--num-classes", type=int)
    p.add_argument("--scheme", choices=("inverse", "effective"), default="inverse")
    p.add_argument("--beta", type=float, default=0.999)
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
