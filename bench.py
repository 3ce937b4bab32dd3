"""All queries of the engine, timed one by one. Prints one JSON line; its value is the sum over the headline queries."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from maskmix.plans import catalog

HEADLINE = ("coverage_valid_fraction", "pad_crop_steps", "full_stats", "dataset_stats", "class_histogram_steps", "sampler_weights", "normalize", "instance_steps", "per_dataset_union", "random_crop", "gaussian_noise", "time_warp", "plan_temperature", "draw_weighted_replacement", "bucket_batches", "split_stratified", "collate_dynamic_len", "mixup", "cutmix")
#: A query is run again, up to three times, until it has taken this many seconds; its figure is the median.
ENOUGH = 3.0


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in catalog.QUERIES:
        runs = [timed(spark, name, sf_dir)]
        while len(runs) < 3 and sum(runs) < ENOUGH:
            runs.append(timed(spark, name, sf_dir))
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
