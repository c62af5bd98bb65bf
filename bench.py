"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads. Each query is run once to
warm up and then timed; results are written to the no-op sink. ``throughput`` has series a second for decoding, hashing and
counting, on the scales of the reference's own benchmarks.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seriescope.operators import estimate
from seriescope.plans import catalogue
from seriescope.sources import wire

HEADLINE = (
    "global_cardinality", "global_cardinality_lineitem", "group_cardinality_by_name", "group_cardinality_by_two_labels", "windowed_cardinality_grouped", "as_of_cardinality", "group_limit_single_gen",
    "group_limit_history", "multi_stream_cardinality", "multi_interval_estimates", "sketch_within_bound_p14", "node_merge_cardinality", "churn_pct_by_group", "topk_groups", "alert_high_cardinality", "exposition_lines", "wire_decode",
)


def run(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def series(spark: SparkSession, n: int, labels: int, groups: int = 3):
    """n series of ``labels`` labels of about 20 bytes and one group label."""
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    made = [pair(f"label{i}", F.concat(F.lit(f"val{i:05d}_"), F.lpad(F.col("id").cast("string"), 20, "x"))) for i in range(labels)]
    return spark.range(n).select(F.array(*made, pair("groupLabel", (F.col("id") % groups).cast("string"))).alias("labels"), "id")


def throughput(spark: SparkSession) -> dict[str, int]:
    out = {}
    for labels in (0, 1, 20):
        n = 400_000
        rows = series(spark, n, labels).select("labels").repartition(spark.sparkContext.defaultParallelism).cache()
        rows.count()
        run(estimate.cardinality(rows, ("groupLabel",), exact=False))
        out[f"hash_and_sketch_{labels}_labels_per_s"] = round(n / run(estimate.cardinality(rows, ("groupLabel",), exact=False)))
        rows.unpersist()
    # Values carry the number of the series, so no two series of a body are alike.
    body = wire.encode([[*((f"label{i}", f"val{k:05d}_" + "x" * 20) for i in range(20)), ("groupLabel", str(k % 3))] for k in range(5000)])
    n = 256
    requests = spark.range(n, numPartitions=32).select(F.col("id").alias("request"), F.lit(bytearray(body)).alias("body"))
    # Decompressed, decoded and hashed, with the group's label handed on; and with all labels handed on.
    for name, wanted in (("wire_decode_20_labels_per_s", frozenset(["groupLabel"])), ("wire_decode_20_all_labels_per_s", None)):
        run(wire.read_requests(requests, wanted=wanted))
        out[name] = round(n * 5000 / run(wire.read_requests(requests, wanted=wanted)))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(catalogue.QUERIES[name](spark, sf_dir))
        times[name] = run(catalogue.QUERIES[name](spark, sf_dir))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "throughput": throughput(spark), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
