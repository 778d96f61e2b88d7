"""Time the headline jobs on log files rendered from ``lineitem``; prints one JSON line.

Rendering is not timed. Each job runs once to warm up and then twice; the mean counts.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import logweir as lw
from logweir.plans import filter_report_summary, load_lines, stats_report
from logweir.streaming import follow_lines
from workload import render as R

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
TYPES = ["view", "purchase", "signup", "click", "error"]


def render(spark: SparkSession, folder: str) -> dict[str, str]:
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    rows = R.with_fields(
        items.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("l_suppkey").alias("user_id"),
            F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("event_type"),
            (F.col("l_extendedprice") / 100).alias("value"),
        )
    ).repartition(4)
    paths = {}
    for name, template in (("access", R.nginx), ("json", R.json), ("free", R.cascade)):
        paths[name] = f"{folder}/{name}"
        rows.select(R.corrupted(template()).alias("line")).write.text(paths[name])
    return paths


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lw.configure(spark)
    paths = render(spark, folder)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def parse(name, format, numbers=False):
        noop(lw.parse_logs(lw.read_lines(spark, paths[name], line_numbers=numbers), format))

    def follow():
        lines = follow_lines(spark, paths["access"], "all")
        (
            lw.parse_logs(lines, "nginx").writeStream.format("noop").outputMode("append")
            .option("checkpointLocation", tempfile.mkdtemp(dir=folder))
            .trigger(availableNow=True).start().awaitTermination()
        )

    access_options = dict(format="nginx", line_numbers=False)
    jobs = {
        "parse_access": lambda: parse("access", "nginx"),
        "parse_json": lambda: parse("json", "json"),
        "parse_free_form": lambda: parse("free", "custom"),
        "parse_auto": lambda: noop(
            lw.parse_logs(load_lines(spark, list(paths.values()), "auto", line_numbers=False))
        ),
        "number_lines": lambda: noop(lw.read_lines(spark, paths["access"])),
        "status_distribution": lambda: lw.status_distribution(
            lw.parse_logs(load_lines(spark, paths["access"], **access_options), "nginx")
        ).collect(),
        "top_paths": lambda: lw.top_paths(
            lw.parse_logs(load_lines(spark, paths["access"], **access_options), "nginx")
        ).collect(),
        "stats_document": lambda: stats_report(spark, paths["access"], **access_options).collect(),
        "stats_document_numbered": lambda: stats_report(
            spark, paths["access"], format="nginx"
        ).collect(),
        "filter_all": lambda: filter_report_summary(
            spark, paths["access"], format="nginx", levels=["info", "warn"],
            statuses=[200, 404, 302], methods=["GET"], ips=[f"10.0.0.{i}" for i in range(100)],
            path="/(view|click)/", since="1996-01-03", until="2000-01-28", contains="http/1.1",
            not_contains="agent/5",
        ).collect(),
        "follow_drain": follow,
    }
    times = {}
    for name, job in jobs.items():
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            job()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "log_jobs_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
                "lines": rows,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
