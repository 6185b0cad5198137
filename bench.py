"""Time the headline queries; print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores of local mode."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from stratograph.plans import all_queries

HEADLINE = (
    "f04_find_references", "f05_find_implementations", "a01_fan_in_fan_out", "g07_page_rank", "g13_call_hierarchy", "g16_modularity", "g19_coupling_strength",
    "a10_module_quality", "g34_pattern_recognition", "x01_cyclomatic", "x28_fixed_split", "x36_cross_references", "a21_readability", "a30_a31_judge_consensus",
    "v03_top_k", "c07_history_batches", "q01_upsert", "i01_polling_changes", "i02_debounced_changes",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bench-"),
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, times = all_queries(), {}
    found["a01_fan_in_fan_out"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
