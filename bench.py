"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from veilspark.plans.queries import QUERIES

NAMES = ("all_recognizers", "findings_by_source", "ip_findings", "redact_replace", "conversation_redaction", "dedup_containment", "merge_same_type")


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.veilspark.spread", str(4 * int(cpus))).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([0-9.]+)", where)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
