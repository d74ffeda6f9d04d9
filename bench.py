"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``build`` is the time to make the plan (and the tables that it writes on the
way), ``run`` the time to carry it out, ``queries`` both. MB per second are of
``run``, for texts read once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = [
    "detect_all", "detect_email", "detect_card", "resolve_overlaps", "redact_label", "redact_code_partial", "redact_shared",
    "mapping_table", "restore_roundtrip", "items_per_document", "audit_coverage", "allocate_codes", "rescan_carry_over",
    "assemble_lines", "distribute_edits", "redact_table", "manifest", "char_recall", "false_alarms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from veilframe.plans.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    spark.range(1).write.format("noop").mode("overwrite").save()
    took, built = {}, {}
    for name in names:
        started = time.time()
        df = QUERIES[name](spark, sf_dir)
        built[name] = round(time.time() - started, 3)
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) b", "count(*) n").first()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("sum(octet_length(text)) b", "count(*) n").first()
    text_mb = (docs["b"] + turns["b"]) / 1e6
    rate = {n: round(text_mb / max(took[n] - built[n], 0.001), 2) for n in ("detect_all", "redact_label", "redact_code_partial", "restore_roundtrip") if n in took}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "build": built, "run": {n: round(took[n] - built[n], 3) for n in took}, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "text_mb": round(text_mb, 1), "texts": docs["n"] + turns["n"],
        "mb_per_sec": rate, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
