"""All registered queries with their SQL cross-checks."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _module in ("detection", "redaction", "workflow", "layouts", "scoring"):
    for _name, (_fn, _sql) in import_module(f"veilframe.plans.{_module}").QUERIES.items():
        QUERIES[_name] = _fn
        if _sql is not None:
            ORACLES[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.plans.redaction import flagship as run

    return run(spark, sf_dir)
