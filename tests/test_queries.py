"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from tools.check import compare
from veilframe.plans.catalog import ORACLES, QUERIES
from veilframe.plans.derived import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() == 200


def test_oracles_are_sql():
    spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert all(isinstance(sql, str) for sql in module.oracle_sql().values())
