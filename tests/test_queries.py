import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemill.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def test_initcap_after_signs(spark, data):
    row = QUERIES["initcap_words"](spark, data).where("p_partkey = 0").first()
    assert row.name == row.name.title()


@pytest.mark.parametrize("last", ["2024-01-30 23:59:25.499999", "2024-01-30 23:59:24.5", "2024-01-30 23:59:25.5", "2024-01-30 23:59:25.500001", "2024-01-30 23:59:59.999999", "1969-12-31 23:59:58.5", "1969-12-31 23:59:58.4", None])
def test_freshness_rounds_seconds_as_its_sql(spark, tmp_path, last):
    con = duckdb.connect()
    con.execute("create table events as select ts::timestamp as ts from (values (?), ('1960-01-01 00:00:00.7'), (null)) t(ts) where ? is not null or ts is null", [last, last])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    assert [tuple(r) for r in QUERIES["source_freshness"](spark, str(tmp_path)).collect()] == con.execute(ORACLES["source_freshness"]).fetchall()


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["metric_time", "revenue"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
