"""Every query that has SQL against DuckDB, on the smallest tables, a sample of each module."""

import math
import os

import pytest

import __spark_entry__
from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ["s2_normalise", "w2_ema", "a9_metrics_table", "c7_rolling_start", "w15_rally_legs", "f29_holidays", "s15_current_page", "f20_effective_records", "f19_source_filter", "c14_snapshot_violations", "c16_answers", "s7_overrides_document", "a27_describe", "c9_in_out_of_sample"]


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_registry():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(registry.QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 24
