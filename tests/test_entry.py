"""The driver contract: entry() runs, every query has SQL unless it is
rows-only by design, and a sample of queries matches DuckDB at sf0.001."""

import math
import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

# Optional training-data queries are the business of tests/llm.
OPTIONAL = re.compile(r"op\d+_|pipeline$")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "path" in df.columns and "extras" not in df.columns


def test_every_query_has_sql():
    assert not [q for q in E.queries() if not OPTIONAL.match(q) and q not in E.oracle_sql()]


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)
    return v


@pytest.mark.parametrize("name", ["repaired_flat", "header_long", "page_join", "content_dedup", "normalise", "prompts", "incremental_job", "export_csv"])
def test_matches_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem documents labels "
              "conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sp.columns) == sorted(dd.columns)
    cols = sorted(sp.columns)
    key = lambda df: sorted(tuple(str(_norm(r[c])) for c in cols) for r in df.to_dict("records"))
    assert key(sp) == key(dd)
