"""F1-F7, X1-X6, K1-K3 (FIXTURES 3.4)."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import responses
from ledgerlake.operators import reshape
from ledgerlake.operators.extract import extract_records
from ledgerlake.schema import FLAT_COLUMNS
from ledgerlake.sinks import writers


def records(spark, values):
    return extract_records(responses(spark, [json.dumps(v) for v in values]))


def test_flat_shapes(spark):
    recs = records(spark, [
        {"vendor_name": "V", "line_items": []},
        {"vendor_name": "V"},
        {"vendor_name": "V", "line_items": [{"description": "a", "amount": 1}, {"description": "b"}]},
        {"invoice_number": 7, "currency": "USD",
         "line_items": [{"description": "x", "currency": None}, {"description": "y", "currency": "EUR"}]},
        {"invoice_number": 7, "line_items": ["a", {"description": "x"}]},
    ])
    flat = reshape.flat_table(recs, with_line_no=True)
    assert flat.columns == ["path"] + FLAT_COLUMNS + ["line_no"]
    rows = {}
    for r in flat.collect():
        rows.setdefault(r.path, []).append(r)
    assert len(rows["f0"]) == 1 and rows["f0"][0].description is None
    assert len(rows["f1"]) == 1 and rows["f1"][0].vendor_name == "V"
    f2 = sorted(rows["f2"], key=lambda r: r.line_no)
    assert [(r.vendor_name, r.description, r.amount) for r in f2] == [("V", "a", 1.0), ("V", "b", None)]
    f3 = sorted(rows["f3"], key=lambda r: r.line_no)
    assert [r.currency for r in f3] == [None, "EUR"]  # the item wins, even with null
    f4 = sorted(rows["f4"], key=lambda r: r.line_no)
    assert len(f4) == 2 and f4[0].description is None and f4[1].description == "x"


def test_unknown_columns(spark):
    recs = records(spark, [
        {"invoice_number": 7, "po": "P1", "a b'c": {"x": [1]}, "line_items": [{"description": "x", "sku": 5}, {"po": None, "zip": "z"}, "loose"]},
        {"invoice_number": 8, "po": 3, "Notes": True},
        {"vendor_name": "valid", "po": "dropped", "line_items": [{"description": "x", "other": 1}]},
        [1, 2], "text", None,
    ])
    names = reshape.unknown_columns(recs)
    assert names == ["Notes", "a b'c", "po", "sku", "zip"]
    flat = reshape.flat_table(recs, with_line_no=True, unknown=names)
    assert flat.columns == ["path", *FLAT_COLUMNS[:15], "Notes_", *names[1:], *FLAT_COLUMNS[-4:], "line_no"]
    got = {(r.path, r.line_no or 0): (r["a b'c"], r.po, r.sku, r.zip, r.Notes_) for r in flat.collect()}
    assert got[("f0", 1)] == ('{"x":[1]}', "P1", "5", None, None)
    assert got[("f0", 2)] == ('{"x":[1]}', None, None, "z", None)  # the item's null wins
    assert got[("f0", 3)] == ('{"x":[1]}', "P1", None, None, None)
    assert got[("f1", 0)] == (None, "3", None, None, "true") and got[("f2", 1)] == (None,) * 5
    with pytest.raises(ValueError):
        reshape.unknown_columns(recs, most=4)


def test_items_header_kpis(spark):
    recs = records(spark, [{"subtotal": 300, "tax_percent": 18, "total": 354,
                            "line_items": [{"description": "Hammer", "quantity": 2}]},
                           {"line_items": None}, {}])
    items = reshape.items_table(recs).collect()
    assert [(r.path, r.description, r.quantity) for r in items] == [("f0", "Hammer", 2.0)]
    k = {r.path: r for r in reshape.kpis(recs).collect()}
    assert (k["f0"].line_items_count, k["f0"].subtotal, k["f0"].tax_percent, k["f0"].total) == (1, 300.0, 18.0, 354.0)
    assert k["f2"].line_items_count == 0
    long = reshape.header_long(recs).filter(F.col("path") == "f0").collect()
    assert len(long) == 15
    vals = {r.Field: r.Value for r in long}
    assert vals["subtotal"] == "300.0" and vals["vendor_name"] is None


def test_double_text(spark):
    vals = [12345678.9, 300.0, 0.001, 1e-5, 1e16, 0.0006729844159164555, -2.5e-7, 123456789012.5, 0.1]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = [r.t for r in df.select(reshape.double_text(F.col("x")).alias("t")).collect()]
    assert got[:-1] == [str(v) for v in vals] and got[-1] is None


def test_csv_row(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0, 'x,"y"\nz', "")], "a string, quantity double, b string, c string")
    out = str(tmp_path / "csv")
    writers.write_flat_csv(df, out)
    rows = []
    for part in sorted(f for f in os.listdir(out) if f.endswith(".csv")):
        text = open(os.path.join(out, part), encoding="utf-8").read()
        parsed = list(csv.reader(io.StringIO(text)))
        assert parsed[0] == ["a", "quantity", "b", "c"]
        rows += parsed[1:]
    assert rows == [["", "1.0", 'x,"y"\nz', ""]]


def test_write_tables_and_json(spark, tmp_path):
    recs = records(spark, [{"vendor_name": "Vé", "line_items": [{"description": "a"}]}, {}])
    paths = writers.write_tables(recs, str(tmp_path / "out"))
    back = spark.read.parquet(paths["invoice_flat"])
    assert back.count() == 2 and "stem" in back.columns
    assert spark.read.parquet(paths["line_items"]).count() == 1
    assert spark.read.parquet(paths["invoice_header"]).count() == 2
    j = writers.write_records_json(recs, str(tmp_path / "json"))
    lines = [json.loads(l) for f in os.listdir(j) if f.endswith(".json")
             for l in open(os.path.join(j, f), encoding="utf-8")]
    assert {l["vendor_name"] for l in lines} == {"Vé", None}
    assert all("total" in l for l in lines)  # nulls kept


def test_stem(spark):
    df = spark.createDataFrame([("s3://b/x/inv.2024.pdf",), ("a.PDF",)], "path string")
    assert [r.s for r in df.select(writers.stem(F.col("path")).alias("s")).collect()] == ["inv.2024", "a"]


def test_orders_meet_their_buyers_before_their_items(spark, tmp_path):
    """The join to customer shuffles orders without their item arrays."""
    from itertools import takewhile
    from ledgerlake.session import setting
    from ledgerlake.sources.tables import invoice_columns
    for name, schema in {"orders": "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
                         "customer": "c_custkey long, c_name string, c_nationkey long", "supplier": "s_suppkey long, s_name string, s_nationkey long",
                         "nation": "n_nationkey int, n_name string, n_regionkey int", "part": "p_partkey long, p_name string, p_retailprice double",
                         "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = invoice_columns(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(o_custkey" in x)
    indent = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = list(takewhile(lambda x: indent(x) > indent(plan[at]), plan[at + 1:]))
    assert any("o_orderpriority" in x for x in below) and not any("collect_list" in x for x in below)


def test_items_are_looked_into_before_the_explode(spark):
    """Header keys held by items are read in the item array, for invalid
    records only: what follows the explode reads no variant per row."""
    df = spark.createDataFrame([("p", '{"invoice_number": 5, "currency": "EUR", "line_items": [{"currency": null}, {"currency": "USD"}, {}]}', None)],
                               "path string, response string, error string")
    flat = reshape.flat_table(extract_records(df), with_line_no=True)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" not in plan[:plan.index("Generate")]
    assert [(r.line_no, r.currency) for r in flat.orderBy("line_no").collect()] == [(1, None), (2, "USD"), (3, "EUR")]
