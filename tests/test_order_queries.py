"""Queries over the order tables, on tables of a few rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import reshape
from ledgerlake.operators.extract import extract_records
from ledgerlake.plans import document_queries as DQ
from ledgerlake.sinks import writers

DAY = datetime.datetime(1996, 3, 4)
TABLES = {
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string", [(k, 1, DAY, "1-URGENT") for k in (5, 6, 7)]),
    "customer": ("c_custkey long, c_name string, c_nationkey long", [(1, "Customer#1", 1)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "Supplier#1", 1)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "NATION_1", 1)]),
    "part": ("p_partkey long, p_name string, p_retailprice double", [(1, "red bolt", 900.1), (2, "blue ring", 900.2), (3, "red ring", 900.3)]),
}
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def tables(spark, folder, lines):
    """The order tables with lines (order, part, line number, quantity, amount)."""
    rows = [(o, p, 1, n, q, a, 0.0, 0.05, "N", "O", DAY) for o, p, n, q, a in lines]
    for name, (schema, of) in (TABLES | {"lineitem": (LINES, rows)}).items():
        spark.createDataFrame(of, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_grounding_looks_at_every_item(spark, tmp_path):
    """items 2, 4, ... are not in the text by themselves, but their numbers may be: as another item's, or as the subtotal's."""
    lines = [(5, 1, 1, 2.0, 1800.2), (5, 1, 2, 2.0, 1800.2), (5, 2, 3, 1.0, 900.2), (5, 3, 4, 1.0, 900.3),
             (6, 1, 1, 2.0, 1800.2), (6, 1, 2, 2.0, 1800.2),  # a text without numbers
             (7, 1, 1, 2.0, 0.0), (7, 1, 2, 2.0, 900.1)]
    folder = tables(spark, tmp_path, lines)
    got = {(int(r.path[7:-4]), r.line_no): (r.grounded, r.numbers_grounded) for r in DQ.grounding(spark, folder).collect()}
    assert got == {(5, 1): (True, True), (5, 2): (True, True), (5, 3): (True, True), (5, 4): (False, False),
                   (6, 1): (True, False), (6, 2): (True, False), (7, 1): (True, True), (7, 2): (True, True)}
    con = pytest.importorskip("duckdb").connect()
    for t in (*TABLES, "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    sql = con.execute(DQ.oracle()["grounding"]).fetchall()
    assert {(int(p[7:-4]), n): (bool(g), bool(x)) for p, n, _, g, x in sql} == got


def test_exports_leave_little_on_disk(spark, tmp_path):
    """records are stored without responses and raw values of valid records, their shuffles are deleted with the end of the
    write, and what the queries write is compressed."""
    folder = tables(spark, tmp_path, [(5, 1, 1, 2.0, 1800.2), (6, 2, 1, 1.0, 900.2), (6, 3, 2, 1.0, 900.3)])
    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffles()
    out, records = DQ._exported(spark, folder)
    assert shuffles() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept
    assert not {"response", "raw"} & set(spark.read.parquet(f"{out}/records").columns)
    writers.write_records_json(records, f"{out}/plain")
    writers.write_records_json(records, f"{out}/small", compression="gzip")
    lines = [sorted(r.value for r in spark.read.text(f"{out}/{x}").collect()) for x in ("plain", "small")]
    assert lines[0] == lines[1] and len(lines[0]) == 3
    for query, ends in (("export_tables", ".zstd.parquet"), ("export_csv", ".csv.gz"), ("export_json", ".json.gz")):
        files = DQ.QUERIES[query](spark, folder).inputFiles()
        assert files and all(f.endswith(ends) for f in files)


def test_stored_records_give_the_same_tables(spark, tmp_path):
    """invalid records keep what their rows need, failed calls are left out as before."""
    texts = ['{"invoice_number": 5, "currency": "EUR", "line_items": [{"currency": "USD", "sku": 1}, "loose", {}]}', '{"total": 1, "line_items": [{"amount": 2}]}', "no JSON"]
    rows = [(f"p{k}", t, None) for k, t in enumerate(texts)] + [("p9", None, "down")]
    records = extract_records(spark.createDataFrame(rows, "path string, response string, error string"))
    stored = writers.store_records(records, f"{tmp_path}/records")
    for of in (reshape.header_table, lambda d: reshape.items_table(d, with_line_no=True, with_raw=True), lambda d: reshape.flat_table(d, with_line_no=True),
               lambda d: reshape.flat_table(d, unknown=reshape.unknown_columns(d))):
        shown = [sorted(d.select(*[F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in d.dtypes]).collect(), key=str) for d in (of(records), of(stored))]
        assert shown[0] == shown[1]
