"""Registered queries over the invoices derived from the order tables.

Each takes (spark, sf_dir) and returns a DataFrame; column names match the
SQL in `oracle.py`.  `extras` (VARIANT) is not part of the outputs compared
with SQL; `valid` says whether a record carries it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reshape
from ..operators.extract import extract_records
from ..schema import FLAT_HEADER_ORDER, FLAT_ITEM_ORDER
from ..session import configure
from ..sources.tables import clean_responses, damaged_responses


def _clean(spark: SparkSession, sf_dir: str, strict_alias: bool = False) -> DataFrame:
    configure(spark)
    return extract_records(clean_responses(spark, sf_dir), strict_alias=strict_alias)


def _damaged(spark: SparkSession, sf_dir: str, strict_alias: bool = False) -> DataFrame:
    configure(spark)
    return extract_records(damaged_responses(spark, sf_dir), strict_alias=strict_alias)


def _line_no():
    """Item number, 0 on the header-only row of a record without items."""
    return F.coalesce(F.col("line_no"), F.lit(0)).alias("line_no")


def flat_rows(spark, sf_dir):
    """Clean records -> one row per item, header repeated."""
    fl = reshape.flat_table(_clean(spark, sf_dir), with_line_no=True)
    return fl.select("path", *FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER, _line_no())


def header_fields(spark, sf_dir):
    """F1, V1-V3: one row per record, the header fields."""
    return reshape.header_table(_clean(spark, sf_dir))


def line_items(spark, sf_dir):
    """The item table (records without items give no row)."""
    return reshape.items_table(_clean(spark, sf_dir), with_line_no=True)


def header_long(spark, sf_dir):
    """Header as (Field, Value) text pairs, 15 per record."""
    return reshape.header_long(_clean(spark, sf_dir))


def repair_status(spark, sf_dir):
    """Records per repair outcome."""
    ex = _damaged(spark, sf_dir)
    return ex.groupBy("json_status").agg(F.count(F.lit(1)).alias("records"))


def repaired_flat(spark, sf_dir):
    """Damaged responses all the way to flat rows."""
    fl = reshape.flat_table(_damaged(spark, sf_dir), with_line_no=True)
    return fl.select("path", *FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER, _line_no(),
                     F.col("extras").isNotNull().alias("has_extras"))


def unknown_columns(spark, sf_dir):
    """damaged responses with the unknown keys of invalid records as
    columns between header and item columns."""
    records = _damaged(spark, sf_dir)
    unknown = reshape.unknown_columns(records)
    fl = reshape.flat_table(records, with_line_no=True, unknown=unknown)
    assert fl.columns[1 + len(FLAT_HEADER_ORDER):-len(FLAT_ITEM_ORDER) - 1] == unknown
    return fl.select("path", _line_no(), "vendor_name", *unknown, "description")


def validation_report(spark, sf_dir):
    """Records per (json_status, valid)."""
    return reshape.status_counts(_damaged(spark, sf_dir))


def gstin_modes(spark, sf_dir):
    """V8: the tax ids as read by default and with strict alias reading."""
    configure(spark)
    both = extract_records(damaged_responses(spark, sf_dir), strict_alias="both")
    return both.select(
        "path", F.col("invoice.vendor_gstin").alias("vendor_gstin"), F.col("invoice.buyer_gstin").alias("buyer_gstin"),
        "vendor_gstin_strict", "buyer_gstin_strict")


def kpis(spark, sf_dir):
    """K1, K2: per record line-item count, subtotal, tax %, total."""
    return reshape.kpis(_damaged(spark, sf_dir))


QUERIES = {
    "flat_rows": flat_rows,
    "header_fields": header_fields,
    "line_items": line_items,
    "header_long": header_long,
    "repair_status": repair_status,
    "repaired_flat": repaired_flat,
    "unknown_columns": unknown_columns,
    "validation_report": validation_report,
    "gstin_modes": gstin_modes,
    "kpis": kpis,
}
