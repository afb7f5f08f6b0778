"""Reference SQL (DuckDB dialect) for the registered queries.

The SQL computes each answer relationally from the same tables; it never
parses the JSON the Spark side builds, so it checks the whole chain.
"""

from __future__ import annotations

from ..schema import DOUBLE_HEADER, FLAT_HEADER_ORDER, HEADER_FIELDS

# Lines of each order with their rank inside the order.
_LINES = """
lines AS (
  SELECT l.l_orderkey, l.l_suppkey, l.l_extendedprice, l.l_tax, l.l_quantity,
         coalesce(p.p_name, '') AS p_name, p.p_retailprice,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
              l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
              l.l_returnflag, l.l_linestatus, l.l_shipdate) AS line_no
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""

# One row per order with every invoice header field, plus `m` (damage mode).
_INV = """
per_order AS (
  SELECT l_orderkey, min(l_suppkey) AS vendor_key,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal_d,
         max(CAST(l_tax AS DECIMAL(4,2))) AS rate, count(*) AS n_lines
  FROM lines GROUP BY l_orderkey
),
inv AS (
  SELECT o.o_orderkey, o.o_orderkey % 22 AS m,
    'orders/' || CAST(o.o_orderkey AS VARCHAR) || '.pdf' AS path,
    s.s_name AS vendor_name,
    'Unit ' || CAST(s.s_suppkey AS VARCHAR) || ', ' || sn.n_name AS vendor_address,
    lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') || 'SUP' || lpad(CAST(s.s_suppkey AS VARCHAR), 7, '0') || 'Z1' AS vendor_gstin,
    'INV-' || CAST(o.o_orderkey AS VARCHAR) AS invoice_number,
    strftime(o.o_orderdate, '%Y-%m-%d') AS invoice_date,
    strftime(CAST(o.o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due_date,
    c.c_name AS buyer_name,
    'Unit ' || CAST(c.c_custkey AS VARCHAR) || ', ' || cn.n_name AS buyer_address,
    lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') || 'CUS' || lpad(CAST(c.c_custkey AS VARCHAR), 7, '0') || 'Z1' AS buyer_gstin,
    (['USD', 'EUR', 'GBP', 'INR', 'JPY'])[cn.n_regionkey + 1] AS currency,
    CAST(po.subtotal_d AS DOUBLE) AS subtotal,
    CAST(po.rate * 100 AS DOUBLE) AS tax_percent,
    CAST(round(po.subtotal_d * po.rate, 2) AS DOUBLE) AS tax_amount,
    CAST(po.subtotal_d + round(po.subtotal_d * po.rate, 2) AS DOUBLE) AS total,
    'priority ' || o.o_orderpriority AS notes,
    coalesce(po.n_lines, 0) AS n_lines
  FROM orders o
  LEFT JOIN per_order po ON po.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey
  LEFT JOIN supplier s ON s.s_suppkey = po.vendor_key
  LEFT JOIN nation sn ON sn.n_nationkey = s.s_nationkey
)"""

_WITH = "WITH " + _LINES + "," + _INV + "\n"

_HEADER = FLAT_HEADER_ORDER
_DECL = [n for n, _ in HEADER_FIELDS]
_DOUBLES = set(DOUBLE_HEADER)


def _header_cols(prefix="i.") -> str:
    return ", ".join(f"{prefix}{c} AS {c}" for c in _HEADER)


# Damage modes by outcome (`m`, see sources/tables.py).  10 is invalid only where there are items.
_EMPTY = "(6, 14)"                        # no field survives
_INVALID = "(i.m IN (5, 8, 9, 14, 15, 16, 17, 18, 21) OR i.m = 10 AND i.n_lines > 0)"
_LOST = {"invoice_number": "(5, 21)", "subtotal": "(8, 13, 17, 20)", "tax_amount": "(13, 20)", "total": "(13, 18, 20)"}
_READ = {"subtotal": "WHEN i.m = 19 THEN 5.5", "tax_percent": "WHEN i.m = 19 THEN 10.0", "total": "WHEN i.m = 19 THEN 1.0",
         "notes": "WHEN i.m = 20 THEN 'NaN, \"Infinity'"}


def _damaged(c: str) -> str:
    """A header field as it comes out of the damaged responses."""
    lost = f"WHEN i.m IN {_LOST[c]} THEN NULL " if c in _LOST else ""
    return f"CASE WHEN i.m IN {_EMPTY} THEN NULL {lost}{_READ.get(c, '')} ELSE i.{c} END"


def _damaged_header_cols() -> str:
    # Mode 8: the first item's own currency wins in its row, the other items' null ones in theirs.
    out = [f"{_damaged(c)} AS {c}" for c in _HEADER if c != "currency"]
    out.append(f"CASE WHEN i.m = 8 AND l.line_no = 1 THEN 'ITM' WHEN i.m = 8 AND l.line_no > 1 THEN NULL "
               f"ELSE {_damaged('currency')} END AS currency")
    return ", ".join(out)


_ITEM_COLS = ("l.p_name AS description, l.l_quantity AS quantity, "
              "l.p_retailprice AS unit_price, l.l_extendedprice AS amount, CAST(coalesce(l.line_no, 0) AS INTEGER) AS line_no")

_STATUS = ("CASE i.m WHEN 1 THEN 'sliced' WHEN 3 THEN 'sliced' WHEN 6 THEN 'empty' "
           "ELSE 'ok' END")


# Items as they come out of the damaged responses.
_DAMAGED_LINES = """
, dl AS (
  SELECT l.l_orderkey, i.m, l.line_no, CASE i.m WHEN 10 THEN NULL WHEN 11 THEN '' ELSE l.p_name END AS p_name,
         l.l_quantity, l.p_retailprice, l.l_extendedprice
  FROM lines l JOIN inv i ON l.l_orderkey = i.o_orderkey WHERE i.m NOT IN (6, 14, 15, 16)
  UNION ALL SELECT o_orderkey, m, n_lines + 1, NULL, NULL, NULL, NULL FROM inv WHERE m = 9
)"""


def _header_long_sql() -> str:
    vals = ", ".join(
        (f"CAST(i.{c} AS VARCHAR) AS {c}" if c in _DOUBLES else f"i.{c} AS {c}") for c in _DECL)
    return (_WITH + f"SELECT path, Field, Value FROM (SELECT i.path, {vals} FROM inv i) h "
            f"UNPIVOT INCLUDE NULLS (Value FOR Field IN ({', '.join(_DECL)}))")


ORACLE = {
    "flat_rows": _WITH + f"""
SELECT i.path, {_header_cols()}, {_ITEM_COLS}
FROM inv i LEFT JOIN lines l ON l.l_orderkey = i.o_orderkey""",

    "header_fields": _WITH + f"""
SELECT i.path, {", ".join(f"i.{c} AS {c}" for c in _DECL)} FROM inv i""",

    "line_items": _WITH + f"""
SELECT i.path, {_ITEM_COLS}
FROM inv i JOIN lines l ON l.l_orderkey = i.o_orderkey""",

    "header_long": _header_long_sql(),

    "repair_status": _WITH + f"""
SELECT {_STATUS} AS json_status, count(*) AS records FROM inv i GROUP BY 1""",

    "repaired_flat": _WITH + _DAMAGED_LINES + f"""
SELECT i.path, {_damaged_header_cols()}, {_ITEM_COLS}, {_INVALID} AS has_extras
FROM inv i LEFT JOIN dl l ON l.l_orderkey = i.o_orderkey""",

    # Keys that no field has: po_number of the header, or of the second item in its row; sku of the items.
    "unknown_columns": _WITH + _DAMAGED_LINES + f"""
SELECT i.path, CAST(coalesce(l.line_no, 0) AS INTEGER) AS line_no, {_damaged("vendor_name")} AS vendor_name,
  CASE WHEN i.m = 21 THEN '[1,2]' END AS pages,
  CASE WHEN i.m = 21 AND l.line_no = 2 THEN 'PO-item' WHEN i.m = 21 THEN 'PO-' || CAST(i.o_orderkey AS VARCHAR) END AS po_number,
  CASE WHEN i.m = 21 THEN CAST(l.line_no - 1 AS VARCHAR) END AS sku, l.p_name AS description
FROM inv i LEFT JOIN dl l ON l.l_orderkey = i.o_orderkey""",

    "validation_report": _WITH + f"""
SELECT {_STATUS} AS json_status, NOT {_INVALID} AS valid, count(*) AS records
FROM inv i GROUP BY 1, 2""",

    "gstin_modes": _WITH + f"""
SELECT i.path,
  CASE WHEN i.m IN {_EMPTY} THEN NULL ELSE i.vendor_gstin END AS vendor_gstin,
  CASE WHEN i.m IN {_EMPTY} THEN NULL ELSE i.buyer_gstin END AS buyer_gstin,
  CASE WHEN i.m <> 14 AND (i.m = 7 OR {_INVALID}) THEN i.vendor_gstin END AS vendor_gstin_strict,
  CASE WHEN i.m <> 14 AND (i.m = 7 OR {_INVALID}) THEN i.buyer_gstin END AS buyer_gstin_strict
FROM inv i""",

    "kpis": _WITH + f"""
SELECT i.path,
  CAST(CASE WHEN i.m IN (6, 14, 15, 16) THEN 0 WHEN i.m = 9 THEN i.n_lines + 1 ELSE i.n_lines END AS INTEGER) AS line_items_count,
  {_damaged("subtotal")} AS subtotal, {_damaged("tax_percent")} AS tax_percent, {_damaged("total")} AS total
FROM inv i""",
}
