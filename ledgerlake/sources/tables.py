"""Invoices derived from the TPC-H style tables, and model responses for them.

One invoice per order: the buyer is the customer, the vendor the supplier
with the lowest supplier key among the order's lines, one item per line
(part name, quantity, retail price, extended price).  Money is summed as
decimal(18,2) and the tax rate (the order's highest line tax) as
decimal(4,2), then written as double.

The response text of each invoice is the record as JSON, damaged in one of
twenty-two ways chosen by `o_orderkey mod 22` (see `DAMAGE_MODES`).

Scale: lineitem is read once, joined to part on `l_partkey` (broadcast only
if the runtime size of `part` is under the session threshold) and grouped by
`l_orderkey` with partial aggregation.  The item array of an order is bounded
by the order's own lines; orders, already joined to their buyers, are joined to
the resulting per-order rows on the same key, so that join reuses the
aggregation's partitioning and item arrays are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOUBLE_HEADER, INVOICE_FIELDS, ITEM_FIELDS, LINE_ITEM_TYPE

MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"

# Currency of the buyer's region (region keys 0..4), an own choice.
REGION_CURRENCY = ["USD", "EUR", "GBP", "INR", "JPY"]

# o_orderkey mod 22 -> how the response text is written, and what becomes of it.
DAMAGE_MODES = {
    0: "plain",              # the JSON as is                          -> ok, valid
    1: "tagged_fence",       # ```json ... ```                         -> sliced, valid
    2: "fence",              # ``` ... ```                             -> ok, valid
    3: "prose",              # text around the JSON                    -> sliced, valid
    4: "numeric_strings",    # money and quantities as padded text     -> ok, valid
    5: "number_in_text",     # invoice_number as a JSON number         -> ok, invalid
    6: "cut_off",            # first half of the JSON only             -> empty, valid {}
    7: "alias_keys",         # tax ids under vendor_gst / buyer_gst    -> ok, valid
    8: "header_key_in_item", # first item holds a currency, the others a null one; subtotal a list -> ok, invalid
    9: "text_among_items",   # a text follows the items                -> ok, invalid
    10: "null_description",  # descriptions null                       -> ok, invalid if there are items
    11: "no_description",    # descriptions absent                     -> ok, valid, ''
    12: "unknown_keys",      # unknown keys at both levels             -> ok, valid, dropped
    13: "not_finite",        # subtotal "inf", tax_amount "1e400", total "NaN" -> ok, valid, null
    14: "top_level_list",    # the record inside a list                -> ok, invalid, all null
    15: "items_as_object",   # line_items an object                    -> ok, invalid, no items
    16: "items_as_text",     # line_items a text                       -> ok, invalid, no items
    17: "separator_in_number",  # subtotal starts with 0x1c            -> ok, invalid
    18: "padded_underscore", # total " 7_1"                            -> ok, invalid
    19: "odd_spaces",        # subtotal inside no-break spaces, tax_percent "1_0", total true -> ok, valid
    20: "bare_constants",    # subtotal NaN, tax_amount -Infinity, total Infinity, as bare words -> ok, valid, null
    21: "unknown_keys_invalid",  # as 12 with po_number and sku, invoice_number a JSON number -> ok, invalid
}

PROSE_HEAD = "Here is the extracted invoice:\n"
PROSE_TAIL = "\nLet me know if anything is missing."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def invoice_path(orderkey: Column) -> Column:
    return F.concat(F.lit("orders/"), orderkey.cast("string"), F.lit(".pdf"))


def tax_id(nationkey: Column, key: Column, tag: str) -> Column:
    return F.concat(F.lpad(nationkey.cast("string"), 2, "0"), F.lit(tag),
                    F.lpad(key.cast("string"), 7, "0"), F.lit("Z1"))


def _order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor, subtotal and tax rate of each order: partial sums before the
    shuffle, no item ever moved."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_tax")
    return li.groupBy("l_orderkey").agg(*_totals())


def _totals() -> list[Column]:
    return [F.min("l_suppkey").alias("vendor_key"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).alias("subtotal_d"),
            F.max(F.col("l_tax").cast(RATE)).alias("rate")]


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of each order and its item array.  An invoice is one
    record, so its items end up in one array, however they are gathered."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    # Repartitioned by the grouping key: a partial collect_list does not
    # shrink the data, so the one shuffle goes first and the array building
    # runs after it on every task (the aggregate reuses this partitioning).
    lines = li.join(part, li.l_partkey == part.p_partkey, "left").repartition("l_orderkey")
    # Items are ordered by every line column: (l_orderkey, l_linenumber) is
    # not unique, whole rows are.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                    "l_linestatus", "l_shipdate", "p_name", "p_retailprice")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"), *_totals())


def _item(line: Column) -> Column:
    return F.struct(line["p_name"].alias("description"), line["l_quantity"].alias("quantity"),
                    line["p_retailprice"].alias("unit_price"), line["l_extendedprice"].alias("amount"))


def invoice_columns(spark: SparkSession, sf_dir: str, with_items: bool = True) -> DataFrame:
    """One row per order: `o_orderkey`, `path` and one column per invoice
    field (canonical types).  Without items, `line_items` is left out and
    lines are only summed."""
    per_order = _order_lines(spark, sf_dir) if with_items else _order_totals(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    cn = nation.select(F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"),
                       F.col("n_regionkey").alias("cn_region"))
    sn = nation.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name"))

    # Buyers first, while an order is a narrow row: customer outgrows a
    # broadcast before supplier does, and its join then shuffles what it has.
    j = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
               .join(cn, F.col("c_nationkey") == F.col("cn_key"), "left")
               .join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
               .join(supp, F.col("vendor_key") == F.col("s_suppkey"), "left")
               .join(sn, F.col("s_nationkey") == F.col("sn_key"), "left"))
    tax_d = F.round(F.col("subtotal_d") * F.col("rate"), 2)
    currencies = F.array(*[F.lit(c) for c in REGION_CURRENCY])
    empty = F.array().cast("array<" + LINE_ITEM_TYPE.simpleString() + ">")
    fields = {
        "vendor_name": F.col("s_name"),
        "vendor_address": F.concat(F.lit("Unit "), F.col("s_suppkey").cast("string"),
                                   F.lit(", "), F.col("sn_name")),
        "vendor_gstin": tax_id(F.col("s_nationkey"), F.col("s_suppkey"), "SUP"),
        "invoice_number": F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")),
        "invoice_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "due_date": F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd"),
        "buyer_name": F.col("c_name"),
        "buyer_address": F.concat(F.lit("Unit "), F.col("c_custkey").cast("string"),
                                  F.lit(", "), F.col("cn_name")),
        "buyer_gstin": tax_id(F.col("c_nationkey"), F.col("c_custkey"), "CUS"),
        "currency": F.try_element_at(currencies, F.col("cn_region") + F.lit(1)),
        "subtotal": F.col("subtotal_d").cast("double"),
        "tax_percent": (F.col("rate") * F.lit(100)).cast("double"),
        "tax_amount": tax_d.cast("double"),
        "total": (F.col("subtotal_d") + tax_d).cast("double"),
        "notes": F.concat(F.lit("priority "), F.col("o_orderpriority")),
    }
    if with_items:
        fields["line_items"] = F.coalesce(F.transform("lines", _item), empty)
    return j.select("o_orderkey", invoice_path(F.col("o_orderkey")).alias("path"),
                    *[fields[n].alias(n) for n, _ in INVOICE_FIELDS if n in fields])


def invoice_struct(overrides: dict | None = None, rename: dict | None = None) -> Column:
    """The invoice fields of `invoice_columns` as one struct, in declaration
    order, with some fields replaced or renamed."""
    overrides, rename = overrides or {}, rename or {}
    return F.struct(*[overrides.get(n, F.col(n)).alias(rename.get(n, n))
                      for n, _ in INVOICE_FIELDS])


def _padded_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(" "), c.cast("string"), F.lit(" ")))


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, o_orderkey, invoice struct) -- the ground truth."""
    return invoice_columns(spark, sf_dir).select("path", "o_orderkey", invoice_struct().alias("invoice"))


def clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, response, error): every response is the plain JSON record."""
    inv = invoice_columns(spark, sf_dir)
    return inv.select("path", F.to_json(invoice_struct()).alias("response"),
                      F.lit(None).cast("string").alias("error"))


def damaged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, response, error) with the response damaged by `o_orderkey mod 22`."""
    inv = invoice_columns(spark, sf_dir)
    items = F.col("line_items")

    def record(overrides=None, rename=None) -> Column:
        return F.to_json(invoice_struct(overrides, rename), {"ignoreNullFields": "false"})

    def text(value: str) -> Column:
        return F.lit(value)

    def with_items(of) -> Column:
        return record({"line_items": F.transform(items, of)})

    def each_item(*fields):
        return lambda i: F.struct(*[i[f].alias(f) for f, _ in ITEM_FIELDS if f not in dict(fields)],
                                  *[c.alias(f) for f, c in fields if c is not None])

    plain = F.to_json(invoice_struct())
    numeric = F.to_json(invoice_struct({
        **{n: _padded_text(F.col(n)) for n in DOUBLE_HEADER},
        "line_items": F.transform("line_items", lambda i: F.struct(
            i["description"].alias("description"),
            _padded_text(i["quantity"]).alias("quantity"),
            i["unit_price"].alias("unit_price"),
            i["amount"].alias("amount"))),
    }))
    first_has_currency = F.transform(items, lambda i, k: F.struct(
        *[i[f].alias(f) for f, _ in ITEM_FIELDS], F.when(k == 0, F.lit("ITM")).alias("currency")))
    with_sku = F.transform(items, lambda i: F.struct(*[i[f].alias(f) for f, _ in ITEM_FIELDS], F.lit("x").alias("sku")))
    with_po = F.transform(items, lambda i, k: F.struct(*[i[f].alias(f) for f, _ in ITEM_FIELDS], k.alias("sku"),
                                                       F.when(k == 1, F.lit("PO-item")).alias("po_number")))
    texts = F.concat(F.transform(items, lambda i: F.to_json(i)), F.array(F.lit('"loose text"')))
    among = F.regexp_replace(record({"line_items": F.lit("@items@")}), '"@items@"', "@items@")
    modes = {
        0: plain,
        1: F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        2: F.concat(F.lit("```\n"), plain, F.lit("\n```")),
        3: F.concat(F.lit(PROSE_HEAD), plain, F.lit(PROSE_TAIL)),
        4: numeric,
        5: F.to_json(invoice_struct({"invoice_number": F.col("o_orderkey")})),
        6: plain.substr(F.lit(1), (F.length(plain) / 2).cast("int")),
        7: F.to_json(invoice_struct(rename={"vendor_gstin": "vendor_gst", "buyer_gstin": "buyer_gst"})),
        8: record({"line_items": first_has_currency, "subtotal": F.array(F.lit(1))}),
        9: F.replace(among, F.lit("@items@"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))),
        10: with_items(each_item(("description", F.lit(None).cast("string")))),
        11: with_items(each_item(("description", None))),
        12: F.to_json(F.struct(
            *[(with_sku if n == "line_items" else F.col(n)).alias(n) for n, _ in INVOICE_FIELDS],
            F.lit("x").alias("po_number"), F.array(F.lit(1)).alias("pages"))),
        13: record({"subtotal": text("inf"), "tax_amount": text("1e400"), "total": text("NaN")}),
        14: F.concat(F.lit("["), plain, F.lit("]")),
        15: record({"line_items": F.struct(F.lit("x").alias("description"))}),
        16: record({"line_items": text("none listed")}),
        17: record({"subtotal": text("\x1c5")}),
        18: record({"total": text(" 7_1")}),
        20: F.replace(F.replace(F.replace(record({"subtotal": text("@nan@"), "tax_amount": text("@low@"), "total": text("@high@"), "notes": text('NaN, "Infinity')}),
                                          F.lit('"@nan@"'), F.lit("NaN")), F.lit('"@low@"'), F.lit("-Infinity")), F.lit('"@high@"'), F.lit("Infinity")),
        21: F.to_json(F.struct(
            *[(with_po if n == "line_items" else F.col("o_orderkey") if n == "invoice_number" else F.col(n)).alias(n) for n, _ in INVOICE_FIELDS],
            F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")).alias("po_number"), F.array(F.lit(1), F.lit(2)).alias("pages"))),
        19: record({"subtotal": text("\u00a05.5\u2003"), "tax_percent": text("1_0"), "total": F.lit(True)}),
    }
    response = None
    m = F.pmod(F.col("o_orderkey"), F.lit(len(DAMAGE_MODES)))
    for k, c in modes.items():
        response = F.when(m == k, c) if response is None else response.when(m == k, c)
    return inv.select("path", response.alias("response"),
                      F.lit(None).cast("string").alias("error"))


# --- invoice texts --------------------------------------------------------------

def _money(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c))


def _qty(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def invoice_text(odd_lines_only: bool = False, codes_vary: bool = False) -> Column:
    """The invoice fields of `invoice_columns` written out as text in the
    layout that the rule extractor reads; with `odd_lines_only` only items 1, 3, 5, ...
    are written (the others are then ungrounded).  With `codes_vary` the
    currency code stands in the total's line only in every third invoice, in
    a line of its own in the next, and nowhere in the last."""
    items = F.col("line_items")
    if odd_lines_only:
        items = F.filter(items, lambda x, i: i % 2 == 0)
    item_lines = F.transform(items, lambda x: F.concat(
        F.lit("Item "), x["description"], F.lit(" "), _qty(x["quantity"]), F.lit(" x "),
        _money(x["unit_price"]), F.lit(" "), _money(x["amount"])))
    e = lambda c: F.coalesce(c, F.lit(""))
    place = F.pmod(F.col("o_orderkey"), F.lit(3)) if codes_vary else F.lit(0)
    return F.concat_ws(
        "\n",
        F.lit("INVOICE"),
        F.concat(F.lit("No: "), e(F.col("invoice_number"))),
        F.concat(F.lit("Date: "), e(F.col("invoice_date"))),
        F.concat(F.lit("Vendor: "), e(F.col("vendor_name")), F.lit(" GSTIN "), e(F.col("vendor_gstin"))),
        F.concat(F.lit("Bill To: "), e(F.col("buyer_name")), F.lit(" GSTIN "), e(F.col("buyer_gstin"))),
        item_lines,
        F.concat(F.lit("Subtotal "), e(_money(F.col("subtotal")))),
        F.concat(F.lit("GST "), e(F.col("tax_percent").cast("string")), F.lit("% "),
                 e(_money(F.col("tax_amount")))),
        F.when(place == 1, F.concat(F.lit("All amounts in "), F.col("currency"))),
        F.concat(F.lit("Total "), F.when(place == 0, F.concat(e(F.col("currency")), F.lit(" "))).otherwise(""),
                 e(_money(F.col("total")))))


def invoice_texts(spark: SparkSession, sf_dir: str, codes_vary: bool = False) -> DataFrame:
    """(path, o_orderkey, raw_text): each derived invoice written as text."""
    inv = invoice_columns(spark, sf_dir)
    return inv.select("path", "o_orderkey", invoice_text(codes_vary=codes_vary).alias("raw_text"))


def clean_responses_with_text(spark: SparkSession, sf_dir: str, odd_lines_only: bool = False) -> DataFrame:
    """(path, response, error, raw_text): the plain JSON record and the
    invoice text from the same row, so that checks between the two need no
    join."""
    inv = invoice_columns(spark, sf_dir)
    return inv.select("path", F.to_json(invoice_struct()).alias("response"),
                      F.lit(None).cast("string").alias("error"),
                      invoice_text(odd_lines_only).alias("raw_text"))


# --- documents as files -----------------------------------------------------------

# doc_id mod 7 -> file extension; 'txt' is not an accepted upload.
DOC_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff", "PDF", "txt"]


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table shaped like the binaryFile source (text as UTF-8
    bytes), plus doc_id, lang and the text itself."""
    d = table(spark, sf_dir, "documents")
    exts = F.array(*[F.lit(x) for x in DOC_EXTENSIONS])
    ext = F.element_at(exts, (F.pmod(F.col("doc_id"), F.lit(len(DOC_EXTENSIONS))) + 1).cast("int"))
    content = F.encode(F.col("text"), "UTF-8")
    return d.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.octet_length(F.col("text")).cast("long").alias("length"),
        content.alias("content"),
        "doc_id", "lang", "text")
