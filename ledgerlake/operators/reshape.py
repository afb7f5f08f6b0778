"""Validated records -> header, line-item, flat and long tables, and KPIs.

All of these are narrow: projections and (pos)explode of the per-record item
array, so they run where the records are, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import validate as V
from ..schema import DOUBLE_HEADER, FIELD_ALIASES, FLAT_HEADER_ORDER, FLAT_ITEM_ORDER, HEADER_FIELDS


def _keys(df: DataFrame, keys) -> list[str]:
    return [k for k in (keys or ["path"]) if k in df.columns]


def _answered(df: DataFrame) -> DataFrame:
    """Drop records whose model call failed.  Tested on the cheap `error`
    column when present: a filter on `json_status` would be pushed below the
    repair projections and repeat the JSON parse inside the filter."""
    if "error" in df.columns:
        return df.filter(F.col("error").isNull())
    if "json_status" in df.columns:
        return df.filter(F.col("json_status") != "api_error")
    return df


def header_table(df: DataFrame, keys=None) -> DataFrame:
    """One row per record: keys + the header fields (all but line_items)."""
    k = _keys(df, keys)
    return df.select(*k, *[F.col("invoice." + n).alias(n) for n, _ in HEADER_FIELDS])


def unknown_columns(df: DataFrame, most: int = 1000) -> list[str]:
    """Keys of invalid records that no field has (F6): those of records first,
    then those of items only, each in alphabetical order.

    The distinct names go through the driver; more than `most` of them are an
    error, since they would be columns.
    """
    known = [*FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER, *FIELD_ALIASES.values(), "line_items"]
    # One array a record, exploded as it is: a filter on `valid` or an inner explode would carry the whole validation
    # into a filter (see `items_table`).
    tagged = lambda of: lambda names: F.coalesce(F.transform(names, lambda n: F.struct(F.lit(of).alias("of"), n.alias("name"))),
                                                 F.array().cast("array<struct<of:int,name:string>>"))
    rows = _answered(df).select(F.when(~F.col("valid"), F.col("raw")).alias("raw"))
    rows = rows.select(F.map_keys(_keyed(F.col("raw"))).alias("keys"), V.as_array(V.member(F.col("raw"), "line_items")).alias("items"))
    rows = rows.select("keys", F.flatten(F.transform("items", lambda i: F.coalesce(F.map_keys(_keyed(i)), F.array().cast("array<string>")))).alias("item_keys"))
    rows = rows.select(F.explode_outer(F.concat(tagged(0)(F.col("keys")), tagged(1)(F.array_distinct("item_keys")))).alias("k")).select("k.of", "k.name")
    found = (rows.filter(F.col("name").isNotNull() & ~F.col("name").isin(known)).groupBy("name").agg(F.min("of").alias("of"))
             .orderBy("of", "name").limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} unknown keys")
    return [r.name for r in found]


def _keyed(v: Column) -> Column:
    """An object variant as a map, NULL for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _shown(v: Column) -> Column:
    """Text of any JSON value: texts as they are, null as NULL, the rest as JSON."""
    return F.when(~F.is_variant_null(v), F.when(V.vtype(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def _header_values(item: Column) -> Column:
    """The header keys of an item variant, read all at once: per key a struct
    with the fitting value, NULL where the item has no such key."""
    def read(x: Column) -> Column:
        fields = []
        for n in FLAT_HEADER_ORDER:
            v = x[n]
            fit = V.number_fit(v, V.vtype(v)) if n in DOUBLE_HEADER else V.string_value(v, V.vtype(v))
            fields.append(F.when(v.isNotNull(), F.struct(fit.alias("value"))).alias(n))
        return F.struct(*fields)

    return F.element_at(F.transform(F.array(F.try_variant_get(item, "$", V.object_fields_type(FLAT_HEADER_ORDER))), read), 1)


def flat_table(df: DataFrame, keys=None, with_line_no: bool = False, unknown: list[str] | None = None) -> DataFrame:
    """One row per line item with the header repeated; a record without items
    gives one header-only row.

    Column order: keys, header fields, `extras`, item fields.  For an invalid
    record, an item that holds a header key overrides that header value in its
    own row (even with null), and a non-object item gives a row with NULL item
    columns.  Records whose model call failed are left out.

    `unknown` names further keys (see `unknown_columns`): each becomes a text
    column in place of `extras`, with the item's value where the item has the
    key (even null), else the record's.  Only invalid records have any.  A
    key that differs from another column in case only gets a `_` behind it.
    """
    k = _keys(df, keys)
    names = {f"_u{i}": n for i, n in enumerate(unknown or [])}
    shown, used = {}, {c.lower() for c in (*k, *FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER, "line_no")}
    for u, n in names.items():
        while n.lower() in used:
            n += "_"
        shown[u] = n
        used.add(n.lower())
    # Items and, for invalid records, the header values that their raw items
    # hold, side by side in one array: the explode then copies the header to
    # each row but neither the invoice nor the raw record, and only items of
    # invalid records are looked into.
    raw_items = F.coalesce(F.when(~F.col("valid"), V.as_array(V.member(F.col("raw"), "line_items"))),
                           F.array().cast("array<variant>"))
    both = F.zip_with("invoice.line_items", raw_items, lambda i, r: F.struct(
        i.alias("item"), F.when(r.isNotNull(), _header_values(r)).alias("held"), *([r.alias("raw")] if names else [])))
    ex = _answered(df).select(*k, "valid", "extras", *[F.col("invoice." + n).alias(n) for n in FLAT_HEADER_ORDER],
                              *[_shown(F.element_at(_keyed(F.when(~F.col("valid"), F.col("raw"))), n)).alias(u) for u, n in names.items()],
                              both.alias("_both"))
    ex = ex.select(*k, "valid", "extras", *FLAT_HEADER_ORDER, *names, F.posexplode_outer("_both").alias("_pos", "_x"))
    if names:
        ex = ex.withColumn("_item_keys", _keyed(F.col("_x.raw")))
        ex = ex.withColumns({u: F.when(F.map_contains_key("_item_keys", n), _shown(F.element_at("_item_keys", n))).otherwise(F.col(u))
                             for u, n in names.items()})
    cols = [F.col(c) for c in k]
    for n in FLAT_HEADER_ORDER:
        held = F.col("_x.held." + n)
        cols.append(F.when(held.isNotNull(), held["value"]).otherwise(F.col(n)).alias(n))
    cols += [F.col("extras")] if unknown is None else [F.col(u).alias(n) for u, n in shown.items()]
    cols += [F.col("_x.item." + n).alias(n) for n in FLAT_ITEM_ORDER]
    if with_line_no:
        cols.append((F.col("_pos") + F.lit(1)).alias("line_no"))
    return ex.select(*cols)


def items_table(df: DataFrame, keys=None, with_line_no: bool = False, with_raw: bool = False,
                text: str | None = None) -> DataFrame:
    """One row per line item, the four item columns; records without items
    give no row.

    `with_raw` adds `item_raw`, the item of an invalid record with all its
    keys as a VARIANT (NULL for valid records).  `text` names a column with
    the document's text and adds `grounded`, whether it holds the words of the
    item's description in their order, however they are broken over lines and
    marked off, and `numbers_grounded`, whether it holds each of the item's
    numbers; both are decided inside the item array, so the text is not
    copied to every item.

    The explode is an outer one followed by a filter on its output: an inner
    explode makes the optimizer infer `size(items) > 0` and push that copy of
    the whole validation expression below the projections.
    """
    k = _keys(df, keys)
    df = _answered(df)
    items, extra = F.col("invoice.line_items"), []
    if with_raw:
        raw = F.coalesce(F.when(~F.col("valid"), V.as_array(V.member(F.col("raw"), "line_items"))),
                         F.array().cast("array<variant>"))
        items = F.zip_with(items, raw, lambda i, r: F.struct(*[i[n].alias(n) for n in FLAT_ITEM_ORDER], r.alias("item_raw")))
        extra.append("item_raw")
    if text:
        # The one-element array holds the text's words and numbers, so that they are made once a record.
        made = F.array(F.struct(N.words(F.col(text)).alias("words"), N.numbers(F.col(text)).alias("numbers")))
        items = F.element_at(F.transform(made, lambda t: F.transform(items, lambda i: F.struct(
            *[i[n].alias(n) for n in FLAT_ITEM_ORDER + extra],
            F.contains(t["words"], N.words(i["description"])).alias("grounded"),
            F.forall(F.array(i["quantity"], i["unit_price"], i["amount"]),
                     lambda x: x.isNull() | F.array_contains(t["numbers"], x)).alias("numbers_grounded")))), 1)
        extra += ["grounded", "numbers_grounded"]
    ex = (df.select(*k, F.posexplode_outer(items).alias("_pos", "_item"))
            .filter(F.col("_pos").isNotNull()))
    cols = [F.col(c) for c in k] + [F.col("_item." + n).alias(n) for n in FLAT_ITEM_ORDER + extra]
    if with_line_no:
        cols.append((F.col("_pos") + F.lit(1)).alias("line_no"))
    return ex.select(*cols)


def double_text(c: Column) -> Column:
    """Text of a double as Python's `str(float)` writes it: plain decimals for
    1e-4 <= |x| < 1e16, else `1.5e-05` / `1e+16` (Spark writes `1.5E-5`,
    and `1.23456789E7` where Python writes `12345678.9`)."""
    s = c.cast("string")
    # 38 digits with 21 after the point hold 17 significant digits anywhere
    # in [1e-4, 1e16); the digits are those of Spark's own text.
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"),
                                              "0+$", ""), r"\.$", ".0")
    in_range = (F.abs(c) >= F.lit(1e-4)) & (F.abs(c) < F.lit(1e16))
    mant = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(s, r"E(-?)([0-9]+)$", 2)
    sign = F.when(F.regexp_extract(s, r"E(-?)", 1) == "-", F.lit("-")).otherwise(F.lit("+"))
    sci = F.concat(mant, F.lit("e"), sign, F.lpad(exp, 2, "0"))
    return (F.when(s.contains("E") & in_range, plain)
             .when(s.contains("E"), sci)
             .otherwise(s))


def header_long(df: DataFrame, keys=None) -> DataFrame:
    """Header as (Field, Value) pairs: 15 rows per record, values as text."""
    k = _keys(df, keys)
    vals = []
    for n, kind in HEADER_FIELDS:
        c = F.col("invoice." + n)
        vals.append((double_text(c) if n in DOUBLE_HEADER else c).alias(n))
    wide = df.select(*k, *vals)
    return wide.unpivot(k, [n for n, _ in HEADER_FIELDS], "Field", "Value")


def kpis(df: DataFrame, keys=None) -> DataFrame:
    """Per record: line-item count (0 if none), subtotal, tax %, total."""
    k = _keys(df, keys)
    return df.select(
        *k,
        (F.col("n_items") if "n_items" in df.columns
         else F.coalesce(F.size("invoice.line_items"), F.lit(0))).alias("line_items_count"),
        F.col("invoice.subtotal").alias("subtotal"),
        F.col("invoice.tax_percent").alias("tax_percent"),
        F.col("invoice.total").alias("total"))


def status_counts(df: DataFrame) -> DataFrame:
    """Records per (json_status, valid): the batch's success line, counting a
    failed model call as failed."""
    return df.groupBy("json_status", "valid").agg(F.count(F.lit(1)).alias("records"))
