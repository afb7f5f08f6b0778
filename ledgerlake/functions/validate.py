"""JSON value -> typed invoice record (V1-V10), as native column expressions.

Every field is type-tested with `schema_of_variant` before it is read, since
Spark's casts are both looser (`'1f'` -> 1.0, 5 -> `'5'`) and stricter
(`'1_000'` -> NULL) than the record rules:

* float field: absent, null, number, boolean or numeric text (surrounding
  white space or single inner underscores, sign, exponent, `.5`, `5.`);
  `inf`/`nan` (and overflow) validate but are written as null;
* string field: absent, null or string -- a number is an error;
* item `description`: absent gives `""`; null is an error;
* `line_items`: absent gives []; otherwise an array of objects;
* the top level must be an object; unknown keys are dropped.

One bad field makes the whole record invalid (all or nothing).  Invalid
records keep every field whose JSON type fits its column (numbers for
doubles, strings for strings), read under the field's own name, and carry the
whole value in `extras`.

The helpers take a field's variant `v`, its type name `t` (NULL = absent,
'VOID' = JSON null) and, for float fields, its trimmed text `s`; the
DataFrame operator (`operators.extract.validate_records`) computes those
once per field in their own projection, so the expression trees stay small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ITEM_FIELDS, LINE_ITEM_TYPE
from .repair import WHITE_SPACE

NUMBER_TEXT = r"^(?!_)(?!.*__)(?!.*_$)[+-]?([0-9_]+(\.[0-9_]*)?|\.[0-9_]+)([eE][+-]?[0-9_]+)?$"
NONFINITE_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"

ITEMS_TYPE = "array<" + LINE_ITEM_TYPE.simpleString() + ">"


def member(v: Column, key: str) -> Column:
    """The value under `key` of an object variant (NULL when absent)."""
    return F.try_variant_get(v, "$." + key, "variant")


def vtype(v: Column) -> Column:
    """JSON type of a variant: NULL = absent, 'VOID' = JSON null."""
    return F.schema_of_variant(v)


def number_text(s: Column) -> Column:
    """A text as the number rules read it: without surrounding Unicode white
    space (the separators 0x1c-0x1f are none), but as it is if it holds an
    underscore, since underscores and padding do not go together."""
    return F.when(F.contains(s, F.lit("_")), s).otherwise(F.trim(s, F.lit(WHITE_SPACE)))


def text_of(v: Column, t: Column, clean=None) -> Column:
    """Number text of a string variant (NULL for other types), cleaned first
    where a cleaner is given."""
    s = F.when(t == "STRING", F.try_variant_get(v, "$", "string"))
    return number_text(clean(s) if clean else s)


def is_number(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def finite(d: Column) -> Column:
    """NaN and +-infinity are written as null."""
    return F.when(~(F.isnan(d) | (F.abs(d) == F.lit(float("inf")))), d)


def _all(cols) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out & c)
    return F.coalesce(out, F.lit(False))


def float_ok(t: Column, s: Column) -> Column:
    text_ok = s.rlike(NUMBER_TEXT) | s.rlike(NONFINITE_TEXT)
    ok = t.isNull() | t.isin("VOID", "BOOLEAN") | is_number(t) | ((t == "STRING") & text_ok)
    return F.coalesce(ok, F.lit(False))


def float_value(v: Column, t: Column, s: Column) -> Column:
    """Lax float value of a field that passed `float_ok`."""
    from_text = F.when(s.rlike(NUMBER_TEXT), F.regexp_replace(s, "_", "").try_cast("double"))
    d = (F.when(is_number(t), F.try_variant_get(v, "$", "double"))
         .when(t == "BOOLEAN",
               F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
         .when(t == "STRING", from_text))
    return finite(d)


def number_fit(v: Column, t: Column) -> Column:
    """Double value of a field of an invalid record: JSON numbers only."""
    return finite(F.when(is_number(t), F.try_variant_get(v, "$", "double")))


def string_ok(t: Column) -> Column:
    return F.coalesce(t.isNull() | t.isin("VOID", "STRING"), F.lit(False))


def string_value(v: Column, t: Column) -> Column:
    return F.when(t == "STRING", F.try_variant_get(v, "$", "string"))


def is_object_type(t: Column) -> Column:
    return F.coalesce(t.startswith("OBJECT"), F.lit(False))


def is_array_type(t: Column) -> Column:
    return F.coalesce(t.startswith("ARRAY"), F.lit(False))


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


# --- line items -------------------------------------------------------------
# The item array is read in one cast to an array of structs of variants: a
# non-object element becomes a NULL struct.  A second transform adds each
# field's type and text; the checks and values read those.

_ITEM_KEYS = tuple(n for n, _ in ITEM_FIELDS)
_ITEM_FLOATS = tuple(n for n, t in ITEM_FIELDS if t == "double")
ITEM_VARIANTS = "array<struct<" + ",".join(f"{k}:variant" for k in _ITEM_KEYS) + ">>"


def object_fields_type(keys) -> str:
    """Target type that reads the listed keys of an object as variants."""
    return "struct<" + ",".join(f"`{k}`:variant" for k in keys) + ">"


def items_typed(items: Column, clean=None) -> Column:
    """Each item with its field types, then with the number texts of those."""
    def types(x: Column) -> Column:
        return F.struct(F.when(x.isNull(), F.lit("OTHER")).otherwise(F.lit("OBJECT")).alias("t"),
                        *[x[k].alias(k) for k in _ITEM_KEYS], *[vtype(x[k]).alias(k + "_t") for k in _ITEM_KEYS])

    def texts(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), *[x[k].alias(k) for k in _ITEM_KEYS], *[x[k + "_t"].alias(k + "_t") for k in _ITEM_KEYS],
                        *[text_of(x[k], x[k + "_t"], clean).alias(k + "_s") for k in _ITEM_FLOATS])

    return F.transform(F.transform(items, types), texts)


def item_ok(x: Column) -> Column:
    dt = x["description_t"]
    checks = [x["t"] == F.lit("OBJECT"), F.coalesce(dt.isNull() | (dt == "STRING"), F.lit(False))]
    checks += [float_ok(x[k + "_t"], x[k + "_s"]) for k in _ITEM_FLOATS]
    return _all(checks)


def item_value(x: Column) -> Column:
    """Typed item of a valid record."""
    return F.struct(
        F.coalesce(string_value(x["description"], x["description_t"]), F.lit("")).alias("description"),
        *[float_value(x[k], x[k + "_t"], x[k + "_s"]).alias(k) for k in _ITEM_FLOATS])


def item_fit(x: Column) -> Column:
    """Item of an invalid record: fitting fields, NULL for a non-object."""
    return F.when(x["t"] == F.lit("OBJECT"), F.struct(
        string_value(x["description"], x["description_t"]).alias("description"),
        *[number_fit(x[k], x[k + "_t"]).alias(k) for k in _ITEM_FLOATS]))


def all_of(cols) -> Column:
    return _all(cols)


# --- fast path ----------------------------------------------------------------
# Most model answers already have every field in its JSON type.  For those,
# one schema string decides validity and one typed cast reads the values;
# only the other records go through the per-field path.  The schema string
# merges array elements, which hides JSON nulls among the items (a null item,
# a null description); those two cases are checked on the item structs.

_NUM_T = r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|VOID)"


def _members(types: dict[str, str]) -> str:
    """Pattern of an object's type whose members are all among `types`.  The
    type names them in alphabetical order, so each is looked for once."""
    return "OBJECT<" + "".join(f"(?:{k}: {t}(?:, |(?=>)))?" for k, t in sorted(types.items())) + ">"


def _fast_schema_regex(string_keys, double_keys) -> str:
    item = _members({"description": "STRING"} | {k: _NUM_T for k in _ITEM_FLOATS})
    # ARRAY<VOID> is [] (or [null, ...], which the hidden-null check rejects)
    items = "(?:ARRAY<VOID>|ARRAY<" + item + ">)"
    return "^" + _members({k: "(?:STRING|VOID)" for k in string_keys} | {k: _NUM_T for k in double_keys} | {"line_items": items}) + "$"


def fast_type(string_keys, double_keys) -> str:
    """Target type of the typed cast of a fast-path record."""
    cols = [f"`{k}`:string" for k in string_keys] + [f"`{k}`:double" for k in double_keys]
    cols.append("line_items:" + ITEMS_TYPE)
    return "struct<" + ",".join(cols) + ">"


def fast_shape(schema: Column, string_keys, double_keys) -> Column:
    """Whether a record's schema string allows the typed cast."""
    return F.coalesce(schema.rlike(_fast_schema_regex(string_keys, double_keys)), F.lit(False))


def plain_numbers(schema: Column) -> Column:
    """Whether no number of the record is written with an exponent (or as a
    bare constant, or with more digits than a decimal holds)."""
    return ~(schema.contains("DOUBLE") | schema.contains("FLOAT"))


def typed_text(text: Column, string_keys, double_keys) -> Column:
    """The typed cast of a fast-path record of plain numbers, parsed from its
    text: casting the variant costs several times as much per value.  Only
    here a number may be a negative zero, which a variant writes as zero."""
    return F.from_json(text, fast_type(string_keys, double_keys), {"maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1)})


def fast_number(d: Column, from_text: Column) -> Column:
    """A number of a fast-path record.  Plain numbers in a text are finite."""
    return F.when(from_text, d + F.lit(0.0)).otherwise(finite(d))


def fast_ok(shape: Column, typed: Column, raw: Column) -> Column:
    """Whether a record can be read by its typed cast alone.  A null among the
    cast descriptions may be an absent one or a hidden null: only then the
    items are read again to tell which."""
    missing = F.exists(typed["line_items"], lambda x: x["description"].isNull())
    descs = F.try_variant_get(raw, "$.line_items", "array<struct<description:variant>>")
    no_hidden_null = F.coalesce(F.forall(descs, lambda x: x.isNotNull()
                                         & ~F.coalesce(F.is_variant_null(x["description"]), F.lit(False))),
                                F.lit(True))
    return shape & F.when(missing, no_hidden_null).otherwise(F.lit(True))


def fast_items(items: Column, from_text: Column) -> Column:
    return F.transform(items, lambda x: F.struct(
        F.coalesce(x["description"], F.lit("")).alias("description"),
        *[fast_number(x[k], from_text).alias(k) for k in _ITEM_FLOATS]))
