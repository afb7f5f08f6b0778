"""Model responses -> repaired JSON -> validated invoice records.

Both stages are narrow projections of native expressions: no shuffle, no
Python worker, so they scale with the number of partitions of the input.
Each stage is a short chain of projections whose intermediate columns are
used several times; Catalyst keeps such columns computed once instead of
inlining them, which keeps both the plans and the per-row work small.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import repair as R
from ..functions import validate as V
from ..schema import FIELD_ALIASES, HEADER_FIELDS

_TMP = "__ll_"


def _drop_tmp(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(_TMP)])


def repair_responses(df: DataFrame, response: str = "response",
                     error: str | None = "error", text: str | None = None) -> DataFrame:
    """Add `json_status` (ok, sliced, empty, api_error) and `raw` (VARIANT),
    and under the name `text` the JSON text that `raw` was parsed from (NULL
    for the empty object).

    A row whose model call failed (`error` not NULL) gets `api_error` and the
    empty object.  The slice is parsed only when the whole text did not parse.
    """
    failed = F.col(error).isNotNull() if error and error in df.columns else F.lit(False)
    t = _TMP
    s1 = df.withColumn(t + "failed", failed).withColumn(
        t + "text", R.response_text(F.col(response)))
    s2 = s1.withColumn(t + "w1", R.wrapped_parse(F.col(t + "text")))
    s3 = s2.withColumn(t + "direct", R.wrapped_value(F.col(t + "w1")))
    s3 = s3.withColumn(t + "slice", F.when(F.col(t + "direct").isNull(), R.brace_slice(F.col(t + "text"))))
    s4 = s3.withColumn(t + "w2", R.wrapped_parse(F.col(t + "slice")))
    s5 = s4.withColumn(t + "sliced", R.wrapped_value(F.col(t + "w2")))
    direct, sliced, bad = F.col(t + "direct"), F.col(t + "sliced"), F.col(t + "failed")
    out = (s5.withColumn("json_status", R.status_of(bad, direct, sliced))
             .withColumn("raw", F.when(bad, R.empty_object())
                         .otherwise(F.coalesce(direct, sliced, R.empty_object()))))
    if text:
        parsed = F.when(direct.isNotNull(), F.col(t + "text")).when(sliced.isNotNull(), F.col(t + "slice"))
        return out.select(*[c for c in out.columns if not c.startswith(_TMP)], F.when(~bad, parsed).alias(text))
    return _drop_tmp(out)


# Members of a record that takes the slow path, in two structs that are NULL
# for the others: variants and types, then number texts and items.
_READ, _MORE = _TMP + "read", _TMP + "more"


def _v(k):
    return f"{_READ}.v_{k}"


def _t(k):
    return f"{_READ}.t_{k}"


def _s(k):
    return f"{_MORE}.s_{k}"


@lru_cache(maxsize=16)
def _validation_stages(app: str, strict_alias, raw: str, has_status: bool, clean: bool, text: str | None = None) -> list[dict]:
    """The projections of `validate_records`, as lists of named columns.

    They are unresolved, name-based expressions that belong to no session or
    table, so the few option sets are built once a JVM (`app`) and reused
    (building them is hundreds of JVM calls)."""
    cleaner = N.number_text if clean else None
    header = [n for n, _ in HEADER_FIELDS]
    doubles = [n for n, k in HEADER_FIELDS if k == "double"]
    scalars = header + list(FIELD_ALIASES.values())
    strings = [n for n, k in HEADER_FIELDS if k == "string"] + list(FIELD_ALIASES.values())
    col = F.col
    shape, fast, typed, obj = _TMP + "shape", _TMP + "fast", _TMP + "typed", _TMP + "obj"
    stages = []
    # 0: fast path -- every known field already in its JSON type.
    kind_of = _TMP + "schema"
    stages.append({kind_of: V.vtype(col(raw))})
    stages.append({shape: V.fast_shape(col(kind_of), strings, doubles)})
    cast = F.try_variant_get(col(raw), "$", V.fast_type(strings, doubles))
    from_text = F.lit(False)
    if text:
        from_text = col(_TMP + "from_text")
        stages[-1][_TMP + "from_text"] = F.coalesce(col(text).isNotNull() & V.plain_numbers(col(kind_of)), F.lit(False))
        cast = F.when(from_text, V.typed_text(col(text), strings, doubles)).otherwise(cast)
    stages.append({typed: F.when(col(shape), cast)})
    stages.append({fast: V.fast_ok(col(shape), col(typed), col(raw))})
    stages.append({
        # 1: other records read once as a struct of variants (NULL: not an object).
        obj: F.when(~col(fast), F.try_variant_get(
            col(raw), "$", V.object_fields_type(scalars + ["line_items"]))),
    })
    # 2: member types; the item list as an array of item structs.
    li = col(obj + ".line_items")

    def slow(members):
        return F.when(~col(fast), F.struct(*[c.alias(n) for n, c in members.items()]))

    read = {"v_" + k: col(f"{obj}.`{k}`") for k in scalars}
    read.update({"t_" + k: V.vtype(col(f"{obj}.`{k}`")) for k in scalars})
    read["ie"] = F.try_variant_get(li, "$", V.ITEM_VARIANTS)
    read["li0"] = F.when(li.isNull(), F.lit(None)).when(F.is_variant_null(li), F.lit("VOID"))
    stages.append({_READ: slow(read)})
    ie = col(_READ + ".ie")
    more = {"s_" + k: V.text_of(col(_v(k)), col(_t(k)), cleaner) for k in doubles}
    more["t_line_items"] = (F.when(ie.isNotNull(), F.lit("ARRAY"))
                            .when(li.isNotNull(), F.coalesce(col(_READ + ".li0"), F.lit("OTHER"))))
    more["it"] = V.items_typed(ie, cleaner)
    stages.append({_MORE: slow(more),
                   "n_items": F.coalesce(F.when(col(fast), F.size(col(typed + ".line_items"))).otherwise(F.size(ie)), F.lit(0))})
    # 4: per-field checks and the record flag.  Strict reading of the tax ids
    # looks at the alias key alone, so it only drops checks.
    checks, own_checks = [col(obj).isNotNull()], []
    good, good_strict, fit = {}, {}, {}
    for n, kind in HEADER_FIELDS:
        v, t = col(_v(n)), col(_t(n))
        if n in FIELD_ALIASES:
            a = FIELD_ALIASES[n]
            av, at = col(_v(a)), col(_t(a))
            checks.append(V.string_ok(at))
            own_checks.append(V.string_ok(t))
            good_strict[n] = V.string_value(av, at)
            good[n] = F.coalesce(good_strict[n], V.string_value(v, t))
            fit[n] = V.string_value(v, t)
        elif kind == "string":
            checks.append(V.string_ok(t))
            good[n] = fit[n] = V.string_value(v, t)
        else:
            s = col(_s(n))
            checks.append(V.float_ok(t, s))
            good[n] = V.float_value(v, t, s)
            fit[n] = V.number_fit(v, t)
    it = col(_MORE + ".it")
    items_t = col(_MORE + ".t_line_items")
    checks.append(items_t.isNull()
                  | ((items_t == "ARRAY") & F.coalesce(F.forall(it, V.item_ok), F.lit(False))))
    api_error = (col("json_status") == "api_error") if has_status else F.lit(False)
    stages.append({_TMP + "strict_ok": F.when(~col(fast), V.all_of(checks))})

    def flag(ok):
        return F.when(api_error, F.lit(False)).when(col(fast), F.lit(True)).otherwise(ok)

    lax_ok = col(_TMP + "strict_ok") & V.all_of(own_checks)
    flags = {"valid": flag(col(_TMP + "strict_ok") if strict_alias is True else lax_ok)}
    if strict_alias == "both":
        flags["valid_strict"] = flag(col(_TMP + "strict_ok"))
    stages.append(flags)
    # 5: the record.
    none = F.array().cast(V.ITEMS_TYPE)
    valid = col("valid")
    both = {}
    for n, alias in FIELD_ALIASES.items():
        a = col(f"{typed}.`{alias}`")
        strict = F.when(col(fast), a).otherwise(good_strict[n])
        lax = F.when(col(fast), F.coalesce(a, col(f"{typed}.`{n}`"))).otherwise(good[n])
        good[n] = strict if strict_alias is True else lax
        if strict_alias == "both":
            both[n + "_strict"] = F.when(col("valid_strict"), strict).otherwise(fit[n])
    fields = []
    for n, kind in HEADER_FIELDS:
        if n == "notes":
            fields.append(F.when(col(fast), F.coalesce(V.fast_items(col(typed + ".line_items"), from_text), none))
                          .when(valid, F.coalesce(F.transform(it, V.item_value), none))
                          .otherwise(F.coalesce(F.transform(it, V.item_fit), none)).alias("line_items"))
        if n in FIELD_ALIASES:
            value = F.when(valid, good[n]).otherwise(fit[n])
        else:
            t_val = col(f"{typed}.`{n}`")
            t_val = V.fast_number(t_val, from_text) if kind == "double" else t_val
            value = F.when(col(fast), t_val).when(valid, good[n]).otherwise(fit[n])
        fields.append(value.alias(n))
    stages.append({"invoice": F.struct(*fields), "extras": F.when(~valid, col(raw)), **both})
    return stages


def validate_records(df: DataFrame, strict_alias: bool | str = False,
                     raw: str = "raw", clean: bool = False, text: str | None = None) -> DataFrame:
    """Add `valid`, the typed `invoice` struct, `n_items` and `extras` (the
    whole raw value of an invalid record, NULL otherwise).

    With `strict_alias=False` (default) the tax ids are read under their alias
    key and under their field name (alias first); `strict_alias=True` reads
    the alias key only; `strict_alias="both"` reads as by default and adds
    `valid_strict` and `<tax id>_strict` in the same pass.  A record whose
    model call failed (`api_error`) is not validated: `valid` is false.

    With `clean=True` numbers in texts may carry currency signs and codes,
    thousands commas and percent signs (N1), which the rules else reject.

    Records whose known fields already have their JSON types take a fast
    path (one schema string, one typed cast, or one typed parse of the text
    that `raw` came from where `text` names that column, which is dropped);
    the others are read field by
    field.  Each stage is one projection.
    """
    app = df.sparkSession.sparkContext.applicationId
    out = df
    for stage in _validation_stages(app, strict_alias, raw, "json_status" in df.columns, clean, text):
        out = out.withColumns(stage)
    return _drop_tmp(out.drop(text) if text else out)


def extract_records(df: DataFrame, strict_alias: bool | str = False, response: str = "response",
                    error: str | None = "error", clean: bool = False) -> DataFrame:
    """repair + validate."""
    text = _TMP + "json"
    return validate_records(repair_responses(df, response, error, text), strict_alias, clean=clean, text=text)
