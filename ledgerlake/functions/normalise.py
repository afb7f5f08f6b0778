"""Opt-in cleaners for extracted values (N1, N2, N4, N5).  Off by default:
validation rejects the raw forms these accept (`clean=True` there lets N1 in)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INVOICE_FIELDS

# Date layouts tried in order; day/month order is explicit in each.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd",
                "dd.MM.yyyy", "yyyyMMdd"]

_CURRENCY_PREFIX = r"^\s*(?:[A-Z]{3}\s*|[$€£₹¥]\s*)?"


def number_text(s: Column) -> Column:
    """Amount text without its currency code or sign, thousands commas,
    percent sign and spaces."""
    return F.regexp_replace(F.regexp_replace(s, _CURRENCY_PREFIX, ""), r"[,%\s]", "")


def clean_number(s: Column) -> Column:
    """Amount text with a currency code or sign, thousands commas, a percent
    sign or spaces -> double (N1)."""
    return number_text(s).try_cast("double")


def iso_date(s: Column, formats=None) -> Column:
    """Date text in any of `formats` -> 'YYYY-MM-DD' (N2)."""
    t = F.trim(s)
    parsed = F.coalesce(*[F.try_to_date(t, f) for f in (formats or DATE_FORMATS)])
    return F.date_format(parsed, "yyyy-MM-dd")


def one_line_address(s: Column) -> Column:
    """Multi-line address -> one line, parts joined by ', ' (N4)."""
    parts = F.transform(F.split(s, r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: x != F.lit("")), ", ")


def unknown_to_null(s: Column) -> Column:
    """Blank text -> NULL."""
    return F.nullif(F.trim(s), F.lit(""))


def clean_invoice(invoice: Column) -> Column:
    """The string fields of a record cleaned: dates (kept as they are where no
    layout fits), addresses, blanks (N2, N4, N5)."""
    fields = []
    for n, kind in INVOICE_FIELDS:
        c = invoice[n]
        if n.endswith("_date"):
            c = F.coalesce(iso_date(c), unknown_to_null(c))
        elif n.endswith("_address"):
            c = F.nullif(one_line_address(c), F.lit(""))
        elif kind == "string":
            c = unknown_to_null(c)
        fields.append(c.alias(n))
    return F.when(invoice.isNotNull(), F.struct(*fields))


def words(c: Column) -> Column:
    """The words of a text (runs of letters and digits) in lower case, with one blank before and after each (N6); a
    text without words is one blank, which every text holds."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), r"[^\p{L}\p{M}\p{N}]+", " ")


def numbers(c: Column) -> Column:
    """The numbers of a text as doubles, digits grouped by commas or not."""
    found = F.regexp_extract_all(c, F.lit(r"-?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(F.array_distinct(found), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
