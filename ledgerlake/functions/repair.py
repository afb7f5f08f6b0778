"""Response text -> JSON value (R1-R5), as native column expressions.

Each step is reached only when the one before fails:
trim -> unfence -> strict parse -> parse the first-'{'..last-'}' slice -> {}.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, and whitespace as a Python `str.strip()` sees it: these
# plus the four information separators 0x1c-0x1f.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xe), 0x20, 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
_EDGE_SPACE = WHITE_SPACE + "\x1c\x1d\x1e\x1f"

FENCE = "```"

# Marks the end in the strict parse.  Random per driver process, so that no
# response can contain it; it is a literal inside the plan, so every executor
# sees the same text.
_END = "e" + uuid.uuid4().hex

STATUS_OK = "ok"
STATUS_SLICED = "sliced"
STATUS_EMPTY = "empty"
STATUS_API_ERROR = "api_error"


def py_strip(c: Column) -> Column:
    """Trim leading/trailing whitespace the way Python's `str.strip()` does.
    Only the ends are looked at: a pattern for them would try every character."""
    return F.trim(c, F.lit(_EDGE_SPACE))


def response_text(c: Column) -> Column:
    """A response trimmed and without its fence.  One that already runs from
    brace to brace has neither; trimming would still walk all of it."""
    return F.when(c.startswith("{") & c.endswith("}"), c).otherwise(unfence(py_strip(c)))


def unfence(c: Column) -> Column:
    """A text that starts with a fence: keep what lies between the first two
    fences (or after the first one when unclosed), trimmed."""
    inner = F.split(c, FENCE, 3).getItem(1)
    return F.when(c.startswith(FENCE), py_strip(inner)).otherwise(c)


# A bare constant that a lenient JSON parser reads as a number, by itself.
_CONSTANT = r"(?:(?<![\w.+-])NaN|(?<![\w.+])Infinity)(?![\w.+-])"
# What precedes the next such constant: plain text and whole strings.  Possessive, so long texts need no stack.
_UP_TO_CONSTANT = rf'(?s)\G(?<before>(?:[^"NI]++|"(?:[^"\\]++|\\.)*+"|(?!{_CONSTANT})[NI])*+){_CONSTANT}'


def bare_constants(c: Column) -> Column:
    """`NaN`, `Infinity` and `-Infinity` outside strings written as a number
    beyond double range, which is read as infinite: numeric fields take it and
    come out null, text fields reject it, as with the constants themselves."""
    return F.when(c.contains("NaN") | c.contains("Infinity"), F.regexp_replace(c, _UP_TO_CONSTANT, "${before}1e999")).otherwise(c)


def wrapped_parse(c: Column) -> Column:
    """Parse `c` wrapped as `[c, "<end>"]` (NULL on a syntax error).

    `try_parse_json` stops after the first complete value and ignores the
    rest, so the text is wrapped: any trailing text then either breaks the
    syntax or moves the end mark from its place.  Check the result with
    `wrapped_value`.
    """
    return F.try_parse_json(F.concat(F.lit("["), bare_constants(c), F.lit(',"%s"]' % _END)))


def wrapped_value(w: Column) -> Column:
    """The value of a `wrapped_parse` result if the whole text was one JSON
    value (the end mark directly follows it)."""
    ok = F.coalesce(F.try_variant_get(w, "$[1]", "string") == F.lit(_END), F.lit(False))
    return F.when(ok, F.try_variant_get(w, "$[0]", "variant"))


def strict_json(c: Column) -> Column:
    """Parse a whole text as one JSON value, or NULL."""
    return wrapped_value(wrapped_parse(c))


def brace_slice(c: Column) -> Column:
    """The text from the first '{' to the last '}' (NULL unless both exist in
    that order)."""
    first = F.instr(c, "{")
    from_end = F.instr(F.reverse(c), "}")
    last = F.length(c) - from_end + F.lit(1)
    ok = (first > 0) & (from_end > 0) & (last > first)
    return F.when(ok, c.substr(first, last - first + F.lit(1)))


def status_of(failed: Column, direct: Column, sliced: Column) -> Column:
    return (F.when(failed, F.lit(STATUS_API_ERROR))
            .when(direct.isNotNull(), F.lit(STATUS_OK))
            .when(sliced.isNotNull(), F.lit(STATUS_SLICED))
            .otherwise(F.lit(STATUS_EMPTY)))


def empty_object() -> Column:
    return F.parse_json(F.lit("{}"))
