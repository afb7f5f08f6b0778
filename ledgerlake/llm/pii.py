"""Personal data: regular expressions propose spans, validators confirm them
(Luhn for cards, mod-97 for bank accounts, number ranges), and words nearby
raise the score of spans whose form alone proves little.

Four kinds are certain by their form and validator and always kept (`base`):
email, ip, card of 16 to 19 digits, phone with a plus sign.  The others are
kept from a score of `threshold` on.  Every search is linear in the text:
candidates start at the first character of a run and no run is tried twice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, values

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
CONTEXT_CHARS = 48

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.(-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}(?![\w.-])")
_SHORT_CARD = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,14}(?![\w.-])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")

#: kind -> (score of the validated form, score added by a word nearby, those words)
CONTEXT = {
    "card": (0.3, 0.4, {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"}),
    "phone": (0.2, 0.4, {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}),
    "iban": (0.9, 0.1, {"iban", "account", "bank", "konto", "compte", "cuenta"}),
    "ssn": (0.2, 0.5, {"ssn", "social", "security"}),
    "key": (0.9, 0.1, {"key", "secret", "access", "token"}),
}


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def mod97(iban: str) -> bool:
    rolled = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in rolled)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str):
    """The leftmost matches of local@label.label..., found from each @ outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Certain spans: kind by kind, each leftmost and without overlaps within its kind."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _proposals(text: str):
    """Validated spans of the uncertain kinds."""
    for m in _IBAN.finditer(text):
        s = m.group()
        cuts = [len(s)] + [i for i in range(len(s) - 1, 14, -1) if s[i] == " "]
        for cut in cuts:  # words in capitals may follow the number
            plain = s[:cut].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield "iban", m.start(), m.start() + cut
                break
    for m in _KEY.finditer(text):
        yield "key", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _SHORT_CARD.finditer(text):
        if luhn(_digits(m.group())):
            yield "card", *m.span()
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m.group())) <= 15:
            yield "phone", *m.span()


_WORD = re.compile(r"\w+")


class _Free:
    """Which places are not covered yet.  Taken spans are kept apart and in order, in short lists of neighbours, so that taking
    one looks at two spans and moves a few."""

    SHORT = 512

    def __init__(self, spans):
        flat: list[list[int]] = []
        for a, b in sorted(spans):
            if flat and a < flat[-1][1]:
                flat[-1][1] = max(flat[-1][1], b)
            else:
                flat.append([a, b])
        self.lists = [flat[i:i + self.SHORT] for i in range(0, len(flat), self.SHORT)] or [[]]
        self.firsts = [x[0][0] for x in self.lists[1:]]  # where the second list and those after it begin

    def take(self, a: int, b: int) -> bool:
        """Takes [a, b) unless some of it is taken."""
        n = bisect_right(self.firsts, a)
        here = self.lists[n]
        k = bisect_right(here, a, key=itemgetter(0))
        before = here[k - 1] if k else None
        after = here[k] if k < len(here) else self.lists[n + 1][0] if n + 1 < len(self.lists) else None
        if (before and a < before[1]) or (after and after[0] < b):
            return False
        here.insert(k, [a, b])
        if len(here) > 2 * self.SHORT:
            self.lists[n:n + 1] = [here[:self.SHORT], here[self.SHORT:]]
            self.firsts.insert(n, here[self.SHORT][0])
        return True


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[dict]:
    """All kept spans as {kind, start, end, score, base}, by kind, then start."""
    if not text:
        return []
    out = [{"kind": k, "start": a, "end": b, "score": 1.0, "base": True} for k, a, b in base_spans(text)]
    if _DIGIT.search(text) or "AKIA" in text or "ASIA" in text:
        more = []
        for kind, a, b in _proposals(text):
            form, gain, near = CONTEXT[kind]
            around = text[max(0, a - CONTEXT_CHARS):a] + " " + text[b:b + CONTEXT_CHARS]
            score = form + gain * bool(near.intersection(map(str.lower, _WORD.findall(around))))
            if score >= threshold:
                more.append((score, kind, a, b))
        free = _Free((s["start"], s["end"]) for s in out)
        for score, kind, a, b in sorted(more, key=lambda x: (-x[0], x[2], KINDS.index(x[1]))):
            if free.take(a, b):
                out.append({"kind": kind, "start": a, "end": b, "score": score, "base": False})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """The text with every kept span replaced by its kind in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, end = [], 0
    merged: list = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join(out) + text[end:]


_SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def find_pii(df: DataFrame, text_col: str = "text", *, out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the array column `out` of spans (kind, start, end, score, base); offsets count code
    points, end exclusive.  Null and empty texts have no spans; each row is judged by itself, so
    repeated rows repeat and an empty table stays empty; a column already named `out` is replaced.  Texts are searched whole, in time
    that grows with their length and the logarithm of their spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("score", pa.float64()), ("base", pa.bool_())]))

    @F.arrow_udf(f"array<{_SPAN}>")
    def find(texts: pa.Array) -> pa.Array:
        once("pii.none", None)
        return pa.array([spans_of(t, threshold) for t in values(texts)], kind)

    return df.withColumn(out, find(F.col(text_col).cast("string")))


def redact(df: DataFrame, text_col: str = "text", *, out: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Replaces every span by its kind in brackets; null and empty texts stay what they are.  Rows are judged by themselves: repeated
    rows repeat, an empty table stays empty, other columns are kept whatever their names.  Texts are searched whole, see `find_pii`."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array) -> pa.Array:
        once("pii.none", None)
        return pa.array([redacted(t, spans_of(t, threshold)) for t in values(texts)], pa.string())

    return df.withColumn(out, cover(F.col(text_col).cast("string")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that the registered query reports, from `find_pii`'s result."""
    base = F.filter("pii", lambda s: s["base"])
    return df.select(
        id_col, *[F.size(_of_kind(base, k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
