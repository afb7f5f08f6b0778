"""Quality rules as a short-circuit cascade.

A document is rejected by any of the rules.  On a sample of the rows each
rule's cost (seconds a document, features included) and rejection rate are
measured alone; rules then run in descending order of rejections per second,
and a rule sees only documents that all earlier rules accepted.  The order
changes the time, never the verdict.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, values

SAMPLE_FRACTION = 0.005
WINDOW = 8

_BLANK, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


class Features:
    """Lazily computed measures of one text (null: empty)."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "replace")

    def __getattr__(self, name: str):
        if name not in _FEATURES:
            raise AttributeError(name)
        value = _FEATURES[name](self)
        setattr(self, name, value)
        return value


def _repeat_words(f: Features) -> int:
    """Words inside windows of eight words that occur twice or more in the text."""
    n = f.n_words
    if n <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, f.words), np.int64, n).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        m = n - WINDOW + 1
        win = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            win = (win ^ (win >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[j:j + m]
    order = np.argsort(win, kind="stable")
    same = win[order][1:] == win[order][:-1]
    if not same.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _dup_lines(f: Features) -> int:
    lines = [x for x in f.raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_FEATURES = {
    "words": lambda f: f.raw.split(),  # splits at the six ASCII blanks
    "n_words": lambda f: len(f.words),
    "word_chars": lambda f: len(f.text) - (len(f.raw) - len(f.raw.translate(None, _BLANK))),
    "n_symbols": lambda f: len(f.raw) - len(f.raw.translate(None, _SYMBOLS)),
    "n_lines": lambda f: sum(1 for x in f.raw.split(b"\n") if x.strip()),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_long_words": lambda f: sum(1 for w in f.words if len(w) > 100 and len(w.decode()) > 100),  # code points
}

#: name -> rejects(features).  The first two are the base rules.
RULES = {
    "few_words": lambda f: f.n_words < 20,
    "repeated_passages": lambda f: 100 * f.n_repeat_words > 30 * f.n_words,
    "many_symbols": lambda f: 100 * f.n_symbols > 5 * f.word_chars,
    "repeated_lines": lambda f: 100 * f.n_dup_lines > 50 * f.n_lines,
    "endless_words": lambda f: 100 * f.n_long_words > 20 * f.n_words,
}
BASE_RULES = ("few_words", "repeated_passages")
REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_order(df: DataFrame, text_col: str, rules: dict, sample_fraction: float = SAMPLE_FRACTION) -> list[str]:
    """Rule names, most rejections per second first, as measured on a random share of the rows.

    Each task measures its own part of the sample and returns one row a rule, so no text moves.  On
    an empty sample the order is by name."""
    names = list(rules)

    def measure(batches):
        spent, hits, n = np.zeros(len(names)), np.zeros(len(names), np.int64), 0
        for b in batches:
            for text in values(b.column(0)):
                n += 1
                for i, name in enumerate(names):
                    t = time.perf_counter()
                    hits[i] += bool(rules[name](Features(text)))
                    spent[i] += time.perf_counter() - t
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(spent), pa.array(hits), pa.array([n] * len(names))],
                                         names=["rule", "spent", "hits", "n"])

    rows = (df.select(F.col(text_col).cast("string")).sample(sample_fraction, seed=11)
            .mapInArrow(measure, "rule string, spent double, hits bigint, n bigint").groupBy("rule")
            .agg(*[F.sum(c).alias(c) for c in ("spent", "hits", "n")]).collect())
    gain = {r.rule: (r.hits + 0.5) / (r.spent + 1e-9) for r in rows}
    return sorted(names, key=lambda r: (-gain.get(r, 0.0), r))


def quality_cascade(df: DataFrame, text_col: str = "text", *, rules: dict | None = None, report: tuple = (),
                    out: str = "quality", sample_fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """Adds a struct column `out`: kept, rejected_by (the first rule of the measured order that
    rejects; which one that is may vary between runs, the verdict does not), one long for each
    feature in `report` (always computed), and base_failed.

    Null texts count as empty, so `few_words` rejects them; long texts are judged whole; repeated
    rows repeat; an empty table gives an empty result; a column already named `out` is replaced.
    """
    rules = RULES if rules is None else rules
    order = rule_order(df, text_col, rules, sample_fraction)

    @F.arrow_udf("kept boolean, rejected_by string" + "".join(f", {c} bigint" for c in report))
    def judge(texts: pa.Array) -> pa.Array:
        once("quality.none", None)
        by, measures = [], []
        for t in values(texts):
            f = Features(t)
            by.append(next((name for name in order if rules[name](f)), None))
            measures.append([getattr(f, c) for c in report])
        cols = list(zip(*measures)) if measures else [()] * len(report)
        return pa.StructArray.from_arrays(
            [pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string()),
             *[pa.array(c, pa.int64()) for c in cols]], names=["kept", "rejected_by", *report])

    return df.withColumn(out, judge(F.col(text_col).cast("string")))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that the registered query reports, from `quality_cascade`'s result with REPORT."""
    q = F.col("quality")
    failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    return df.select(id_col, *[q[c].alias(c) for c in REPORT], failed.alias("base_failed"), q["kept"].alias("kept"))
