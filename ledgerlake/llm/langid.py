"""Language identification with bit-sliced Bloom filters of character trigrams.

One table holds the Bloom filters of all languages
at once: bit l of a slot belongs to language l.  Its slots are a power of two, `MIN_SLOT_BITS` or as many more as keep
the fullest filter's false-positive rate at `FALSE_POSITIVES` or less.  A trigram has three slots; the AND of
their masks names every language whose filter contains it.  Per text and
language the trigrams it contains are counted over all positions, corrected for the
filter's false-positive rate, and the highest share decides.

Trigrams of lower-cased letters, other characters being one blank, are
counted a language over all training texts.  A language's filter gets those whose
frequency there is at least `share` of their highest frequency in any language, and at least `FLOOR` of all its
trigrams, so a filter holds 1 / FLOOR trigrams at most and the table 2^24 slots, however much is learned from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, once

MIN_SLOT_BITS = 20
SHARE = 0.3
FLOOR = 1e-6
FALSE_POSITIVES = 0.01
WORD_LANGUAGES = 62  # languages in one 64-bit word of a slot
UNDETERMINED = "und"


def _letters(_=None) -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, index of its text) for all texts; a trigram is a mixed 63-bit number of three code points."""
    joined = "\0" + "\0".join(f" {t.lower()} " if t else " " for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    edge = c == 0
    # A NUL inside a text is a character like any other that is no letter.
    if int(edge.sum()) != len(texts) + 1:
        joined = "\0" + "\0".join(f" {t.lower()} ".replace("\0", " ") if t else " " for t in texts) + "\0"
        c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        edge = c == 0
    letter = once("langid.letters", "letters", _letters)[c]
    c = np.where(letter | edge, c, np.uint32(32))
    keep = ~((c[1:] == 32) & (c[:-1] == 32))
    c = c[np.append(True, keep)].astype(np.uint64)
    doc = np.cumsum(c == 0) - 1
    g = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    ok = (c[:-2] != 0) & (c[1:-1] != 0) & (c[2:] != 0)
    g, doc = g[ok], doc[1:-1][ok]  # every trigram has a letter, since blanks are never neighbours
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32)), doc


def slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    low, step, mask = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1), np.uint64((1 << bits) - 1)
    return [((low + np.uint64(j) * step) & mask).astype(np.int64) for j in range(3)]


def slot_bits(fullest: int) -> int:
    """Bits of a slot number, for a filter of so many trigrams."""
    fill = FALSE_POSITIVES ** (1 / 3)
    return max(MIN_SLOT_BITS, math.ceil(math.log2(max(1, fullest) * -3 / math.log(1 - fill))))


class Model:
    """languages (sorted), table (slots x words) and the false-positive rate of each language's filter."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        fill = [np.mean((table[:, i // WORD_LANGUAGES] >> (i % WORD_LANGUAGES)) & 1) for i in range(len(languages))]
        self.false_positive = np.array(fill, np.float64).reshape(-1) ** 3

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (corrected share of the text's trigrams) of each text."""
        grams, doc = trigrams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
        found = np.zeros((len(texts), len(self.languages)))
        a, b, c = slots(grams, len(self.table).bit_length() - 1)
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            mask = column[a] & column[b] & column[c]
            for i in range(w * WORD_LANGUAGES, min(len(self.languages), (w + 1) * WORD_LANGUAGES)):
                found[:, i] = np.bincount(doc[(mask >> (i % WORD_LANGUAGES)) & 1 == 1], minlength=len(texts))
        fp = np.minimum(self.false_positive, 0.999)
        share = np.clip((found / np.maximum(n, 1)[:, None] - fp) / (1 - fp), 0, 1) if self.languages else np.zeros((len(texts), 1))
        best = share.argmax(axis=1)  # the first in alphabetical order where scores are equal
        known = (n > 0) & bool(self.languages)
        names = [self.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
        return names, np.where(known, share.max(axis=1), 0.0)


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> Model:
    """Learns from all rows with a language; texts that are null or without letters add nothing.

    The driver receives the number of trigrams of each language and the finished table (2^20 slots while no
    language has more than about 84,000 trigrams, 2^24 at most; one word for each 62 languages)."""
    store = Store(labelled.sparkSession, "langid")

    def count(batches):
        for b in batches:
            langs = b.column(0)
            for lang in langs.unique().to_pylist():
                mine = b.column(1).filter(pc.equal(langs, lang))
                parts = [np.unique(trigrams(mine.slice(i, 2048).to_pylist())[0], return_counts=True) for i in range(0, len(mine), 2048)]
                u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)],
                                                 names=["lang", "gram", "n"])

    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counts = store.write(rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram")
                         .agg(F.sum("n").alias("n")), "counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    languages = sorted(totals)
    words = max(1, -(-len(languages) // WORD_LANGUAGES))
    if not languages:
        return Model(languages, np.zeros((1 << MIN_SLOT_BITS, words), np.int64))
    # A row a language: no trigram moves to learn its language's total.
    index = labelled.sparkSession.createDataFrame([(x, i, totals[x]) for i, x in enumerate(languages)], "lang string, i int, total bigint")
    rated = counts.join(F.broadcast(index), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("rate")).filter(F.col("rate") >= FLOOR)
    kept = (rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("i", "rate")).alias("own"))
            .select("gram", F.explode(F.filter("own", lambda x: x["rate"] >= share * F.col("top"))).alias("x")))
    kept = store.write(kept, "kept")
    size = slot_bits(kept.groupBy("x.i").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    low, step = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("bigint"))
    places = F.array(*[(low + j * step).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")) for j in range(3)])
    table = np.zeros((1 << size, words), np.int64)
    bits = (kept.select(F.explode(places).alias("slot"), F.expr(f"x.i div {WORD_LANGUAGES}").alias("word"),
                        F.expr(f"shiftleft(1L, x.i % {WORD_LANGUAGES})").alias("bit"))
            .groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow())
    table[bits["slot"].to_numpy(), bits["word"].to_numpy()] = bits["mask"].to_numpy()
    store.drop("counts", "kept")
    return Model(languages, table)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct column `out` of lang and score (0 to 1) to each row.

    Null texts and texts without letters are `und` with score 0, as is everything if no
    language was learned; equal scores go to the first language in alphabetical order; texts are read whole; a
    column already named `out` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))  # of a bounded size

    @F.arrow_udf("lang string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        m = once("langid.model", shared.value, lambda v: Model(*v))
        names, scores = [], []
        for i in range(0, len(texts), 512):
            a, b = m.predict(texts.slice(i, 512).to_pylist())
            names += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                          names=["lang", "score"])

    return docs.withColumn(out, judge(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 by 3.  False for null ids, which are not trained on either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
