"""Corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns the columns of `documents` (the last: packed pieces).  `run`
writes each stage's result as Parquet in the shared folder and reads it back
as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontam, neardup, packing, pii, quality
from ledgerlake.llm.common import Store, read, task_count


# Every stage: null, empty and very long texts, ties, repeated rows, empty tables and further columns are allowed; columns other
# than doc_id and text come back as they were, whatever their names.


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all columns but doc_id and text under names that no operator uses, and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects stay: rows are judged by themselves, null and empty texts are rejected (too few words)."""
    inner, back = shielded(docs)
    return back(quality.quality_cascade(inner, out="quality").filter("quality.kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id
    stays.  Rows are told apart by a number of their own: of repeated rows one stays, rows with equal ids but different texts are
    different documents, and rows without an id take part and come last.  Texts without words stay."""
    store = Store(spark, "near-dedup")
    inner, back = shielded(docs)
    # Numbers in the order of the ids: the smallest of a group is then the one that stays.
    by_id = [F.col("doc_id").asc_nulls_last(), F.col("at")]
    rows = (inner.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(task_count(spark), *by_id)
            .sortWithinPartitions(*by_id).drop("at").withColumn("row", F.monotonically_increasing_id()))
    rows = store.write(rows, "rows")
    found = neardup.near_duplicates(rows.select("row", "text"), id_col="row", words=5, num=80, den=100)
    gone = found.filter("not kept").select("row")
    return back(rows.join(gone, "row", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage stay, those without words among them; rows are judged by themselves."""
    inner, back = shielded(docs)
    marked = decontam.decontaminate(inner, read(spark, sf_dir, "benchmark"), keep_text=True)
    return back(marked.filter(F.col("contamination.n_hit") == 0))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds in brackets; n_chars, where there is one, follows.  All rows stay, null texts are null."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a training sequence; null texts are empty documents, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

# Random projections and a tokenizer decide the rows: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; a stage's table is deleted once the next one's is written."""
    store = Store(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.write(stage(spark, docs, sf_dir), name)
        if k:
            store.drop(STAGES[k - 1][0])
    return docs
