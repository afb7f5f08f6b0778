"""File sources: scan, classify, metadata, content dedup, incremental and
selected runs (S1-S5, S9, K4).

The scan is Spark's `binaryFile` source.  Extension filtering happens at file
listing (`pathGlobFilter`), and column pruning keeps `content` out of the scan
when only metadata is selected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALLOWED_EXTENSIONS, BINARY_FILE_SCHEMA

# File extension -> type label (the subtype of its MIME type, upper case).
TYPE_LABELS = {"pdf": "PDF", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "tiff": "TIFF"}


def extension_glob(extensions=None) -> str:
    """`*.{[pP][dD][fF],...}`: the glob is case-sensitive, so both cases of
    every letter are spelled out."""
    exts = extensions or ALLOWED_EXTENSIONS
    parts = ["".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in e)
             for e in exts]
    return "*.{" + ",".join(parts) + "}"


def scan_files(spark: SparkSession, path: str, extensions=None,
               recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of every file under `path`
    with an allowed extension (S1, S2)."""
    r = (spark.read.format("binaryFile")
         .option("pathGlobFilter", extension_glob(extensions)))
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same columns of files given by their paths, as `scan_files` lists
    them: nothing else is listed or opened."""
    return spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\,^])", r"\\\1", p) for p in paths])


def stream_files(spark: SparkSession, path: str, extensions=None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """The same scan as a stream over a landing folder."""
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("pathGlobFilter", extension_glob(extensions))
         .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_kind(path: Column) -> Column:
    """'pdf' or 'image' (S3): anything that is not a PDF is an image."""
    return F.when(extension(path) == "pdf", F.lit("pdf")).otherwise(F.lit("image"))


def type_label(path: Column) -> Column:
    ext = extension(path)
    out = None
    for e, label in TYPE_LABELS.items():
        out = (F.when(ext == e, F.lit(label)) if out is None
               else out.when(ext == e, F.lit(label)))
    return out.otherwise(F.upper(ext))


def size_kb(length: Column) -> Column:
    """Size in KB to one decimal, ties to even (as Python's round does)."""
    return F.bround(length / F.lit(1024.0), 1)


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, name, stem, kind, file_type, size_kb) (S3, S4).  Reads no file
    bytes: `content` is pruned from the scan."""
    p = F.col("path")
    name = file_name(p)
    return files.select(
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        file_kind(p).alias("kind"),
        type_label(p).alias("file_type"),
        size_kb(F.col("length")).alias("size_kb"))


def file_details(metadata: DataFrame, counts: DataFrame, on: str = "path") -> DataFrame:
    """`file_metadata` with the page counts of `page_counts` (S5): an image is
    one page, whether it can be read or not; a document that cannot be opened
    is of type `Unknown` and has NULL pages."""
    image = F.col("kind") == "image"
    return (metadata.join(counts, on, "left")
            .withColumn("pages", F.when(image, F.lit(1)).otherwise(F.col("pages")))
            .withColumn("file_type", F.when(F.col("pages").isNull(), F.lit("Unknown")).otherwise(F.col("file_type"))))


def with_content_key(files: DataFrame, content: str = "content") -> DataFrame:
    """Add `content_sha`, the SHA-256 of the file bytes."""
    return files.withColumn("content_sha", F.sha2(F.col(content), 256))


def unique_contents(files: DataFrame, key: str = "path") -> DataFrame:
    """One row per distinct content: its first `key` and its number of copies.

    A hash aggregate with map-side partial aggregation: a content held by a
    third of all files still reaches the shuffle as one row per map task.
    """
    return files.groupBy("content_sha").agg(
        F.min(key).alias("first_" + key), F.count(F.lit(1)).alias("copies"))


def representative(files: DataFrame, store_path: str, key: str = "path") -> DataFrame:
    """(key, content_sha, rep_key): every file mapped to the first file with
    the same bytes, so expensive stages run once per content and are joined
    back to all copies.

    The unique table is written to `store_path` first.  The join then has a
    plain exchange on both sides, and adaptive execution splits a content
    with very many copies over tasks; it does not split below an aggregate.
    """
    uniq = unique_contents(files, key).select("content_sha", F.col("first_" + key).alias("rep_" + key))
    uniq.write.parquet(store_path)
    stored = files.sparkSession.read.schema(uniq.schema).parquet(store_path)
    return files.select(key, "content_sha").join(stored, "content_sha", "inner")


def not_yet_processed(files: DataFrame, done: DataFrame, on) -> DataFrame:
    """Files whose key is not in an earlier run's output (anti join)."""
    return files.join(done, on, "left_anti")


def select_files(files: DataFrame, selection: DataFrame, on) -> DataFrame:
    """Files named in a selection table (semi join) (K4)."""
    return files.join(selection, on, "left_semi")
