"""Sinks (X3-X7): the three tables as Parquet, the flat table as CSV, the
records as JSON; every row keeps its source path and file stem.

All writes are distributed (one file per partition); nothing is collected.
Outputs for a whole batch are one frame each (X7), optionally partitioned.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import reshape
from ..schema import DOUBLE_HEADER, FLAT_ITEM_ORDER
from ..session import setting

# Text files with a codec: speed first, as the rows of an invoice repeat its header.
ZLIB_LEVEL = {"zlib.compress.level": "BEST_SPEED"}


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def plain_double(c: Column) -> Column:
    """Double as plain decimal text (no exponent for 1e-4 <= |x| < 1e16)."""
    return reshape.double_text(c)


def store_records(records: DataFrame, path: str) -> DataFrame:
    """The records written once for all sinks and read back, without what no
    sink reads: the responses, and `raw` of valid records (that of the others
    is in `extras`).

    The shuffles that made the records are deleted with the end of the write;
    else they would lie beside all that the sinks write.
    """
    spark = records.sparkSession
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        records.drop("response", "raw").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).withColumn("raw", F.col("extras"))


def write_tables(records: DataFrame, out_dir: str, keys=None, partition_by=None,
                 mode: str = "overwrite", only=None, compression: str | None = None) -> dict[str, str]:
    """Write invoice_header/, line_items/ and invoice_flat/ as Parquet (X3),
    or those in `only`; `compression` names a codec other than the session's.

    `records` should be persisted (or read from storage) by the caller: three
    writes read it three times.
    """
    k = keys or ["path"]
    tables = {
        "invoice_header": reshape.header_table(records, k),
        "line_items": reshape.items_table(records, k, with_line_no=True),
        "invoice_flat": reshape.flat_table(records, k, with_line_no=True),
    }
    paths = {}
    for name, df in tables.items():
        if only and name not in only:
            continue
        df = df.withColumn("stem", stem(F.col("path"))) if "path" in df.columns else df
        w = df.write.mode(mode)
        if compression:
            w = w.option("compression", compression)
        if partition_by:
            w = w.partitionBy(*partition_by)
        p = f"{out_dir.rstrip('/')}/{name}"
        w.parquet(p)
        paths[name] = p
    return paths


def csv_ready(flat: DataFrame) -> DataFrame:
    """The flat table with values as the CSV should show them: doubles as
    plain text, `extras` as JSON text."""
    cols = []
    for f in flat.schema.fields:
        c = F.col(f.name)
        if f.name == "extras":
            cols.append(F.to_json(c).alias(f.name))
        elif f.name in DOUBLE_HEADER or f.name in FLAT_ITEM_ORDER[1:]:
            cols.append(plain_double(c).alias(f.name))
        else:
            cols.append(c)
    return flat.select(*cols)


def write_flat_csv(flat: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    """Flat CSV with a header row, UTF-8, NULL as empty, text kept as is (X4);
    `compression` (gzip, ...) is that of the files."""
    (csv_ready(flat).write.mode(mode).options(**ZLIB_LEVEL).option("compression", compression)
        .option("header", "true").option("escape", '"').option("nullValue", "")
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false").option("encoding", "UTF-8")
        .csv(path))
    return path


def write_records_json(records: DataFrame, path: str, keys=None, mode: str = "overwrite", compression: str = "none") -> str:
    """One JSON line per record with nulls kept and non-ASCII as is (X5);
    `compression` (gzip, ...) is that of the files."""
    k = keys or ["path"]
    stems = [stem(F.col("path")).alias("stem")] if "path" in k else []
    out = records.select(*k, *stems, F.col("json_status"), F.col("valid"), F.col("invoice.*"),
                         F.to_json(F.col("extras")).alias("extras"))
    (out.write.mode(mode).options(**ZLIB_LEVEL).option("compression", compression)
        .option("ignoreNullFields", "false").json(path))
    return path


def pretty_json(records: DataFrame, keys=None) -> DataFrame:
    """(keys, json): each record as indented JSON text with nulls kept."""
    k = keys or ["path"]
    return records.select(*k, F.to_json(F.col("invoice"),
                                        {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's bytes as a file of its own under a folder that all
    tasks share, by name; returns how many.  A task that is run again writes
    the same files again."""

    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            for n, data in zip(batch.column(0), batch.column(1)):
                with store.open_output_stream(f"{base}/{n.as_py()}") as f:
                    f.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select(name, content).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
