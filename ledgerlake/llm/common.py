"""Helpers shared by the training-data operators: table reads, stored stages
in the cluster's shared folder, and ASCII word splitting."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, configure


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """Intermediate tables of one operator run, written as Parquet under the
    shared folder that `spark.checkpoint.dir` names.

    A written table cuts lineage and survives lost executors.  `drop` deletes
    a table that nothing reads any more; tables behind a returned frame stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlake-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(table))
        return self.reread(table, df)

    def reread(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.path(t))
            p.getFileSystem(conf).delete(p, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within the block, batches for Python hold at most so many rows: bounds the workers' memory where
    rows are large.  The session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def task_count(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_ONCE: dict = {}


def once(kind: str, value, build=lambda _: None):
    """build(value), kept in the Python worker until the same kind comes with another value.

    A kind is `operator.part`.  Workers outlive a query, so what other operators have left is let go: a
    worker holds one operator's tables at a time."""
    operator = kind.partition(".")[0]
    for other in [k for k in _ONCE if k.partition(".")[0] != operator]:
        del _ONCE[other]
    if kind not in _ONCE or (_ONCE[kind][0] is not value and not (isinstance(value, str) and _ONCE[kind][0] == value)):
        _ONCE.pop(kind, None)
        _ONCE[kind] = (value, build(value))
    return _ONCE[kind][1]


def values(column: pa.Array, step: int = 512):
    """The Python values of a column, made a few rows at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def lists_of(parts: list, kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def split(column: pa.Array) -> list[np.ndarray]:
    """The numpy arrays of a list column without nulls."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
