"""Tables that grow run by run: segments, one manifest, compaction in tiers.

A segment is a folder of Parquet files, written in full before anything
refers to it.  The manifest names the live segments of every table; a new
version of it makes segments appear and others vanish in one step, for all
tables at once.  A version is written beside the others and renamed to its
number, which fails if another writer took that number first; the change is
then applied to that writer's version and tried again.

Compaction merges `fan` segments of one level into one of the next level, so
a row is rewritten once a level, and a table of any number of runs has at
most (fan - 1) segments a level.  Merged segments leave the manifest at once
and the disk only some time later, since readers may still hold them.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_VERSIONS = 20
KEPT_PROGRESS = 50  # runs whose progress the manifest remembers


@dataclass(frozen=True)
class Table:
    """A keyed store: its columns, the columns that tell its rows apart, and the column whose first hex digit
    partitions it, so that a small batch looks only into its own part."""

    schema: str
    keys: tuple[str, ...]
    hashed: str


class Conflict(RuntimeError):
    """Segments to be replaced are no longer live: another writer replaced them."""


class History:
    """The tables under a folder.  `stores` are keyed tables; every other name is a plain table."""

    def __init__(self, spark: SparkSession, base: str, stores: dict[str, Table] | None = None):
        self.spark, self.base, self.stores = spark, base.rstrip("/"), stores or {}

    # --- the manifest ---------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, d = self._fs(), self._path("_manifest")
        if not fs.exists(d):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(d)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The latest version: `tables` (name -> segments), `retired` segments, `progress` of runs."""
        for _ in range(20):
            versions = self._versions()
            if not versions:
                return {"version": 0, "tables": {}, "retired": [], "progress": {}}
            rows = self._read(versions[-1])
            if rows is not None:
                return rows
        raise RuntimeError(f"no readable manifest under {self.base}")

    def _read(self, version: int) -> dict | None:
        """A version's content; None if later versions have removed it meanwhile."""
        name = f"{version:020d}.json"
        path = self._path("_manifest", name)
        fs = self._fs()
        if not fs.exists(path):
            return None
        size = fs.getFileStatus(path).getLen()
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        digest, _, body = text.partition("\n")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise RuntimeError(f"manifest {name} of {size} bytes is damaged")
        return json.loads(body)

    def _write(self, m: dict) -> bool:
        """Writes a version; False if its number is taken."""
        jvm = self.spark._jvm
        body = json.dumps(m)
        tmp, to = self._path("_manifest", f"_{uuid.uuid4().hex}"), self._path("_manifest", f"{m['version']:020d}.json")
        fs = self._fs()
        out = fs.create(tmp, False)
        try:
            out.write(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(tmp, to, none)
        except Exception as e:  # noqa: BLE001 -- any other reason is raised
            fs.delete(tmp, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def commit(self, add: dict[str, list[dict]] | None = None, drop: dict[str, list[dict]] | None = None,
               progress: dict[str, dict] | None = None, forget: list[str] | None = None) -> dict:
        """A new version with segments added and dropped and a run's progress noted."""
        while True:
            m = self.manifest()
            tables = {n: list(s) for n, s in m["tables"].items()}
            for name, segments in (drop or {}).items():
                live = tables.get(name, [])
                if any(s not in live for s in segments):
                    raise Conflict(name)
                tables[name] = [s for s in live if s not in segments]
            for name, segments in (add or {}).items():
                tables.setdefault(name, []).extend(segments)
            now = int(time.time())
            retired = [r for r in m["retired"] if r["dir"] not in (forget or [])]
            retired += [{"dir": s["dir"], "at": now} for segments in (drop or {}).values() for s in segments]
            noted = dict(m["progress"])
            for run, p in (progress or {}).items():
                noted.pop(run, None)
                noted[run] = p
            noted = dict(list(noted.items())[-KEPT_PROGRESS:])
            new = {"version": m["version"] + 1, "tables": tables, "retired": retired, "progress": noted}
            if self._write(new):
                for v in self._versions()[:-KEPT_VERSIONS]:
                    self._fs().delete(self._path("_manifest", f"{v:020d}.json"), False)
                return new

    # --- segments -------------------------------------------------------------

    def write(self, name: str, df: DataFrame, level: int = 0) -> dict:
        """Writes a segment; nobody sees it before it is committed."""
        d = f"{name}/seg={uuid.uuid4().hex}"
        store = self.stores.get(name)
        if store:
            # Rows of one digit come together first, in as many tasks as their size asks for: else every
            # task would write a file for every digit.
            (df.withColumn("prefix", F.substring(store.hashed, 1, 1)).hint("rebalance", F.col("prefix"))
             .write.partitionBy("prefix").parquet(f"{self.base}/{d}"))
        else:
            df.write.parquet(f"{self.base}/{d}")
        return {"dir": d, "level": level}

    def read(self, name: str, segments: list[dict] | None = None, prefixes: list[str] | None = None) -> DataFrame:
        """The rows of a table's live segments (or of the given ones)."""
        if segments is None:
            segments = self.manifest()["tables"].get(name, [])
        store = self.stores.get(name)
        if not segments:
            if not store:
                raise FileNotFoundError(f"nothing published as {name} under {self.base}")
            return self.spark.createDataFrame([], store.schema)
        paths = [f"{self.base}/{s['dir']}" for s in segments]
        reader = self.spark.read.option("basePath", f"{self.base}/{name}")
        if not store:
            return reader.parquet(*paths).drop("seg")
        df = reader.schema(f"{store.schema}, seg string, prefix string").parquet(*paths)
        if prefixes is not None:
            df = df.filter(F.col("prefix").isin(prefixes))
        return df.drop("seg", "prefix")

    def folders(self, name: str) -> list[str]:
        """Names of a table's segment folders on disk, live, retired or never committed."""
        fs, d = self._fs(), self._path(name)
        if not fs.exists(d):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(d) if s.getPath().getName().startswith("seg="))

    # --- compaction -----------------------------------------------------------

    def compact(self, fan: int = 8, keep_seconds: int = 3600) -> int:
        """Merges segments until no level of a table has `fan` of them; returns the number of merges.

        Segments that were merged more than `keep_seconds` ago are deleted.  A merge that another writer was
        faster with is given up."""
        if fan < 2:
            raise ValueError("fan: at least two segments are merged")
        merges = 0
        m = self.manifest()
        late = [r["dir"] for r in m["retired"] if r["at"] <= time.time() - keep_seconds]
        for d in late:
            self._fs().delete(self._path(d), True)
        if late:
            m = self.commit(forget=late)
        for name in sorted(m["tables"]):
            while True:
                by_level: dict[int, list[dict]] = {}
                for s in m["tables"][name]:
                    by_level.setdefault(s["level"], []).append(s)
                full = [lv for lv, s in sorted(by_level.items()) if len(s) >= fan]
                if not full:
                    break
                old = by_level[full[0]][:fan]
                df = self.read(name, old)
                store = self.stores.get(name)
                df = df.dropDuplicates(list(store.keys)) if store else df.hint("rebalance")
                new = self.write(name, df, full[0] + 1)
                try:
                    m = self.commit(add={name: [new]}, drop={name: old})
                    merges += 1
                except Conflict:
                    self._fs().delete(self._path(new["dir"]), True)
                    m = self.manifest()
        return merges


