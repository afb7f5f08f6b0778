"""The whole batch: a folder of invoice files -> header, line-item and flat
tables, CSV, JSON and per-file metrics.

    scan --(hash, no bytes moved)--> files not done yet, one per content
      --(several pieces: file bytes and stored texts laid out by piece, once)-->
      for each piece of the contents without pages or responses:
         its files --(one shuffle of file bytes, which spreads them over tasks)
         --> page job (decode + recognise, Python workers) --> page text, published
         --> pages joined per document --> prompt --> model (or rules)
         --> responses, published
    --> repair + validate (native) --> joined back to every copy
    --> tables, published by one commit

Expensive work is published in pieces of about `piece_contents` contents: a
run that fails has lost the recognition and the paid calls of one piece at
most, and the next one takes up from there.  Each published piece notes the
run's progress (`read_progress`).

What is published is what the manifest of `sinks.history` names.  The tables
for readers, the list of done files among them, come in one commit, so a run
that fails before leaves nothing a reader sees.  Every run adds one segment a
table; segments are merged in tiers, so neither the stores that later runs
look things up in nor the readers' tables grow in number of folders.  What
failed (unreadable files, recogniser errors, failed calls) goes to
`failures`, is not counted as done and is tried again by the next run.

Page text is kept per content, language and resolution; responses also per
prompt style, hint, prompt wording and client name.  The stores are
partitioned by the first hex digit of the content hash, so a small batch
looks only into its own part of the history.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import model as M
from ..operators import pages as P
from ..operators import prompt as PR
from ..operators import reshape
from ..operators.extract import extract_records
from ..schema import DEFAULT_DPI
from ..session import configure, setting
from ..sinks import writers
from ..sinks.history import History, Table
from ..sources import files as S


@dataclass
class JobOptions:
    lang: str = "eng"
    dpi: int = DEFAULT_DPI
    currency_hint: str | None = None
    prompt_style: str = "json"          # 'json' or 'plain'
    client_name: str = ""               # tells stored responses of different clients apart
    strict_alias: bool = False
    clean: bool = False                 # numbers, dates, addresses and blanks cleaned (N1, N2, N4, N5)
    ground_items: bool = False          # items flagged by whether the text holds them (N6)
    on_error: str = "empty"             # model errors: 'empty' rows or 'fail'
    extensions: list[str] | None = None
    block_pages: int = 256
    file_batch_rows: int = 16           # Arrow batch rows for frames with file bytes
    partitions: int | None = None       # tasks for the page job (default: parallelism)
    pages_per_task: int | None = None   # split long documents into page ranges
    model_concurrency: int = 1          # calls in flight per task
    model_retries: int = 0              # retries per call, exponential backoff
    piece_contents: int = 50_000        # contents whose pages and calls are published together
    compact_fan: int = 8                # segments of a table that are merged into one
    compact_keep_seconds: int = 3600    # how long merged segments stay for readers that hold them
    selection: DataFrame | None = field(default=None, repr=False)  # file names to process


# Tables that later runs look things up in.
STORES = {
    "file_index": Table("path string, content_sha string, job_key string, run string", ("path", "content_sha", "job_key"), "content_sha"),
    "page_text": Table("content_sha string, page_key string, page_no int, page_text string, run string", ("content_sha", "page_key", "page_no"), "content_sha"),
    "responses": Table("content_sha string, call_key string, response string, run string", ("content_sha", "call_key"), "content_sha"),
}
# Where a run's part shows first.
PARTS = {"pages": "page_text", "responses": "responses", "outputs": "file_metrics"}


def _prefix():
    return F.substring("content_sha", 1, 1)


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:24]


def history(spark: SparkSession, out_dir: str) -> History:
    return History(spark, out_dir, STORES)


class RunTables:
    """The tables of one run under `out_dir`, and the published ones."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir, self.run = spark, out_dir.rstrip("/"), uuid.uuid4().hex
        self.history = history(spark, out_dir)

    def path(self, name: str) -> str:
        return f"{self.out_dir}/{name}/run={self.run}"

    def work(self, df: DataFrame, name: str) -> DataFrame:
        """A table that only this run reads."""
        p = f"{self.out_dir}/_work/{self.run}/{name}"
        df.write.parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def dealt(self, df: DataFrame, name: str) -> DataFrame:
        """A work table laid out by its column `piece`: who reads one piece reads nothing of the others."""
        p = f"{self.out_dir}/_work/{self.run}/{name}"
        df.hint("rebalance", F.col("piece")).write.partitionBy("piece").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def pieces(self, name: str, schema: str) -> DataFrame:
        """The rows of the work tables `name`/piece=0, 1, ..."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out_dir}/_work/{self.run}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, piece bigint").parquet(p.toString()).drop("piece")

    def segment(self, name: str, df: DataFrame) -> dict[str, list[dict]]:
        """A written segment of a table, to be committed."""
        return {name: [self.history.write(name, df.withColumn("run", F.lit(self.run)))]}

    def clear_work(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out_dir}/_work/{self.run}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def published_runs(spark: SparkSession, out_dir: str, part: str = "outputs") -> list[str]:
    """Ids of the runs with published rows of a part ('pages', 'responses' or 'outputs')."""
    h = history(spark, out_dir)
    segments = h.manifest()["tables"].get(PARTS[part], [])
    if not segments:
        return []
    return sorted(r.run for r in h.read(PARTS[part], segments).select("run").distinct().collect())  # a row a run


def read_published(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table's published rows, with their `run`."""
    return history(spark, out_dir).read(name)


def read_progress(spark: SparkSession, out_dir: str) -> dict[str, dict]:
    """run -> what it has published so far: pieces (done, of), contents, pages, page_errors, calls, call_errors."""
    return history(spark, out_dir).manifest()["progress"]


def compact(spark: SparkSession, out_dir: str, fan: int = 8, keep_seconds: int = 3600) -> int:
    """Merges the segments of all tables in tiers; see `sinks.history`."""
    return history(spark, out_dir).compact(fan, keep_seconds)


def process_files(spark: SparkSession, files: DataFrame, out_dir: str, decoder_factory: Callable,
                  recogniser_factory: Callable, client_factory: Callable | None = None,
                  options: JobOptions | None = None, reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> dict:
    """Process the files of `files` (binaryFile rows) that no earlier run has done.

    `reader` opens files by path (`sources.files.read_files`): each piece then
    reads its own files only.  Without it `files` is read once for the pieces
    and its rows are written piece by piece (a single piece picks its rows out of it).

    Returns the tables' folders by name, the run's id under `run`, and a
    `summary`: files, records per (json_status, valid), failures per stage,
    pages and page errors.
    """
    o = options or JobOptions()
    configure(spark)
    n = o.partitions or spark.sparkContext.defaultParallelism
    t = RunTables(spark, out_dir)
    page_key = f"{o.lang}@{o.dpi}"
    style = [o.prompt_style, o.currency_hint or "", o.client_name, PR.INSTRUCTION, PR.EXAMPLE_INPUT] if client_factory else ["rules", o.currency_hint or ""]
    call_key = _digest(page_key, *style)
    job_key = _digest(call_key, o.strict_alias, o.clean, o.ground_items)

    # 1. files not done yet, and their content keys (bytes hashed where they are read)
    if o.selection is not None:
        files = S.select_files(files.withColumn("name", S.file_name(F.col("path"))),
                               o.selection, "name").drop("name")
    # The same bytes read as a document and as an image are two contents.
    image = S.file_kind(F.col("path")) == "image"
    keyed = t.work(S.with_content_key(files).select("path", "length", F.when(image, F.concat("content_sha", F.lit("-image")))
                                                    .otherwise(F.col("content_sha")).alias("content_sha")), "keyed")
    prefixes = [r.p for r in keyed.select(_prefix().alias("p")).distinct().collect()]  # at most 16

    def stored(name: str) -> DataFrame:
        return t.history.read(name, prefixes=prefixes).drop("run")

    done = stored("file_index").filter(F.col("job_key") == job_key)
    new_files = t.work(keyed.join(done, ["path", "content_sha"], "left_anti"), "new_files")
    have = stored("page_text").filter(F.col("page_key") == page_key).select("content_sha", F.lit(True).alias("paged")).distinct()
    answered = stored("responses").filter(F.col("call_key") == call_key).select("content_sha", F.lit(True).alias("answered")).distinct()
    contents = t.work(S.unique_contents(new_files, "path").select("content_sha", F.col("first_path").alias("path"))
                      .join(have, "content_sha", "left").join(answered, "content_sha", "left"), "contents")
    open_ = contents.filter("paged is null or answered is null")

    # 2. pages and responses, piece by piece.  A piece reads its own bytes and texts: what it would have to look for
    # in all files or in the history is laid out by piece before.
    some = contents.agg(F.count_if(F.expr("paged is null or answered is null")).alias("todo"), F.count("paged").alias("paged")).first()
    todo = some.todo
    pieces = -(-todo // o.piece_contents)
    piece = F.pmod(F.conv(F.substring("content_sha", 1, 8), 16, 10).cast("bigint"), F.lit(max(1, pieces)))
    known = spark.createDataFrame([], f"{_TEXTS}, piece bigint")
    if some.paged:
        ready = stored("page_text").filter(F.col("page_key") == page_key).join(contents.filter("paged").select("content_sha"), "content_sha", "left_semi")
        known = t.dealt(_texts(ready, o).withColumn("piece", piece), "known_texts")
    sources = None
    if pieces > 1 and not reader:
        unread = open_.filter("paged is null").select("path", "content_sha", piece.alias("piece")).filter("piece is not null")
        sources = t.dealt(files.select("path", "content").join(unread, "path"), "sources")
    seen = {"pages_done": 0, "page_errors": 0, "rows": 0}
    progress = {"pieces": [0, pieces], "contents": todo, "pages": 0, "page_errors": 0, "calls": 0, "call_errors": 0}
    for k in range(pieces):
        ours = open_.filter(piece == k)
        if sources is not None:
            src = sources.filter(F.col("piece") == k).drop("piece")
        else:
            src = _sources_of(t, files, ours.filter("paged is null").select("path", "content_sha"), reader)
        pages, segment, counts = _pages_of_piece(t, k, src, decoder_factory, recogniser_factory, o, n, page_key)
        seen = {c: seen[c] + counts[c] for c in seen}
        progress |= {"pages": seen["pages_done"], "page_errors": seen["page_errors"]}
        t.history.commit(add=segment, progress={t.run: progress})
        text = t.work(_texts(pages, o), f"texts/piece={k}").unionByName(known.filter(F.col("piece") == k).drop("piece"))
        need = ours.filter("answered is null").select("content_sha")
        calls = t.work(_answers(text.join(F.broadcast(need), "content_sha", "left_semi"), client_factory, o), f"calls/piece={k}")
        segment = t.segment("responses", calls.filter("error is null").select("content_sha", F.lit(call_key).alias("call_key"), "response"))
        sums = calls.agg(F.count("response").alias("ok"), F.count("error").alias("bad")).first()
        progress |= {"pieces": [k + 1, pieces], "calls": progress["calls"] + sums.ok, "call_errors": progress["call_errors"] + sums.bad}
        t.history.commit(add=segment, progress={t.run: progress})
    calls = t.pieces("calls", "content_sha string, response string, error string").filter("error is not null")
    failures = t.pieces("bad_pages", "content_sha string, error string, stage string").unionByName(
        calls.select("content_sha", "error", F.lit("call").alias("stage")))

    # 3. the text of every content of this run
    texts = t.pieces("texts", _TEXTS).unionByName(known.drop("piece"))

    # 4. repair + validate once per content, then every new file gets its
    # record.  Both sides of that join are written tables, so a content with
    # very many copies is split over tasks.
    answers = stored("responses").filter(F.col("call_key") == call_key)
    by_content = extract_records(answers.join(contents.select("content_sha"), "content_sha", "left_semi").drop("call_key"), strict_alias=o.strict_alias,
                                 error=None, clean=o.clean)
    if o.clean:
        by_content = by_content.withColumn("invoice", F.when(F.col("valid"), N.clean_invoice(F.col("invoice"))).otherwise(F.col("invoice")))
    if o.ground_items:
        by_content = by_content.join(texts.select("content_sha", "raw_text"), "content_sha", "left")
    by_content = t.work(by_content, "by_content")
    ours = new_files.select("path", "content_sha")
    records = t.work(ours.join(by_content, "content_sha"), "records")

    # 5. the tables for readers, then the one commit that publishes them
    paths, segments = {}, {}

    def put(name: str, df: DataFrame) -> None:
        segments.update(t.segment(name, df))
        paths[name] = f"{t.out_dir}/{name}"

    stem = writers.stem(F.col("path"))
    put("records", records.drop("raw_text"))
    put("invoice_header", reshape.header_table(records).withColumn("stem", stem))
    put("line_items", reshape.items_table(records, with_line_no=True, with_raw=True,
                                          text="raw_text" if o.ground_items else None).withColumn("stem", stem))
    flat = reshape.flat_table(records, with_line_no=True).withColumn("stem", stem)
    put("invoice_flat", flat)
    writers.write_flat_csv(flat.drop("line_no"), t.path("invoice_flat_csv"))
    writers.write_records_json(records, t.path("invoice_json"))
    put("invoice_json_pretty", writers.pretty_json(records))
    put("previews", ours.join(texts.select("content_sha", P.preview(F.col("raw_text")).alias("preview")), "content_sha"))
    failures = t.work(ours.join(failures, "content_sha"), "failures")
    put("failures", failures)
    put("file_metrics", S.file_details(S.file_metadata(new_files.select("path", "length")),
                                       ours.join(texts.select("content_sha", "pages", "page_errors"), "content_sha", "left"))
        .join(reshape.kpis(records).drop("content_sha"), "path", "left")
        .join(records.select("path", "json_status", "valid"), "path", "left"))
    put("file_index", ours.join(failures, ["path", "content_sha"], "left_anti").withColumn("job_key", F.lit(job_key)))
    statuses = {(r.json_status, r.valid): r.records for r in reshape.status_counts(records).collect()}  # a few rows
    stages = {r.stage: r["count"] for r in failures.groupBy("stage").count().collect()}
    t.history.commit(add=segments, progress={t.run: progress})
    summary = {"files": keyed.count(), "new_files": new_files.count(), "records": statuses, "failures": stages, **seen}
    t.clear_work()
    t.history.compact(o.compact_fan, o.compact_keep_seconds)
    paths.update({k: f"{t.out_dir}/{k}" for k in (*STORES, "invoice_flat_csv", "invoice_json")})
    return paths | {"run": t.run, "summary": summary}


_TEXTS = "content_sha string, raw_text string, pages int, page_errors bigint"


def _texts(pages: DataFrame, o: JobOptions) -> DataFrame:
    """(content_sha, raw_text, pages, page_errors) of contents whose pages are all fine."""
    counts = P.page_counts(pages.withColumn("error", F.lit(None).cast("string")), "content_sha")
    return P.join_pages(pages, key="content_sha", block_pages=o.block_pages).join(counts, "content_sha")


def _sources_of(t: RunTables, files: DataFrame, todo: DataFrame, reader) -> DataFrame:
    """(path, content, content_sha) of the files in `todo`.

    `todo` has about `piece_contents` rows, which bounds the paths that go
    through the driver and the broadcast that picks the piece's files."""
    if reader:
        paths = [r.path for r in todo.select("path").collect()]
        files = reader(t.spark, paths) if paths else files.limit(0)
    return files.select("path", "content").join(F.broadcast(todo), "path")


def _pages_of_piece(t: RunTables, k: int, src: DataFrame, decoder_factory: Callable, recogniser_factory: Callable,
                    o: JobOptions, n: int, page_key: str) -> tuple[DataFrame, dict, dict]:
    """(pages of the contents without errors, their segment, counts) of one piece."""
    pages, seen = P.with_progress(P.page_job(
        src, decoder_factory, recogniser_factory, lang=o.lang, dpi=o.dpi, key="content_sha",
        kind=S.file_kind(F.col("path")), pages_per_task=o.pages_per_task, partitions=n))
    with setting(t.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(o.file_batch_rows)):
        pages = t.work(pages, f"pages{k}")
    bad = t.work(pages.filter("error is not null").groupBy("content_sha").agg(F.min("error").alias("error"))
                 .withColumn("stage", F.lit("pages")), f"bad_pages/piece={k}")
    fine = pages.join(bad, "content_sha", "left_anti").select("content_sha", "page_no", "page_text")
    segment = t.segment("page_text", fine.select("content_sha", F.lit(page_key).alias("page_key"), "page_no", "page_text"))
    return fine, segment, seen.get


def _answers(text: DataFrame, client_factory: Callable | None, o: JobOptions) -> DataFrame:
    """(content_sha, response, error) of each text: by the model, or by the rules without a client."""
    hint = PR.hint_value(o.currency_hint)
    if client_factory is None:
        return text.select("content_sha", M.rule_response(F.col("raw_text"), hint).alias("response"),
                           F.lit(None).cast("string").alias("error"))
    build = PR.json_prompt if o.prompt_style == "json" else PR.plain_prompt
    return M.model_job(text.select("content_sha", build(F.col("raw_text"), hint).alias("prompt")), client_factory,
                       key="content_sha", on_error=o.on_error, concurrency=o.model_concurrency, retries=o.model_retries)


def run_invoice_job(spark: SparkSession, input_dir: str, out_dir: str, decoder_factory: Callable,
                    recogniser_factory: Callable, client_factory: Callable | None = None,
                    options: JobOptions | None = None) -> dict:
    """Run the batch over a folder; see `process_files`.  Files done by an
    earlier run are skipped.

    Without `client_factory` the rule extractor reads the fields (offline).
    """
    o = options or JobOptions()
    scan = S.scan_files(spark, input_dir, o.extensions)
    return process_files(spark, scan, out_dir, decoder_factory, recogniser_factory, client_factory, o, S.read_files)
