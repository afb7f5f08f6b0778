"""Registered queries for the document-side operators: sources, pages, text,
prompts, rule extraction, normalisation, grounding, the model job, the page
scan, the incremental job and the exports.  `oracle()` gives DuckDB SQL for
each of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import model as M
from ..operators import pages as P
from ..operators import prompt as PR
from ..operators import reshape
from ..operators.extract import extract_records
from ..schema import ALLOWED_EXTENSIONS, FLAT_HEADER_ORDER, FLAT_ITEM_ORDER
from ..session import checkpoint_dir, configure, setting
from ..sinks import writers
from ..sinks.history import History, Table
from ..sources import files as S
from ..sources import tables as TB
from . import invoice_job as J
from .expected_prompts import JSON_HEAD, JSON_TAIL, PLAIN_HEAD, PLAIN_TAIL


def _folder(spark, name):
    """A new folder for one call's tables in the shared folder."""
    return os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex)


def _allowed(df):
    return df.filter(S.extension(F.col("path")).isin(*ALLOWED_EXTENSIONS))


def file_metadata(spark, sf_dir):
    """S1 (extension filter), S3, S4 over documents shaped as files."""
    configure(spark)
    return S.file_metadata(_allowed(TB.documents_as_files(spark, sf_dir)))


MIXED_EXTENSIONS = ["pdf", "PNG", "Jpg", "jpeg", "TIFF", "txt", "pdfx", "PdF"]


def file_scan(spark, sf_dir):
    """Every document written as a file of its own, extensions in
    mixed case, some not accepted; the folder listed by extension, then read."""
    configure(spark)
    ext = F.element_at(F.array(*[F.lit(x) for x in MIXED_EXTENSIONS]), (F.pmod("doc_id", F.lit(len(MIXED_EXTENSIONS))) + 1).cast("int"))
    d = TB.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
                                                    F.encode("text", "UTF-8").alias("content"))
    folder = _folder(spark, "landing")
    written = writers.write_files(d, folder)
    files = S.with_content_key(S.scan_files(spark, folder))
    return (S.file_metadata(files).join(files.select("path", "content_sha"), "path").drop("path")
            .withColumn("written", F.lit(written).cast("bigint")))


def compacted_history(spark, sf_dir):
    """S9 over eight runs: each stores the contents that no earlier run has,
    as a segment that the manifest then names; segments are merged in tiers of
    three.  Every file with the run that stored its content, and how many
    segments the manifest and the disk are left with."""
    configure(spark)
    folder = _folder(spark, "history")
    S.with_content_key(_allowed(TB.documents_as_files(spark, sf_dir))).select("path", "doc_id", "content_sha").write.parquet(folder + "/files")
    files = spark.read.parquet(folder + "/files")
    h = History(spark, folder, {"contents": Table("content_sha string, first_path string, run int", ("content_sha",), "content_sha")})
    for run in range(8):
        mine = S.unique_contents(files.filter(F.pmod("doc_id", F.lit(8)) == run), "path")
        new = S.not_yet_processed(mine, h.read("contents"), "content_sha").select("content_sha", "first_path", F.lit(run).alias("run"))
        h.commit(add={"contents": [h.write("contents", new)]})
        h.compact(fan=3, keep_seconds=0)
    h.compact(fan=3, keep_seconds=0)  # deletes what the last merge replaced
    live = h.manifest()["tables"]["contents"]
    return files.join(h.read("contents", live), "content_sha").select(
        "path", "content_sha", "first_path", "run", F.lit(len(live)).cast("bigint").alias("segments"),
        F.lit(len(h.folders("contents"))).cast("bigint").alias("folders"))


def content_dedup(spark, sf_dir):
    """Every file mapped to the first file with the same bytes."""
    configure(spark)
    files = S.with_content_key(_allowed(TB.documents_as_files(spark, sf_dir)))
    return S.representative(files, _folder(spark, "content_dedup"))


def already_processed(spark, sf_dir):
    """S9 across runs: files not in an earlier run's output (anti join)."""
    configure(spark)
    files = TB.documents_as_files(spark, sf_dir).select("path", "doc_id")
    done = TB.table(spark, sf_dir, "labels").select("doc_id")
    return S.not_yet_processed(files, done, "doc_id")


def select_files(spark, sf_dir):
    """K4: files named in a selection table (semi join)."""
    configure(spark)
    files = TB.documents_as_files(spark, sf_dir).select("path", "doc_id")
    chosen = TB.table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return S.select_files(files, chosen, "doc_id")


def page_join(spark, sf_dir):
    """Conversation turns as the pages of a document, joined in order
    (small blocks, so that the two-level join is exercised)."""
    configure(spark)
    pages = TB.table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("page_no"), F.col("text").alias("page_text"))
    return P.join_pages(pages, key="conv_id", block_pages=4)


def preview(spark, sf_dir):
    """The first 20,000 characters of each document's text."""
    configure(spark)
    d = TB.table(spark, sf_dir, "documents")
    return d.select("doc_id", P.preview(F.col("text")).alias("preview"))


def _hint(lang):
    return (F.when(lang == "en", F.lit("USD")).when(lang.isin("fr", "de"), F.lit("EUR"))
            .otherwise(F.lit("")))


def prompts(spark, sf_dir):
    """Both prompt styles with a per-row currency hint, as digests of
    the full prompts; the JSON prompt is also read back."""
    configure(spark)
    d = TB.table(spark, sf_dir, "documents")
    hint = _hint(F.col("lang"))
    p = d.select("doc_id", "text", PR.json_prompt(F.col("text"), hint).alias("pj"),
                 PR.plain_prompt(F.col("text"), hint).alias("pp"))
    return p.select(
        "doc_id",
        (F.get_json_object("pj", "$.text") == F.col("text")).alias("json_text_ok"),
        F.get_json_object("pj", "$.schema.currency").alias("currency"),
        F.sha2("pj", 256).alias("json_sha256"), F.sha2("pp", 256).alias("plain_sha256"))


def rule_extract(spark, sf_dir):
    """Invoices written as text, read back by the rule extractor; the
    currency comes from the total's line, another line or the hint."""
    configure(spark)
    t = TB.invoice_texts(spark, sf_dir, codes_vary=True)
    inv = t.select("path", M.rule_extract(F.col("raw_text"), F.lit("CHF")).alias("invoice"))
    head = ["vendor_name", "vendor_gstin", "invoice_number", "invoice_date", "buyer_name",
            "buyer_gstin", "currency", "subtotal", "tax_percent", "tax_amount", "total"]
    ex = inv.select("path", *[F.col("invoice." + c).alias(c) for c in head],
                    F.posexplode_outer("invoice.line_items").alias("_pos", "_item"))
    return ex.select("path", *head,
                     *[F.col("_item." + c).alias(c) for c in FLAT_ITEM_ORDER],
                     F.coalesce(F.col("_pos") + 1, F.lit(0)).alias("line_no"))


def normalise(spark, sf_dir):
    """Values written in varied formats, cleaned back."""
    configure(spark)
    inv = TB.invoice_columns(spark, sf_dir, with_items=False)
    k = F.col("o_orderkey")
    money = (F.when(F.pmod(k, F.lit(4)) == 0, F.format_string("%.2f", "subtotal"))
             .when(F.pmod(k, F.lit(4)) == 1, F.format_number("subtotal", 2))
             .when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("$"), F.format_number("subtotal", 2)))
             .otherwise(F.concat(F.lit("INR "), F.format_number("subtotal", 2), F.lit(" "))))
    pct = F.concat(F.col("tax_percent").cast("string"), F.lit("%"))
    d = F.to_date("invoice_date")
    m5 = F.pmod(k, F.lit(5))
    date_txt = (F.when(m5 == 0, F.col("invoice_date"))
                .when(m5 == 1, F.date_format(d, "dd/MM/yyyy"))
                .when(m5 == 2, F.date_format(d, "MMM d, yyyy"))
                .when(m5 == 3, F.date_format(d, "d MMMM yyyy"))
                .otherwise(F.date_format(d, "yyyy/MM/dd")))
    m3 = F.pmod(k, F.lit(3))
    addr = (F.when(m3 == 0, F.col("buyer_address"))
            .when(m3 == 1, F.regexp_replace("buyer_address", ", ", "\n"))
            .otherwise(F.concat(F.lit("  "), F.regexp_replace("buyer_address", ", ", " \r\n\n "), F.lit("\n"))))
    notes = F.when(F.pmod(k, F.lit(4)) == 3, F.lit("   ")).otherwise(F.col("notes"))
    return inv.select(
        "path",
        N.clean_number(money).alias("subtotal"),
        N.clean_number(pct).alias("tax_percent"),
        N.iso_date(date_txt).alias("invoice_date"),
        N.one_line_address(addr).alias("buyer_address"),
        N.unknown_to_null(notes).alias("notes"))


def grounding(spark, sf_dir):
    """Are each extracted item's words and numbers in the document text?
    The text lists only every other item; some texts break at every blank, and
    some have lost their numbers."""
    configure(spark)
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    text = F.when(F.pmod(k, F.lit(3)) == 0, F.replace(F.col("raw_text"), F.lit(" "), F.lit(" \n  "))).otherwise(F.col("raw_text"))
    text = F.when(F.pmod(k, F.lit(5)) == 1, F.regexp_replace(text, "[0-9]", "#")).otherwise(text)
    recs = extract_records(TB.clean_responses_with_text(spark, sf_dir, odd_lines_only=True).withColumn("raw_text", text))
    items = reshape.items_table(recs, with_line_no=True, text="raw_text")
    return items.select("path", "line_no", "description", "grounded", "numbers_grounded")


def _stub_client(outage: bool = True):
    """A stand-in model: answers with a fenced JSON object whose notes are the
    digest and length of the whole text; during an outage it fails on texts
    whose length is a multiple of 5."""
    def factory():
        def call(prompt: str) -> str:
            text = json.loads(prompt)["text"]
            if outage and len(text) % 5 == 0:
                raise RuntimeError("service unavailable")
            notes = f"{hashlib.sha256(text.encode()).hexdigest()}:{len(text)}"
            return "```json\n" + json.dumps({"notes": notes, "line_items": []}) + "\n```"
        return call
    return factory


def model_job(spark, sf_dir):
    """One call per document through a client; failures become
    `api_error` rows; responses are stored before the repair stage."""
    configure(spark)
    d = TB.table(spark, sf_dir, "documents")
    pr = d.select("doc_id", PR.json_prompt(F.col("text"), _hint(F.col("lang"))).alias("prompt"))
    resp = M.store_responses(M.model_job(pr, _stub_client(), key="doc_id"), _folder(spark, "responses"))
    ex = extract_records(resp)
    return ex.select("doc_id", "json_status", "valid", F.col("invoice.notes").alias("notes"))


def page_scan(spark, sf_dir):
    """Documents as files, every line a page of a PDF, images
    of one page; some files unreadable, some without pages.  Cut into parts
    where they are read, decoded and recognised once, spread over tasks,
    stored, then counted, observed and joined back in order."""
    configure(spark)
    files = _with_odd_files(_allowed(TB.documents_as_files(spark, sf_dir))).select("path", "length", "content")
    n = spark.sparkContext.defaultParallelism
    pages, seen = P.with_progress(P.page_job(files, _line_pages, P.identity_recogniser, pages_per_task=64, partitions=n))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "256"):
        stored = M.store_responses(pages, _folder(spark, "pages"))
    counts = P.page_counts(stored)
    bad = stored.filter("error is not null").select("path").distinct()
    text = P.join_pages(stored.join(bad, "path", "left_anti"), block_pages=32)
    return (S.file_details(S.file_metadata(files), counts).join(text, "path", "left")
            .select("path", "file_type", "pages", "page_errors", F.sha2("raw_text", 256).alias("text_sha256"),
                    F.lit(seen.get["pages_done"]).cast("bigint").alias("all_pages"),
                    F.lit(seen.get["page_errors"]).cast("bigint").alias("all_errors")))


def _with_odd_files(files):
    """Some files made unreadable (not UTF-8), some empty."""
    k = F.col("doc_id")
    content = (F.when(F.pmod(k, F.lit(11)) == 3, F.concat(F.unhex(F.lit("FF")), F.col("content")))
               .when(F.pmod(k, F.lit(13)) == 5, F.lit("").cast("binary")).otherwise(F.col("content")))
    return files.withColumn("content", content).withColumn("length", F.octet_length("content").cast("bigint"))


def _line_pages():
    return P.text_decoder("\n")


def _whole_pages():
    """Every line a page of a PDF; the one page of an image holds its whole text."""
    return P.text_decoder("\n", whole_images=True)


def incremental_job(spark, sf_dir):
    """S9, E2, X7, K3 across runs: the batch job over documents as files with
    an outage in the first run and a healthy second run; every file's
    published record, with the run that published it and both runs' counts."""
    configure(spark)
    files = _allowed(TB.documents_as_files(spark, sf_dir)).select("path", "modificationTime", "length", "content")
    out = _folder(spark, "incremental_job")
    runs = [J.process_files(spark, files, out, _whole_pages, P.identity_recogniser, _stub_client(outage), J.JobOptions(pages_per_task=64))
            for outage in (True, False)]
    records = J.read_published(spark, out, "records")
    return records.select(
        "path", "json_status", "valid", F.col("invoice.notes").alias("notes"),
        F.when(F.col("run") == runs[0]["run"], 1).otherwise(2).alias("attempt"),
        *[F.lit(r["summary"]["failures"].get("call", 0)).cast("bigint").alias(f"failed_contents_{k + 1}") for k, r in enumerate(runs)],
        *[F.lit(r["summary"]["new_files"]).cast("bigint").alias(f"files_{k + 1}") for k, r in enumerate(runs)])


def _exported(spark, sf_dir):
    """A new export folder holding the stored records of the whole batch."""
    configure(spark)
    out = _folder(spark, "exports")
    # written once, then every sink reads the stored records
    return out, writers.store_records(extract_records(TB.clean_responses(spark, sf_dir)), out + "/records")


def export_tables(spark, sf_dir):
    """Header, item and flat tables of the whole batch written;
    the flat one read back."""
    out, records = _exported(spark, sf_dir)
    back = spark.read.parquet(writers.write_tables(records, out, compression="zstd")["invoice_flat"])
    return back.select("path", "stem", *FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER,
                       F.coalesce(F.col("line_no"), F.lit(0)).alias("line_no"))


def export_header(spark, sf_dir):
    """The header table read back."""
    out, records = _exported(spark, sf_dir)
    return spark.read.parquet(writers.write_tables(records, out, only=["invoice_header"], compression="zstd")["invoice_header"])


def export_items(spark, sf_dir):
    """The item table read back."""
    out, records = _exported(spark, sf_dir)
    return spark.read.parquet(writers.write_tables(records, out, only=["line_items"], compression="zstd")["line_items"])


def export_csv(spark, sf_dir):
    """The flat table written as CSV and read back as text."""
    out, records = _exported(spark, sf_dir)
    flat = reshape.flat_table(records, with_line_no=True).withColumn("stem", writers.stem(F.col("path")))
    writers.write_flat_csv(flat.withColumn("line_no", F.coalesce(F.col("line_no"), F.lit(0))), out + "/csv", compression="gzip")
    schema = ", ".join(f"{c} string" for c in writers.csv_ready(flat).columns)
    back = spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(out + "/csv")
    return back.drop("extras")


def export_json(spark, sf_dir):
    """The records written as JSON lines with their nulls, each line
    read back as text."""
    out, records = _exported(spark, sf_dir)
    lines = spark.read.text(writers.write_records_json(records, out + "/json", compression="gzip"))
    one = F.from_json("value", "path string, stem string, valid boolean, invoice_number string, total double, "
                               "line_items array<struct<description:string,amount:double>>")
    return lines.select(one.alias("r"), "value").select(
        "r.path", "r.stem", "r.valid", "r.invoice_number", "r.total", F.size("r.line_items").alias("items"),
        F.array_join(F.transform("r.line_items", lambda i: i["description"]), "|").alias("descriptions"),
        F.contains("value", F.lit('"extras":null')).alias("nulls_kept"))


QUERIES = {
    "file_metadata": file_metadata,
    "file_scan": file_scan,
    "content_dedup": content_dedup,
    "compacted_history": compacted_history,
    "already_processed": already_processed,
    "select_files": select_files,
    "page_join": page_join,
    "preview": preview,
    "prompts": prompts,
    "rule_extract": rule_extract,
    "normalise": normalise,
    "grounding": grounding,
    "model_job": model_job,
    "page_scan": page_scan,
    "incremental_job": incremental_job,
    "export_tables": export_tables,
    "export_header": export_header,
    "export_items": export_items,
    "export_csv": export_csv,
    "export_json": export_json,
}


# --- reference SQL ------------------------------------------------------------

_EXTS = "['pdf', 'png', 'jpg', 'jpeg', 'tiff', 'PDF', 'txt']"
_FILES = f"""
WITH f AS (
  SELECT doc_id, text, lang, {_EXTS}[doc_id % 7 + 1] AS ext,
         'docs/' || CAST(doc_id AS VARCHAR) || '.' || {_EXTS}[doc_id % 7 + 1] AS path
  FROM documents
), fa AS (SELECT * FROM f WHERE lower(ext) IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff'))
"""

_ODD = _FILES.rstrip() + """, odd0 AS (
  SELECT *, lower(ext) = 'pdf' AS pdf, len(string_split(text, chr(10))) AS lines,
    CASE lower(ext) WHEN 'pdf' THEN 'PDF' WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG' WHEN 'jpeg' THEN 'JPEG' WHEN 'tiff' THEN 'TIFF' END AS label,
    CASE WHEN doc_id % 11 = 3 THEN 'broken' WHEN doc_id % 13 = 5 THEN 'empty' ELSE 'fine' END AS state
  FROM fa
), odd AS (SELECT *, CASE WHEN state = 'broken' OR (state = 'empty' AND NOT pdf) THEN 1 ELSE 0 END AS bad FROM odd0)
"""

# The numbers of each order's text, which lists items 1, 3, 5, ...; some texts have lost theirs.
_NUMBERS = r"""
, listed AS (
  SELECT l_orderkey, string_agg('Item ' || p_name || ' ' || regexp_replace(CAST(l_quantity AS VARCHAR), '\.0$', '') || ' x '
                                || printf('%.2f', p_retailprice) || ' ' || printf('%.2f', l_extendedprice), chr(10)) AS items
  FROM lines WHERE line_no % 2 = 1 GROUP BY 1
), texts AS (
  SELECT i.o_orderkey, concat_ws(chr(10), 'No: ' || i.invoice_number, 'Date: ' || i.invoice_date, i.vendor_name, 'GSTIN ' || i.vendor_gstin,
    i.buyer_name, 'GSTIN ' || i.buyer_gstin, t.items, printf('%.2f', i.subtotal), CAST(i.tax_percent AS VARCHAR) || '%',
    printf('%.2f', i.tax_amount), printf('%.2f', i.total)) AS raw_text
  FROM inv i LEFT JOIN listed t ON t.l_orderkey = i.o_orderkey
), numbers AS (
  SELECT o_orderkey, [TRY_CAST(replace(x, ',', '') AS DOUBLE) FOR x IN
    regexp_extract_all(CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE raw_text END, '-?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?')] AS numbers
  FROM texts
)
"""

_HINT_SQL = "CASE lang WHEN 'en' THEN 'USD' WHEN 'fr' THEN 'EUR' WHEN 'de' THEN 'EUR' ELSE '' END"


def _oracle() -> dict[str, str]:
    from .oracle import _WITH, ORACLE as INV  # the derived invoices
    return {
        "file_metadata": _FILES + """
SELECT path, CAST(doc_id AS VARCHAR) || '.' || ext AS name, CAST(doc_id AS VARCHAR) AS stem,
  CASE WHEN lower(ext) = 'pdf' THEN 'pdf' ELSE 'image' END AS kind,
  CASE lower(ext) WHEN 'pdf' THEN 'PDF' WHEN 'png' THEN 'PNG' WHEN 'jpg' THEN 'JPEG'
       WHEN 'jpeg' THEN 'JPEG' WHEN 'tiff' THEN 'TIFF' END AS file_type,
  round_even(octet_length(encode(text)) / 1024.0, 1) AS size_kb
FROM fa""",
        "file_scan": f"""
WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS stem, text, {MIXED_EXTENSIONS}[doc_id % {len(MIXED_EXTENSIONS)} + 1] AS ext FROM documents)
SELECT stem || '.' || ext AS name, stem, CASE lower(ext) WHEN 'pdf' THEN 'pdf' ELSE 'image' END AS kind,
  CASE lower(ext) WHEN 'jpg' THEN 'JPEG' ELSE upper(ext) END AS file_type, round_even(octet_length(encode(text)) / 1024.0, 1) AS size_kb,
  sha256(text) AS content_sha, (SELECT count(*) FROM documents) AS written
FROM f WHERE lower(ext) IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff')""",
        "compacted_history": _FILES + """, r AS (SELECT *, doc_id % 8 AS run, min(doc_id % 8) OVER (PARTITION BY text) AS first_run FROM fa)
SELECT path, sha256(text) AS content_sha, min(CASE WHEN run = first_run THEN path END) OVER (PARTITION BY text) AS first_path,
  CAST(first_run AS INTEGER) AS run, CAST(4 AS BIGINT) AS segments, CAST(4 AS BIGINT) AS folders
FROM r""",
        "content_dedup": _FILES + """
SELECT path, sha256(text) AS content_sha, min(path) OVER (PARTITION BY text) AS rep_path FROM fa""",
        "already_processed": _FILES + """
SELECT path, doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
        "select_files": _FILES + """
SELECT path, doc_id FROM f WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
        "page_join": """
SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS raw_text
FROM conversations GROUP BY conv_id""",
        "preview": "SELECT doc_id, substring(text, 1, 20000) AS preview FROM documents",
        "prompts": f"""
SELECT doc_id, text IS NOT NULL AS json_text_ok, {_HINT_SQL} AS currency,
  sha256($${JSON_HEAD}$$ || {_HINT_SQL} || $${JSON_TAIL}$$ || CAST(to_json(text) AS VARCHAR) || '}}') AS json_sha256,
  sha256($${PLAIN_HEAD}$$ || {_HINT_SQL} || $${PLAIN_TAIL}$$ || text) AS plain_sha256
FROM documents""",
        "rule_extract": _WITH + """
SELECT i.path, i.vendor_name, i.vendor_gstin, i.invoice_number, i.invoice_date, i.buyer_name,
  i.buyer_gstin, CASE WHEN i.o_orderkey % 3 = 2 THEN 'CHF' ELSE coalesce(i.currency, 'CHF') END AS currency,
  i.subtotal, i.tax_percent, i.tax_amount, i.total,
  l.p_name AS description, l.l_quantity AS quantity, l.p_retailprice AS unit_price,
  l.l_extendedprice AS amount, CAST(coalesce(l.line_no, 0) AS INTEGER) AS line_no
FROM inv i LEFT JOIN lines l ON l.l_orderkey = i.o_orderkey""",
        "normalise": _WITH + """
SELECT i.path, i.subtotal, i.tax_percent, i.invoice_date, i.buyer_address,
  CASE WHEN i.o_orderkey % 4 = 3 THEN NULL ELSE i.notes END AS notes
FROM inv i""",
        "grounding": _WITH + _NUMBERS + """
SELECT 'orders/' || CAST(l.l_orderkey AS VARCHAR) || '.pdf' AS path,
  CAST(l.line_no AS INTEGER) AS line_no, l.p_name AS description,
  EXISTS (SELECT 1 FROM lines l2 WHERE l2.l_orderkey = l.l_orderkey AND l2.line_no % 2 = 1
          AND strpos(' ' || lower(l2.p_name) || ' ', ' ' || lower(l.p_name) || ' ') > 0) AS grounded,
  (l.l_quantity IS NULL OR list_contains(n.numbers, l.l_quantity))
    AND (l.p_retailprice IS NULL OR list_contains(n.numbers, l.p_retailprice))
    AND (l.l_extendedprice IS NULL OR list_contains(n.numbers, l.l_extendedprice)) AS numbers_grounded
FROM lines l LEFT JOIN numbers n ON n.o_orderkey = l.l_orderkey""",
        "model_job": """
SELECT doc_id,
  CASE WHEN length(text) % 5 = 0 THEN 'api_error' ELSE 'sliced' END AS json_status,
  length(text) % 5 <> 0 AS valid,
  CASE WHEN length(text) % 5 = 0 THEN NULL
       ELSE sha256(text) || ':' || CAST(length(text) AS VARCHAR) END AS notes
FROM documents""",
        "page_scan": _ODD + """
SELECT path, CASE WHEN pdf AND state = 'broken' THEN 'Unknown' ELSE label END AS file_type,
  CAST(CASE WHEN NOT pdf THEN 1 WHEN state = 'broken' THEN NULL WHEN state = 'empty' THEN 0 ELSE lines END AS DOUBLE) AS pages,
  CAST(bad AS BIGINT) AS page_errors,
  sha256(CASE WHEN bad = 1 THEN NULL WHEN state = 'empty' THEN '' WHEN pdf THEN text ELSE string_split(text, chr(10))[1] END) AS text_sha256,
  CAST(sum(CASE WHEN state <> 'fine' THEN 0 WHEN pdf THEN lines ELSE 1 END) OVER () AS BIGINT) AS all_pages,
  CAST(sum(bad) OVER () AS BIGINT) AS all_errors
FROM odd""",
        "incremental_job": _FILES + """
SELECT path, 'sliced' AS json_status, true AS valid, sha256(text) || ':' || CAST(length(text) AS VARCHAR) AS notes,
  CAST(CASE WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt,
  (SELECT count(*) FROM fa WHERE length(text) % 5 = 0) AS failed_contents_1, CAST(0 AS BIGINT) AS failed_contents_2,
  (SELECT count(*) FROM fa) AS files_1, (SELECT count(*) FROM fa WHERE length(text) % 5 = 0) AS files_2
FROM fa""",
        "export_tables": INV["flat_rows"].replace("SELECT i.path,", f"SELECT i.path, {_STEM},", 1),
        "export_header": INV["header_fields"].replace("SELECT i.path,", f"SELECT i.path, {_STEM},", 1),
        "export_items": INV["line_items"].replace("SELECT i.path,", f"SELECT i.path, {_STEM},", 1),
        "export_csv": _csv_sql(INV["flat_rows"]),
        "export_json": _WITH + f"""
SELECT i.path, {_STEM}, true AS valid, i.invoice_number, i.total, CAST(i.n_lines AS INTEGER) AS items,
  coalesce((SELECT string_agg(l.p_name, '|' ORDER BY l.line_no) FROM lines l WHERE l.l_orderkey = i.o_orderkey), '') AS descriptions,
  true AS nulls_kept
FROM inv i""",
    }


_STEM = "CAST(i.o_orderkey AS VARCHAR) AS stem"


def _csv_sql(flat_rows: str) -> str:
    """The flat rows as the CSV's text: doubles in plain decimals, empty texts and nulls alike null."""
    inner = flat_rows.replace("SELECT i.path,", f"SELECT i.path, {_STEM},", 1)
    head, _, select = inner.rpartition("\nSELECT ")
    texts = ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in
                      ["path", "stem", *FLAT_HEADER_ORDER, *FLAT_ITEM_ORDER, "line_no"])
    return f"{head}\nSELECT {texts} FROM (SELECT {select}) t"


def oracle():
    return _oracle()
