"""The whole batch on a small folder: text-born 'PDF' files (pages split at
form feeds), a duplicate, an unreadable file and a file type that is not
accepted; then further runs: retries, a failing writer, another language."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import pages as P
from ledgerlake.plans import invoice_job as J
from ledgerlake.plans.invoice_job import JobOptions, run_invoice_job

PAGE1 = "INVOICE\nNo: INV-7\nDate: 2024-05-06\nVendor: Bolt Co GSTIN 11AAAAA1111A1Z1\nBill To: Nut Ltd GSTIN 22BBBBB2222B2Z2"
PAGE2 = "Item Steel bolt 4 x 2.50 10.00\nItem Nut 1 x 5.00 5.00\nSubtotal 15.00\nGST 10% 1.50\nTotal EUR 16.50"


def _write(d, name, data):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)


def _read(spark, out, name):
    return J.read_published(spark, out, name)


def test_batch_end_to_end(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    doc = (PAGE1 + "\f" + PAGE2).encode()
    _write(src, "a.pdf", doc)
    _write(src, "copy_of_a.PDF", doc)
    _write(src, "broken.pdf", b"\xff\xfe\xfa")
    _write(src, "notes.txt", b"ignored")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    done = run_invoice_job(spark, src, out, P.text_decoder, P.identity_recogniser,
                           options=JobOptions(partitions=2, ground_items=True))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert done["summary"] == {"files": 3, "new_files": 3, "records": {("ok", True): 2}, "failures": {"pages": 1},
                               "pages_done": 2, "page_errors": 1, "rows": 3}
    rows = _read(spark, out, "invoice_flat").filter(F.col("path").endswith("/a.pdf")).orderBy("line_no").collect()
    assert [(r.description, r.quantity, r.amount) for r in rows] == [("Steel bolt", 4.0, 10.0), ("Nut", 1.0, 5.0)]
    assert rows[0].vendor_name == "Bolt Co" and rows[0].total == 16.5 and rows[0].stem == "a"
    assert _read(spark, out, "invoice_flat").filter(F.col("path").endswith("copy_of_a.PDF")).count() == 2
    assert {r.grounded for r in _read(spark, out, "line_items").collect()} == {True}
    assert {r.preview for r in _read(spark, out, "previews").collect()} == {PAGE1 + "\n" + PAGE2}
    assert all("\n" in r.json for r in _read(spark, out, "invoice_json_pretty").collect())
    metrics = {os.path.basename(r.path): r for r in _read(spark, out, "file_metrics").collect()}
    assert sorted(metrics) == ["a.pdf", "broken.pdf", "copy_of_a.PDF"]
    assert metrics["a.pdf"].pages == 2 and metrics["a.pdf"].line_items_count == 2
    assert metrics["broken.pdf"].file_type == "Unknown" and metrics["broken.pdf"].pages is None
    assert [(r.stage, r.error[:7]) for r in _read(spark, out, "failures").collect()] == [("pages", "decode:")]
    # the same content was decoded once
    assert spark.read.parquet(done["page_text"]).count() == 2

    # second run: the unreadable file is tried again (and mended here), nothing else
    _write(src, "broken.pdf", (PAGE1 + "\f" + PAGE2).replace("Nut", "Nail").encode())
    again = run_invoice_job(spark, src, out, P.text_decoder, P.identity_recogniser, options=JobOptions(partitions=2, ground_items=True))
    assert again["summary"]["new_files"] == 1 and again["summary"]["pages_done"] == 2
    assert _read(spark, out, "invoice_flat").count() == 6


def test_failed_calls_are_retried(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    _write(src, "x.png", b"hello")
    _write(src, "y.png", b"fail me")

    def client_factory(outage):
        def factory():
            def call(prompt):
                if outage and "fail" in prompt:
                    raise RuntimeError("quota")
                return "```json\n{\"notes\": \"seen\", \"total\": \"12.5\"}\n```"
            return call
        return factory
    o = JobOptions(partitions=2, prompt_style="plain", currency_hint="USD")
    args = (spark, src, out, P.text_decoder, P.identity_recogniser)
    first = run_invoice_job(*args, client_factory(True), options=o)
    recs = {os.path.basename(r.path): r for r in _read(spark, out, "records").collect()}
    assert list(recs) == ["x.png"] and recs["x.png"].json_status == "sliced" and recs["x.png"].invoice.total == 12.5
    assert first["summary"]["failures"] == {"call": 1}
    second = run_invoice_job(*args, client_factory(False), options=o)
    assert second["summary"]["new_files"] == 1 and second["summary"]["rows"] == 0  # no page decoded again
    assert sorted(os.path.basename(r.path) for r in _read(spark, out, "records").collect()) == ["x.png", "y.png"]
    third = run_invoice_job(*args, client_factory(True), options=o)
    assert third["summary"]["new_files"] == 0 and _read(spark, out, "records").count() == 2


def test_failure_before_publishing_leaves_no_rows_twice(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    _write(src, "a.pdf", (PAGE1 + "\f" + PAGE2).encode())
    args = (spark, src, out, P.text_decoder, P.identity_recogniser)
    with monkeypatch.context() as m:
        m.setattr(J.writers, "write_records_json", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_invoice_job(*args, options=JobOptions(partitions=2))
    assert J.published_runs(spark, out) == [] and len(J.published_runs(spark, out, "responses")) == 1
    done = run_invoice_job(*args, options=JobOptions(partitions=2))
    assert done["summary"]["rows"] == 0  # pages and responses of the failed run are used
    for name, n in (("invoice_flat", 2), ("invoice_header", 1), ("records", 1), ("file_metrics", 1)):
        assert _read(spark, out, name).count() == n


def test_other_language_is_read_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    _write(src, "a.png", b"text")
    tagged = lambda lang: lambda page: f"{lang} {page}"
    for lang in ("eng", "deu", "eng"):
        run_invoice_job(spark, src, out, P.text_decoder, tagged, options=JobOptions(partitions=2, lang=lang))
    assert sorted(r.preview for r in _read(spark, out, "previews").collect()) == ["deu text", "eng text"]


def test_storage_errors_are_raised(spark, tmp_path):
    with pytest.raises(Exception):
        J.published_runs(spark, "nosuchfs://there/out")


def test_incremental_job_reads_the_whole_text_of_images(spark, tmp_path):
    import hashlib
    from ledgerlake.plans.document_queries import incremental_job
    texts = {0: "a pdf\nof two pages", 1: "an image\nwith a second line", 2: "one line"}
    spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = incremental_job(spark, str(tmp_path)).collect()
    assert {r.path: r.notes for r in rows} == {f"docs/{k}.{e}": f"{hashlib.sha256(t.encode()).hexdigest()}:{len(t)}"
                                               for (k, t), e in zip(texts.items(), ["pdf", "png", "jpg"])}


def test_pieces_read_the_files_and_the_history_once(spark, tmp_path):
    """every piece read all files and all published pages."""
    read, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(content):
        read.add(1)
        return content

    def client_factory(outage):
        def call(prompt):
            asked.add(1)
            if outage:
                raise RuntimeError("quota")
            return '{"notes": "seen"}'
        return lambda: call

    texts = {f"f/{i}.pdf": f"page {i}\fsecond {i}" for i in range(6)} | {"f/copy.pdf": "page 0\fsecond 0", "f/none.pdf": None, "f/bad.pdf": "\xff"}
    rows = [(p, len(t or ""), None if t is None else t.encode("latin-1")) for p, t in texts.items()]
    files = spark.createDataFrame(rows, "path string, length bigint, content binary").coalesce(1)
    files = files.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), "length", counted("content").alias("content"))
    out, o = str(tmp_path / "out"), JobOptions(partitions=2, piece_contents=1, on_error="empty")
    args = (spark, files, out, P.text_decoder, P.identity_recogniser)
    first = J.process_files(*args, client_factory(True), o)
    assert read.value == 2 * len(rows)  # hashed, then laid out by piece
    assert first["summary"]["pages_done"] == 12 and first["summary"]["failures"] == {"call": 7, "pages": 1} and asked.value == 6
    second = J.process_files(*args, client_factory(False), o)
    assert second["summary"]["rows"] == 1 and second["summary"]["records"] == {("ok", True): 7} and asked.value == 12  # the bad file is tried again
    previews = {r.path: r.preview for r in _read(spark, out, "previews").filter("preview is not null").dropDuplicates(["path"]).collect()}
    assert previews == {p: t.replace("\f", "\n") for p, t in texts.items() if t and p != "f/bad.pdf"}
    metrics = _read(spark, out, "file_metrics").filter(F.col("run") == second["run"]).collect()
    assert {r.path: r.pages for r in metrics} == {p: None if p in ("f/bad.pdf", "f/none.pdf") else 2 for p in texts}
