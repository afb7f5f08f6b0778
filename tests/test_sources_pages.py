"""S1-S9, K4, K5, T1, T2 on small files written here."""

import os
from contextlib import ExitStack

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import pages as P
from ledgerlake.session import setting
from ledgerlake.sources import files as S


def _write(d, name, data):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_scan_metadata_and_dedup(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "a.PDF", b"x" * 256)
    _write(d, "b.jpg", b"y" * 768)
    _write(d, "c.tiff", b"x" * 256)
    _write(d, "d.txt", b"z" * 1280)
    _write(d, "e.jpeg", b"q" * 52)
    files = S.scan_files(spark, d)
    meta = {r.name: r for r in S.file_metadata(files).collect()}
    assert sorted(meta) == ["a.PDF", "b.jpg", "c.tiff", "e.jpeg"]
    assert [meta[n].file_type for n in ["a.PDF", "b.jpg", "c.tiff", "e.jpeg"]] == ["PDF", "JPEG", "TIFF", "JPEG"]
    assert [meta[n].size_kb for n in ["a.PDF", "b.jpg", "e.jpeg"]] == [0.2, 0.8, 0.1]
    assert meta["a.PDF"].kind == "pdf" and meta["b.jpg"].kind == "image" and meta["a.PDF"].stem == "a"
    rep = {os.path.basename(r.path): os.path.basename(r.rep_path)
           for r in S.representative(S.with_content_key(files), str(tmp_path / "unique")).collect()}
    assert rep["c.tiff"] == rep["a.PDF"] and rep["b.jpg"] == "b.jpg"


def test_hot_content_is_split(spark, tmp_path):
    """Two thirds of the files share one content: the join back splits it."""
    files = spark.range(400_000).select(
        F.concat(F.lit("docs/"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"),
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content_sha"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "1m"}
    with ExitStack() as stack:
        for k, v in conf.items():
            stack.enter_context(setting(spark, k, v))
        rep = S.representative(files.repartition(16), str(tmp_path / "unique"))
        n = rep.groupBy().agg(F.count("*").alias("n"), F.countDistinct("rep_path").alias("d"), F.max("path").alias("p"))
        assert [tuple(r) for r in n.collect()] == [(400_000, 133_333 + 1, "docs/99999.pdf")]
        assert "SortMergeJoin(skew=true)" in n._jdf.queryExecution().executedPlan().toString()


def test_size_rounding(spark):
    df = spark.createDataFrame([(256,), (768,), (1280,), (51,), (52,)], "length long")
    assert [r.s for r in df.select(S.size_kb(F.col("length")).alias("s")).collect()] == [0.2, 0.8, 1.2, 0.0, 0.1]


def test_anti_and_semi(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, doc_id long")
    done = spark.createDataFrame([(2,)], "doc_id long")
    assert [r.path for r in S.not_yet_processed(files, done, "doc_id").orderBy("path").collect()] == ["a", "c"]
    assert [r.path for r in S.select_files(files, done, "doc_id").collect()] == ["b"]


def test_page_job_text_and_errors(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "one.pdf", "first\fsecond\f\fäfter".encode())
    _write(d, "bad.pdf", b"\xff\xfe")
    files = S.scan_files(spark, d)
    pages, obs = P.with_progress(P.page_job(files, P.text_decoder, P.identity_recogniser))
    rows = pages.collect()
    assert obs.get["pages_done"] == 4 and obs.get["page_errors"] == 1
    good = sorted((r.page_no, r.page_text) for r in rows if r.path.endswith("one.pdf"))
    assert good == [(1, "first"), (2, "second"), (3, ""), (4, "äfter")]
    bad = [r for r in rows if r.path.endswith("bad.pdf")]
    assert len(bad) == 1 and bad[0].page_no is None and bad[0].error.startswith("decode:")
    text = P.join_pages(pages.filter(F.col("page_no").isNotNull()), block_pages=2).collect()
    assert [r.raw_text for r in text] == ["first\nsecond\n\näfter"]


def test_page_job_setup_failure_is_rows(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "x.png", b"123")

    def broken(*lang):
        raise RuntimeError("no engine")
    for size in (None, 4):
        for dec, rec in ((P.text_decoder, broken), (broken, P.identity_recogniser)):
            rows = P.page_job(S.scan_files(spark, d), dec, rec, pages_per_task=size, partitions=2).collect()
            assert len(rows) == 1 and rows[0].error.startswith("setup:")


def test_parts_hold_their_own_bytes(spark):
    text = "\f".join(f"page {i}" for i in range(10)).encode()
    df = spark.createDataFrame([("a", text, "pdf")], "_key string, _content binary, _kind string")
    parts = P._parts(df, P.text_decoder, df.schema["_key"].dataType, 4).orderBy("_first").collect()
    assert [(r._first, bytes(r._content)) for r in parts] == [
        (0, b"page 0\fpage 1\fpage 2\fpage 3"), (4, b"page 4\fpage 5\fpage 6\fpage 7"), (8, b"page 8\fpage 9")]


def test_join_pages_order_and_nulls(spark):
    pages = spark.createDataFrame(
        [("d", 3, "c"), ("d", 1, "a"), ("d", 2, None), ("d", 10, "j"), ("e", 1, "z")],
        "path string, page_no int, page_text string")
    for block in (1, 2, 256):
        got = {r.path: r.raw_text for r in P.join_pages(pages, block_pages=block).collect()}
        assert got == {"d": "a\n\nc\nj", "e": "z"}


def test_preview(spark):
    df = spark.createDataFrame([("é" * 20005,)], "t string")
    assert len(df.select(P.preview(F.col("t")).alias("p")).collect()[0].p) == 20000


def test_extension_glob():
    assert S.extension_glob(["pdf"]) == "*.{[pP][dD][fF]}"


def test_page_ranges_split_long_document(spark, tmp_path):
    d = str(tmp_path)
    pages = [f"page {i} é" for i in range(1, 11)]
    _write(d, "long.pdf", "\f".join(pages).encode())
    _write(d, "short.pdf", b"only")
    _write(d, "bad.pdf", b"\xff\xfe")
    files = S.scan_files(spark, d)
    out = P.page_job(files, P.text_decoder, P.identity_recogniser, pages_per_task=3, partitions=4)
    rows = out.collect()
    long_rows = sorted((r.page_no, r.page_text) for r in rows if r.path.endswith("long.pdf"))
    assert long_rows == [(i, f"page {i} é") for i in range(1, 11)]
    assert [(r.page_no, r.page_text) for r in rows if r.path.endswith("short.pdf")] == [(1, "only")]
    bad = [r for r in rows if r.path.endswith("bad.pdf")]
    assert len(bad) == 1 and bad[0].error.startswith("decode:")
    text = {r.path.rsplit("/", 1)[1]: r.raw_text
            for r in P.join_pages(out.filter(F.col("page_no").isNotNull()), block_pages=4).collect()}
    assert text["long.pdf"] == "\n".join(pages)


def test_split_that_fails_midway_is_a_row(spark, tmp_path):
    class Damaged:
        """Good pages, then bytes that cannot be read; parts of at most two pages."""

        def __call__(self, content, kind, dpi):
            for page in content.decode().split("\f"):
                if page == "damaged":
                    raise ValueError("damaged")
                yield page

        def split(self, content, kind, pages):
            parts = content.decode().split("\f")
            for i in range(0, len(parts), pages):
                if "damaged" in parts[i:i + pages]:
                    raise ValueError("damaged")
                yield i, "\f".join(parts[i:i + pages]).encode()

    d = str(tmp_path)
    _write(d, "cut.pdf", b"one\ftwo\fdamaged")
    _write(d, "good.pdf", b"a\fb\fc")
    found = {}
    for size in (None, 2):
        rows = P.page_job(S.scan_files(spark, d), Damaged, P.identity_recogniser, pages_per_task=size, partitions=2).collect()
        found[size] = sorted((r.path.rsplit("/", 1)[1], r.page_no or 0, r.page_text or "", r.error or "") for r in rows)
    assert found[2] == found[None] == [
        ("cut.pdf", 0, "", "decode: ValueError: damaged"), ("cut.pdf", 1, "one", ""), ("cut.pdf", 2, "two", ""),
        ("good.pdf", 1, "a", ""), ("good.pdf", 2, "b", ""), ("good.pdf", 3, "c", "")]


@pytest.mark.parametrize("size", [None, 1])
def test_an_image_is_one_page(spark, tmp_path, size):
    class Counting:
        """Endless pages; says when it was closed."""

        def __call__(self, content, kind, dpi):
            k = 0
            try:
                while k < 3:
                    k += 1
                    yield f"page {k}"
                raise ValueError("read on")
            finally:
                with open(content.decode(), "a") as f:
                    f.write(f"closed after {k}\n")

        def split(self, content, kind, pages):
            raise AssertionError("an image is not cut")

    log = str(tmp_path / f"log{size}")
    files = spark.createDataFrame([("a.png", bytearray(log.encode()))], "path string, content binary")
    rows = P.page_job(files, Counting, P.identity_recogniser, pages_per_task=size, partitions=1).collect()
    assert [(r.page_no, r.page_text, r.error) for r in rows] == [(1, "page 1", None)]
    assert open(log).read() == "closed after 1\n"


@pytest.mark.parametrize("size", [None, 2])
def test_files_without_pages(spark, size):
    """A document without pages has an empty text and no error; an image without one cannot be read."""
    files = spark.createDataFrame([("a.pdf", b""), ("b.png", b""), ("c.pdf", b"x\fy\fz"), ("d.pdf", b"\xff")], "path string, content binary")
    pages = P.page_job(files, P.text_decoder, P.identity_recogniser, pages_per_task=size, partitions=2)
    assert {r.path: (r.pages, r.page_errors) for r in P.page_counts(pages).collect()} == {
        "a.pdf": (0, 0), "b.png": (None, 1), "c.pdf": (3, 0), "d.pdf": (None, 1)}
    good = P.join_pages(pages.filter("error is null"), block_pages=2)
    assert {r.path: r.raw_text for r in good.collect()} == {"a.pdf": "", "c.pdf": "x\ny\nz"}
    details = S.file_details(S.file_metadata(files.withColumn("length", F.octet_length("content"))), P.page_counts(pages))
    assert {r.path: (r.file_type, r.pages) for r in details.collect()} == {
        "a.pdf": ("PDF", 0), "b.png": ("PNG", 1), "c.pdf": ("PDF", 3), "d.pdf": ("Unknown", None)}


@pytest.mark.parametrize("size", [None, 2])
def test_bytes_are_shuffled_once(spark, size):
    files = spark.createDataFrame([("a.pdf", b"x")], "path string, content binary")
    pages = P.page_job(files, P.text_decoder, P.identity_recogniser, pages_per_task=size, partitions=2)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
