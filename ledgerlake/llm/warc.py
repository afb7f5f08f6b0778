"""WARC archives: writing through Spark's text sink, and a reader that salvages damaged files.

Writing: every record is one value of a text file whose line separator is the
blank lines that end a WARC record, so Spark's own committer publishes plain,
valid archives on any file system Spark writes to.

Reading: files come as binary rows and are walked record by record; gzip
members (one a record, or one a file) are unpacked on the way.  A record must
have a version line, headers, a length that fits, its closing blank lines and,
where headers tell it, the right block digest.  If a check fails, the reader searches
for the next valid gzip member or version line, goes on from there, and logs
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store

REVISIT_BYTES = 1000
FILE_RECORDS = 5_000
FILE_BYTES = 1 << 30  # most bytes of a file, unless one record alone is larger: files are read whole
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_CLOSE = re.compile(rb"\r?\n\r?\n")
_DIGEST_LINE = re.compile(rb"(?im)^[^\n:]*warc-block-digest[^\n:]*:")
_MAGIC = b"\x1f\x8b\x08"
_CRLF2 = "\r\n\r\n"


def with_revisits(pages: DataFrame, store: Store, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is the largest id among equal
    payloads of at least `least_bytes` bytes, null for that record itself and for all shorter ones.

    Payload sizes and digests are written once; equal payloads meet in map-side partial
    aggregates, and the join back goes against that written table, so a payload that very many pages share is split
    over tasks.  Rows with a null id never become the original of others."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
                        F.sha1(payload.cast("binary")).alias("payload_digest"))
    sizes = store.write(rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
                        .agg(F.max("page_id").alias("original"), F.count("page_id").alias("c")), "sizes")
    # Written by itself: the join then knows how few these are.
    groups = store.write(sizes.filter("c > 1").select("payload_digest", "original"), "originals")
    return (rows.join(groups, "payload_digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= least_bytes),
                                            F.col("original"))).drop("original"))


def _uri(prefix: str, ident):
    return F.concat(F.lit(f"<urn:{prefix}:"), F.coalesce(ident.cast("string"), F.lit("none")), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """One column `value`: the record of each row of `with_revisits`, without its closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_CRLF2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    # Control characters cannot stand in a header line.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _uri("page", F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
                                       "\r\nWARC-Refers-To: "), _uri("page", F.col("refers_to")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Block-Digest: sha1:"), F.sha1(block.cast("binary")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(_CRLF2))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, store: Store, *, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES,
                   **columns) -> None:
    """Writes plain WARC files under `path`, of at most `file_records` records and, by the size of the longest one, `file_bytes` bytes.

    Null payloads and urls are empty; repeated rows are records of their own, of which all but one with the largest id
    revisit it, and rows with equal ids and payloads are all responses; a null id is written as `none`.  An empty table gives no
    record.  Very long payloads are one record each.  Other columns are ignored, whatever their names."""
    rows = with_revisits(pages, store, **columns)
    longest = 4096 + (store.spark.read.parquet(store.path("sizes")).agg(F.max("payload_bytes")).first()[0] or 0)
    (records(rows).write.option("lineSep", _CRLF2)
     .option("maxRecordsPerFile", max(1, min(file_records, file_bytes // longest))).text(path))


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(unpacked bytes, end, whole) of the gzip member at a place; of a damaged one what could be unpacked."""
    d, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not d.eof and at < len(data):
            for i in range(at, min(at + 65536, len(data)), 4096):  # small steps: what precedes the damage is kept
                out.append(d.decompress(view[i:i + 4096]))
                if d.eof:
                    return b"".join(out), min(i + 4096, len(data)) - len(d.unused_data), True
            at += 65536
    except zlib.error:
        pass
    return b"".join(out), at, False


def _headers(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(headers, where the block begins, "") from the header lines at a place; or (None, place, reason), where no
    version line before that place can have valid headers."""
    headers = {}
    while (nl := data.find(b"\n", at)) >= 0:
        line = data[at:nl].strip()
        if not line and nl - at <= 1:
            return headers, nl + 1, ""
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        at = nl + 1
    return None, len(data), "headers without end"


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, reason): the record whose version line is at a place; or (None, place, reason), where no record
    can begin before that place.

    Lines are read until the first that is no header.  Version lines before it meet the same line, and version lines among
    complete headers that fail have the same block, so none of them is tried again: damaged files are read once."""
    v = _VERSION_LINE.match(data, at)
    if not v:
        return None, at + 1, "no version line"
    headers, start, why = _headers(data, v.end())
    if headers is None:
        return None, max(at + 1, start), why
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        return None, start, "no type or record id"
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, start, "no length"
    end = start + int(length[:18])
    if end > len(data):
        return None, start, "record cut off"
    close = _CLOSE.match(data, end)
    if not close:
        return None, start, "length does not fit"
    block = data[start:end]
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and not _is_sha1(block, want.strip()):
        # A version line after the digest's own line would go without it.
        return None, v.end() + [m.start() for m in _DIGEST_LINE.finditer(data[v.end():start])][-1], "block digest differs"
    return {"headers": headers, "block": block}, close.end(), ""


def _is_sha1(block: bytes, want: str) -> bool:
    """Is the digest, in hex or base32, that of the block?  Digests of other forms say nothing."""
    if len(want) == 40:
        return hashlib.sha1(block).hexdigest() == want.lower()
    return len(want) != 32 or base64.b32encode(hashlib.sha1(block).digest()).decode() == want.upper()


def _plain(data: bytes, offset: int | None = None):
    """Records and gaps of unpacked bytes; every place is reported at `offset` for packed ones."""
    at = 0
    while at < len(data):
        r, end, why = _record(data, at)
        where = at if offset is None else offset
        if r:
            yield "record", where, end if offset is None else offset, r
            at = end
            continue
        nxt = end
        while (m := _VERSION_LINE.search(data, nxt)) and not (r := _record(data, m.start()))[0]:
            nxt = r[1]
        to = m.start() if m else len(data)
        yield "gap", where, to if offset is None else offset + to - at, why
        at = to


def salvage(data: bytes):
    """Yields ("record", start, end, record) and ("gap", start, end, reason) over a whole file."""
    if data[:3] != _MAGIC and _MAGIC not in data:
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        if data.startswith(_MAGIC, at):
            out, end, whole = _member(data, at)
            if whole:
                yield from _plain(out, at)
                at = end
                continue
            # Complete records before the damage are kept; the gap says that bytes of the member are lost.
            yield from (x for x in _plain(out, at) if x[0] == "record")
        elif (r := _record(data, at))[0]:
            yield "record", at, r[1], r[0]
            at = r[1]
            continue
        to, g, v = len(data), at, at
        while True:
            g, m = data.find(_MAGIC, max(g, at + 1)), _VERSION_LINE.search(data, max(v, at + 1))
            places = [p for p in (g, m.start() if m else -1) if p >= 0]
            if not places:
                break
            p = min(places)
            if p == g:
                if _member(data, p)[2]:
                    to = p
                    break
                g = p + 1
            else:
                r = _record(data, p)
                if r[0]:
                    to = p
                    break
                v, g = r[1], max(g, p)
            if g < 0:
                g = len(data)
        yield "gap", at, to, "damaged member" if data.startswith(_MAGIC, at) else "no record"
        at = to


_ROW = ("file string, start bigint, end bigint, type string, record_id string, target_uri string, refers_to string, "
        "payload_digest string, payload_bytes bigint, payload binary, gap string")
_HTTP_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)")


def _row(path: str, what: str, a: int, b: int, x) -> dict:
    if what == "gap":
        return {"file": path, "start": a, "end": b, "gap": x}
    h, block = x["headers"], x["block"]
    http, sep, payload = block.partition(b"\r\n\r\n") if "application/http" in h.get("content-type", "") else (b"", b"", block)
    if h.get("warc-type") == "revisit":
        m = _HTTP_LENGTH.search(http)
        n, digest, payload = int(m[1]) if m else None, h.get("warc-payload-digest", "").partition(":")[2], None
    else:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {"file": path, "start": a, "end": b, "type": h.get("warc-type"), "record_id": h.get("warc-record-id"),
            "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_digest": digest,
            "payload_bytes": n, "payload": payload}


def read_archives(spark: SparkSession, path: str, *, glob: str = "*", payloads: bool = True) -> DataFrame:
    """One row a record or gap of all archives under `path`.

    Records: file, start, end, type, record_id, target_uri, refers_to, payload_digest (SHA-1 in hex; a
    revisit's is that of the payload it stands for), payload_bytes, payload (null for revisits, or for all
    without `payloads`).  Gaps: file, start, end and the reason in `gap`; places inside a gzip member are
    given as the member's.  Empty files have no rows; files are read whole, so they should be of the usual
    archive sizes (a GB or less)."""
    fields = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                        for n, t in (x.strip().split(" ") for x in _ROW.split(","))])

    def walk(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, data, rows, held = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b"", [], 0
                for found in salvage(data):
                    r = _row(name, *found)
                    if not payloads:
                        r.pop("payload", None)
                    rows.append(r)
                    held += len(r.get("payload") or b"")
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, fields)

    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
            .select("path", "content").mapInArrow(walk, _ROW))


def digest(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The columns that the registered query reports, from `read_archives`' records."""
    ident = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(ident(c) != "", ident(c).cast(id_type))
    return found.filter("gap is null").select(
        as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        as_id(F.col("refers_to")).alias("refers_to"))
