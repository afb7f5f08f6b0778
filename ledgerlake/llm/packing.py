"""Sequence packing along a Hilbert curve.

Each document's token counts are hashed into a signed vector, projected to a
few dimensions and quantised; the point's place on the Hilbert curve is its
key.  Documents are range-sorted by that key, so neighbours on the curve, which
share vocabulary, become neighbours in the sequences.  The sorted documents
form one stream of tokens, cut every `length` tokens; the rest at the end is
cut into powers of two.  No sequence needs padding, and no document is moved twice.

Only (row, key, count) is sorted.  The token ids are written once and joined
with their place in the stream.  Places are prefix sums: within each sorted
partition on its task, across partitions from one total a partition.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, arrow_rows, once, task_count
from .tokencount import byte_letters

LENGTH = 2048
END_ID = 1
DIMS, BITS, BUCKETS = 3, 16, 64
CACHE_PIECES = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Characters on which the tokenizer's own normalising and splitting is stated by the pattern below: printable
# ASCII, blanks, Latin letters and signs up to U+017F but for U+0130, whose lower case is two characters.
_KNOWN = r"[ \t\n\r!-~\u00a1-\u012f\u0131-\u017f]*"
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
# Fixed value: the splitting pattern of the vocabulary file, for lower-cased text of those characters.
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \t\n\r{_LETTER}{_NUMBER}]+"


def id_type(path: str) -> np.dtype:
    """Little-endian type that holds all ids of a vocabulary file."""
    spec = json.load(open(path, encoding="utf-8"))
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), END_ID])
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


class Encoder:
    """Token ids of whole texts.

    For vocabularies that mark word ends, lower-case and drop white space, texts of well-known characters are split
    by pattern and each piece's ids are remembered.  Of other texts this is done run by run between spaces and newlines, and runs with other characters
    go to the tokenizer as they are, as does everything for other vocabularies.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), id_type(path)
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece = bool(suffix) and "Lowercase" in json.dumps(spec["normalizer"]) and "'s|'t|'re|'ve|'m|'ll|'d" in json.dumps(spec["pre_tokenizer"])
        self.marks = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.known, self.split = re.compile(_KNOWN).fullmatch, re.compile(_PIECES).findall
        self.pieces = _Pieces(self._plain, self.tokenizer.model, self.dtype)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _simple(self, text: str) -> bool:
        return self.known(text) is not None and not any(m in text for m in self.marks)

    def _parts(self, text: str) -> list[str]:
        """Pieces of a text; a run that is no piece stands for itself after a blank."""
        if self._simple(text):
            return self.split(text.lower())
        out = []
        for run in text.replace("\n", " ").split(" "):
            if run:
                out += self.split(run.lower()) if self._simple(run) else [" " + run]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, END_ID last."""
        end = np.array([END_ID], self.dtype).tobytes()
        if not self.by_piece:
            return [np.frombuffer(b + end, self.dtype) for b in self._plain([t or "" for t in texts])]
        out, get = [], self.pieces.__getitem__
        for t in texts:
            out.append(np.frombuffer(b"".join(map(get, self._parts(t))) + end if t else end, self.dtype))
            if len(self.pieces) > CACHE_PIECES:
                for piece in list(itertools.islice(self.pieces, CACHE_PIECES // 2, None)):  # the first to come are the frequent ones
                    del self.pieces[piece]
        return out


class _Pieces(dict):
    """Ids of pieces as bytes.  A word is one pre-token, so the vocabulary's model takes it as it is, in byte letters."""

    def __init__(self, plain, model, dtype: np.dtype):
        super().__init__()
        self.plain, self.cut, self.code = plain, model.tokenize, "H" if dtype.itemsize == 2 else "I"
        self.letters = {b: c for c, b in byte_letters().items()}

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.cut(letters)]).tobytes()
        else:
            ids = self.plain([piece])[0]
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of an (n, d) array of `bits`-bit coordinates on the d-dimensional Hilbert curve."""
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the rotations of the sub-cubes
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for xi in x:
            key = (key << one) | (((xi ^ flip) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _project() -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((BUCKETS, DIMS)))
    return q


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents from their token ids."""
    if not ids:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    h = (np.concatenate(ids).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    sign = 1.0 - 2.0 * ((h >> np.uint64(60)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(doc * BUCKETS + bucket, sign, len(ids) * BUCKETS).reshape(-1, BUCKETS)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cells = np.clip((v @ _project() + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


def tail_cuts(total: int, length: int) -> list[int]:
    """Ends of the power-of-two sequences after the last full one."""
    at, out = total - total % length, []
    for b in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> b & 1:
            at += 1 << b
            out.append(at)
    return out


_PIECE = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>>"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         length: int = LENGTH) -> DataFrame:
    """One row a piece: id, start (tokens of the document before it), length, ids_crc32 (unsigned, of
    little-endian 32-bit ids), doc_tokens, sequence_id, and offset in the sequence.

    Null and empty texts are documents of the end id alone, so every row has at least one piece.
    Repeated rows and repeated ids are packed each by itself; ties on the curve are ordered by row.  `length` must be a power of
    two; only the last sequences may be shorter, each again a power of two, so nothing
    is padded.  An empty table has no sequences.  Other columns are ignored.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    store = Store(spark, "packing")

    @F.arrow_udf("ids binary, n bigint, key bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        encoder = once("packing.encoder", path, Encoder)
        ids = encoder.encode(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
             pa.array(curve_keys(ids))], names=["ids", "n", "key"])

    with arrow_rows(spark, 1000):
        coded = store.write(docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col).cast("string")).alias("t"))
                            .select("id", "t.*", F.monotonically_increasing_id().alias("row")), "tokens")

    def prefix(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at), b.column(1)],
                                             names=["row", "part", "before", "n"])

    order = store.write(coded.select("row", "n", "key").repartitionByRange(task_count(spark), "key", "row")
                        .sortWithinPartitions("key", "row").select("row", "n")
                        .mapInArrow(prefix, "row bigint, part int, before bigint, n bigint"), "order")
    totals = sorted((r.part, r.n) for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a partition
    starts = list(itertools.accumulate((n for _, n in totals), initial=0))
    total, cuts = starts[-1], tail_cuts(starts[-1], length)
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part int, shift bigint")
    place = order.join(offsets, "part").select("row", (F.col("before") + F.col("shift")).alias("at"))

    dtype = id_type(path)

    @F.arrow_udf(_PIECE)
    def cut(ids: pa.Array, at: pa.Array) -> pa.Array:
        full = total - total % length
        edges = np.array(cuts, np.int64)
        out = []
        for raw, g in zip(ids.to_pylist(), at.to_pylist()):
            x = np.frombuffer(raw, dtype).astype("<u4")
            end = g + len(x)
            here = [g, *range(g - g % length + length, min(end, full + 1), length), *(c for c in cuts if g < c < end), end]
            pieces = []
            for a, b in zip(here[:-1], here[1:]):
                if a < full:
                    seq, first = a // length, a - a % length
                else:
                    k = int(np.searchsorted(edges, a, side="right"))
                    seq, first = full // length + k, cuts[k - 1] if k else full
                pieces.append({"start": a - g, "length": b - a, "ids_crc32": zlib.crc32(x[a - g:b - g].tobytes()),
                               "sequence_id": seq, "offset": a - first})
            out.append(pieces)
        names = ["start", "length", "ids_crc32", "sequence_id", "offset"]
        return pa.array(out, pa.list_(pa.struct([(n, pa.int64()) for n in names])))

    return (coded.join(place, "row").withColumn("p", F.explode(cut("ids", "at")))
            .select(F.col("id").alias(id_col), "p.*", F.col("n").alias("doc_tokens")))
