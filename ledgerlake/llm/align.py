"""Alignment of two tokenizers' tokens by an associative fragment monoid.

Both tokenizers cut the same bytes.  Places where tokens of both end cut the text into groups; all tokens of
one tokenizer in a group are linked with all of the other's.

A fragment is what a byte range knows of the alignment: an open prefix (tokens up to the first common end), closed groups, and
an open suffix (tokens after the last common end).  Two neighbouring fragments compose into one: the left
suffix and the right prefix are aligned together, and what closes joins the groups.  Composition is associative
and the empty fragment is its identity, so the chunks of a very long document are tokenized by
different tasks and composed as a tree, `FAN` neighbours a task; only open ends and counts travel up, closed
groups stay where they closed.  Texts of one chunk are a single fragment.

Chunks begin at places where no token of the tokenizer can reach across: for byte-level vocabularies where a
word ends before a blank or a mark, for piece vocabularies between two characters that no piece has side by side.
Each tokenizer has its own such places, so a chunk's two token runs need not cover the same bytes.

How often an id pair is linked is counted in documents.  Texts are handled in bundles: a bundle holds its
distinct pairs once, with the number of its documents, and each document's links as places in that list.  So a pair that
every document has comes once a bundle to the count and to its lookup.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, arrow_rows, lists_of, once, task_count, values
from .tokencount import byte_letters

CHUNK = 1 << 16  # characters of a chunk
FAN = 16  # neighbours that one task composes
BUNDLE = 1 << 20  # links (distinct by document) of a bundle


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _settled() -> re.Pattern:
    """Texts whose characters had their present class in Unicode 3.2 already, so that every library splits them alike."""
    old = unicodedata.ucd_3_2_0
    odd = {0x1C, 0x1D, 0x1E, 0x1F, 0x85}
    keep = [c not in odd and not 0xD800 <= c < 0xE000 and (k := old.category(chr(c))) != "Cn" and k[0] == unicodedata.category(chr(c))[0] for c in range(0x10000)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(keep, np.int8), [0]])))
    spans = "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))
    return re.compile(f"[{spans}]*")


class ByteLevel:
    """A byte-level vocabulary file: ids of space + text."""

    # Fixed value: the splitting pattern of byte-level vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    # A letter, digit or mark before a blank, or one of well-known scripts before a mark: a split for sure.
    CUT = re.compile("(?<=[!-~¡-ɏͰ-ϿА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[ \n])"
                     "|(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣])(?=[!-&(-/:-@\\[-`{-~、。])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
        self.pieces = [b""] * self.size
        for piece, i in spec["model"]["vocab"].items():
            if piece not in special:
                self.pieces[i] = bytes(letters[c] for c in piece)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        ranks = {p: i for i, p in enumerate(self.pieces) if p}
        # The same splits and merges on texts of settled characters, in a third of the time.
        self.quick = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.settled = _settled().fullmatch

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.array(self.quick.encode_ordinary(t), np.int64) if self.quick and self.settled(t) else None for t in texts]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.int64)
        return out

    def cut_after(self, text: str, at: int) -> int:
        m = self.CUT.search(text, at)
        return m.start() if m else len(text)


class Pieces:
    """A piece vocabulary with byte fallback: ids of a text, to which it adds a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.pieces = [bytes([int(byte(n)[1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.joined = {n[k:k + 2].replace("▁", " ") for i, n in enumerate(names) if not self.model.is_byte(i) for k in range(len(n) - 1)}
        self.lead = self.model.encode("\n")  # a chunk after the first is read after a newline, which no piece holds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]

    def encode_rest(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x[len(self.lead):], np.int64) for x in self.model.encode(["\n" + t for t in texts], num_threads=1)]

    def cut_after(self, text: str, at: int) -> int:
        for p in range(max(at, 1), len(text)):
            if text[p - 1:p + 1] not in self.joined:
                return p
        return len(text)


def _models(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return once("align.models", f"{a}|{b}", lambda _: (ByteLevel(a), Pieces(b)))


class Side:
    """Tokens of one tokenizer in a stretch: ids and the byte places where they end."""

    __slots__ = ("ids", "ends")

    def __init__(self, ids, ends):
        self.ids, self.ends = np.asarray(ids, np.int64), np.asarray(ends, np.int64)

    def __add__(self, other: Side) -> Side:
        return Side(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))

    def upto(self, end: int) -> tuple[Side, Side]:
        k = int(np.searchsorted(self.ends, end, "right"))
        return Side(self.ids[:k], self.ends[:k]), Side(self.ids[k:], self.ends[k:])


NOTHING = Side([], [])


class Groups:
    """Closed groups: ids of both sides and the group number of each token."""

    def __init__(self, a: Side, b: Side, ends: np.ndarray):
        self.n = len(ends)
        self.a, self.b = a.ids, b.ids
        self.ga, self.gb = np.searchsorted(ends, a.ends), np.searchsorted(ends, b.ends)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(a ids, b ids) of all linked token pairs."""
        per = np.bincount(self.gb, minlength=self.n)
        times = per[self.ga]
        total = int(times.sum())
        first = np.cumsum(per) - per
        within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(self.a, times), self.b[np.repeat(first[self.ga], times) + within]

    def text(self) -> str:
        """a1,a2|b1;a3|b2,b3"""
        if not self.n:
            return ""
        na, nb = len(self.a), len(self.b)
        at_a = np.arange(na) + np.searchsorted(self.gb, self.ga)
        at_b = np.arange(nb) + np.searchsorted(self.ga, self.gb, "right")
        ids, mark = np.empty(na + nb, np.int64), np.empty(na + nb, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a] = np.append(self.ga[1:] != self.ga[:-1], True)
        mark[at_b] = 2 * np.append(self.gb[1:] != self.gb[:-1], True)
        table = _names(int(ids.max(initial=0)))
        return "".join(map(table.__getitem__, (ids * 3 + mark).tolist()))[:-1]


def _names(most: int) -> list[str]:
    """Decimal ids with the sign that follows: , inside a group's side, | between its sides, ; after it."""
    table = _TABLE.get("t", [])
    for i in range(len(table) // 3, most + 1):
        table += [f"{i},", f"{i}|", f"{i};"]
    _TABLE["t"] = table
    return table


_TABLE: dict = {}


class Fragment:
    """(prefix, closed, suffix) of a byte range.  `prefix` and `suffix` are pairs of sides; without a common end all is in `prefix`
    and `closed` is None.  `closed` is a list of Groups in order."""

    __slots__ = ("prefix", "closed", "suffix")

    def __init__(self, prefix, closed, suffix):
        self.prefix, self.closed, self.suffix = prefix, closed, suffix

    @staticmethod
    def of(a: Side, b: Side) -> Fragment:
        ends = np.intersect1d(a.ends, b.ends, assume_unique=True)
        if not len(ends):
            return Fragment((a, b), None, (NOTHING, NOTHING))
        (pa_, a), (pb, b) = a.upto(ends[0]), b.upto(ends[0])
        (ma, sa), (mb, sb) = a.upto(ends[-1]), b.upto(ends[-1])
        return Fragment((pa_, pb), [Groups(ma, mb, ends[1:])] if len(ends) > 1 else [], (sa, sb))

    def __add__(self, other: Fragment) -> Fragment:
        left = self.suffix if self.closed is not None else self.prefix
        middle = Fragment.of(left[0] + other.prefix[0], left[1] + other.prefix[1])
        if middle.closed is None:  # nothing closes: one of both has no tokens, or neither knows a common end
            if other.closed is None:
                return middle if self.closed is None else Fragment(self.prefix, self.closed, middle.prefix)
            return Fragment(self.prefix if self.closed is not None else middle.prefix, (self.closed or []) + other.closed, other.suffix)
        # A right fragment without common ends leaves what follows the middle's last one open.
        end = other.suffix if other.closed is not None else middle.suffix
        rest = other.closed or []
        if self.closed is None:
            return Fragment(middle.prefix, middle.closed + rest, end)
        first = _as_group(middle.prefix)
        return Fragment(self.prefix, [*self.closed, *first, *middle.closed, *rest], end)


def _as_group(sides: tuple[Side, Side]) -> list[Groups]:
    a, b = sides
    return [Groups(a, b, a.ends[-1:])] if len(a.ends) else []


EMPTY = Fragment((NOTHING, NOTHING), None, (NOTHING, NOTHING))
#: What stands before a text: a common end at 0.
START = Fragment((NOTHING, NOTHING), [], (NOTHING, NOTHING))


def fragment(text: str, models, cuts: tuple[int, int, int, int], base: tuple[int, int]) -> Fragment | None:
    """The fragment of a chunk whose tokens are those of text[cuts[0]:cuts[1]] for one and text[cuts[2]:cuts[3]] for the other
    tokenizer; `base`: byte places where these begin.  None if a tokenizer's bytes differ from the text's."""
    sides = []
    for model, lo, hi, at in ((models[0], *cuts[:2], base[0]), (models[1], *cuts[2:], base[1])):
        part = text[lo:hi]
        if isinstance(model, ByteLevel):
            want, ids = ("" if at else " ") + part, None
            ids = model.encode([want])[0] if want else []
        else:
            want = part if at else " " + part
            ids = (model.encode_rest([part])[0] if at else model.encode([part])[0]) if part else []
        ids = np.asarray(ids, np.int64)
        if b"".join(map(model.pieces.__getitem__, ids.tolist())) != want.encode("utf-8", "surrogatepass"):
            return None
        sides.append(Side(ids, at + np.cumsum(model.lengths[ids])))
    return Fragment.of(*sides)


def _links(groups: Groups, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times): the distinct id pairs linked in some groups as a_id * n_b + b_id, and how often each occurs."""
    a, b = groups.links()
    return np.unique(a * n_b + b, return_counts=True)


_BUNDLES = ("bundle bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, "
            "places array<int>, times array<int>, codes array<bigint>, docs array<int>")
_FIELDS = pa.schema([("bundle", pa.int64()), ("id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
                     ("groups_sha256", pa.string()), ("groups", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                     ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])


def _bundled(short: DataFrame, a: str, b: str, with_groups: bool) -> DataFrame:
    """Texts of one chunk: a row a document, and a row a bundle with its distinct pairs."""

    def flush(rows, codes, times):
        bundle = uuid.uuid4().int >> 65
        sizes = [len(c) for c in codes]
        distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
        cut = np.cumsum(sizes)[:-1]
        cols = list(zip(*rows))
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bundle] * n, pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(_FIELDS)[1:8])),
             lists_of(np.split(place, cut), pa.int32()), lists_of(times, pa.int32()), pa.nulls(n, _FIELDS.field("codes").type),
             pa.nulls(n, _FIELDS.field("docs").type)], schema=_FIELDS)
        docs = np.bincount(place, minlength=len(distinct))
        yield pa.RecordBatch.from_arrays(
            [pa.array([bundle], pa.int64()), *(pa.nulls(1, f.type) for f in list(_FIELDS)[1:10]), lists_of([distinct], pa.int64()),
             lists_of([docs], pa.int32())], schema=_FIELDS)

    def run(batches):
        models = _models(a, b)
        rows, codes, times, held = [], [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                spaced = [" " + t for t in texts]
                ids_a, ids_b = models[0].encode(spaced), models[1].encode(texts)
                for ident, text, x, y in zip(part.column("id").to_pylist(), spaced, ids_a, ids_b):
                    raw = text.encode("utf-8", "surrogatepass")
                    fits = len(raw) > 1 and all(b"".join(map(m.pieces.__getitem__, ids.tolist())) == raw for m, ids in zip(models, (x, y)))
                    if not fits:
                        x = y = np.zeros(0, np.int64)
                    sides = Side(x, np.cumsum(models[0].lengths[x])), Side(y, np.cumsum(models[1].lengths[y]))
                    # A whole text is a fragment between two known ends: all of it is closed.
                    g = Groups(*sides, np.intersect1d(sides[0].ends, sides[1].ends, assume_unique=True))
                    c, n = _links(g, models[1].size)
                    shown = g.text()
                    digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
                    rows.append((ident, len(x), len(y), g.n, int(n.sum()), digest, shown if with_groups else None))
                    codes.append(c), times.append(n)
                    held += len(c)
                if held >= BUNDLE:
                    yield from flush(rows, codes, times)
                    rows, codes, times, held = [], [], [], 0
        if rows:
            yield from flush(rows, codes, times)

    return short.mapInArrow(run, _BUNDLES)


def _chunked(long: DataFrame, a: str, b: str, chunk: int) -> DataFrame:
    """(doc, id, k, n, text, cuts, base): the chunks of long texts, each with both tokenizers' stretches of it."""
    fields = pa.schema([("doc", pa.int64()), ("id", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("text", pa.string()),
                        ("cuts", pa.list_(pa.int64())), ("base", pa.list_(pa.int64()))])

    def run(batches):
        models = _models(a, b)
        for batch in batches:
            for i in range(batch.num_rows):
                text, ident = batch.column("text")[i].as_py(), batch.column("id")[i].as_py()
                doc, n = uuid.uuid4().int >> 65, -(-len(text) // chunk)
                begin, place = (0, 0), [0, 0]  # where each tokenizer's stretch begins, in characters and in bytes
                for k in range(n):
                    end = tuple(max(x, m.cut_after(text, (k + 1) * chunk) if k + 1 < n else len(text)) for x, m in zip(begin, models))
                    lo, hi = min(begin), max(end)
                    row = {"doc": doc, "id": ident, "k": k, "n": n, "text": text[lo:hi], "base": list(place),
                           "cuts": [begin[0] - lo, end[0] - lo, begin[1] - lo, end[1] - lo]}
                    yield pa.RecordBatch.from_pylist([row], fields)
                    for s in (0, 1):
                        place[s] += len(text[begin[s]:end[s]].encode("utf-8", "surrogatepass")) + (begin[s] == 0 and end[s] > 0)
                    begin = end

    return long.mapInArrow(run, "doc bigint, id bigint, k bigint, n bigint, text string, cuts array<bigint>, base array<bigint>")


_SIDES = ("pa_ids", "pa_ends", "pb_ids", "pb_ends", "sa_ids", "sa_ends", "sb_ids", "sb_ends")
_PART = ("doc bigint, id bigint, k bigint, n bigint, n_a bigint, n_b bigint, fits boolean, closed boolean, "
         + ", ".join(f"{n} array<bigint>" for n in _SIDES) + ", place bigint, n_groups bigint, groups string, codes array<bigint>, times array<bigint>")
_PARTS = pa.schema([(n, pa.int64()) for n in ("doc", "id", "k", "n", "n_a", "n_b")] + [("fits", pa.bool_()), ("closed", pa.bool_())]
                   + [(n, pa.list_(pa.int64())) for n in _SIDES]
                   + [("place", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _up(f: Fragment, **more) -> dict:
    """The row of a fragment without its groups: what travels up the tree."""
    (pa_, pb), (sa, sb) = f.prefix, f.suffix
    return {"closed": f.closed is not None, **dict(zip(_SIDES, (x for side in (pa_, pb, sa, sb) for x in (side.ids, side.ends)))), **more}


def _down(row: dict) -> Fragment:
    sides = [Side(row[x], row[y]) for x, y in zip(_SIDES[::2], _SIDES[1::2])]
    return Fragment((sides[0], sides[1]), [] if row["closed"] else None, (sides[2], sides[3]))


def _group_rows(closed: list[Groups] | None, n_b: int, **more) -> list[dict]:
    """One row for groups that closed at one place, if there are any."""
    closed = [g for g in closed or [] if g.n]
    if not closed:
        return []
    codes, times = zip(*(_links(g, n_b) for g in closed))
    codes, back = np.unique(np.concatenate(codes), return_inverse=True)
    times = np.bincount(back, np.concatenate(times)).astype(np.int64)
    return [{"n_groups": sum(g.n for g in closed), "groups": ";".join(g.text() for g in closed), "codes": codes, "times": times, **more}]


def _fragments(chunks: DataFrame, a: str, b: str) -> DataFrame:
    """Each chunk's fragment and the row of its closed groups, which stand at place 2 k."""

    def run(batches):
        models = _models(a, b)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                key = {n: row[n] for n in ("doc", "id", "k", "n")}
                f = fragment(row["text"], models, tuple(row["cuts"]), tuple(row["base"]))
                if f is None:
                    yield pa.RecordBatch.from_pylist([_up(EMPTY, fits=False, n_a=0, n_b=0, **key)], _PARTS)
                    continue
                sides = [f.prefix, f.suffix]
                n_a, n_b = (sum(len(s[x].ids) for s in sides) + sum(len((g.a, g.b)[x]) for g in f.closed or []) for x in (0, 1))
                f = START + f if row["k"] == 0 else f
                rows = [_up(f, fits=True, n_a=n_a, n_b=n_b, **key), *_group_rows(f.closed, models[1].size, place=2 * row["k"], **key)]
                yield pa.RecordBatch.from_pylist(rows, _PARTS)

    return chunks.mapInArrow(run, _PART)


def _composed(level: DataFrame, n_b: int) -> DataFrame:
    """One fragment for each FAN neighbours; what closes between two of them stands at place 2 k - 1 of the right one's first chunk."""

    def compose(key, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        total, out = EMPTY, []
        for r in rows:
            total = total + _down(r)
            out += _group_rows(total.closed, n_b, place=2 * r["at"] - 1, doc=r["doc"], id=r["id"], k=r["k"], n=r["n"])
            if total.closed is not None:
                total.closed = []
        first = rows[0]
        up = _up(total, fits=True, n_a=None, n_b=None, doc=first["doc"], id=first["id"], k=first["k"] // FAN, n=first["n"])
        return pa.Table.from_pylist([{**x, "at": first["at"]} for x in [up, *out]], _PARTS.append(pa.field("at", pa.int64())))

    return level.groupBy("doc", F.expr(f"k div {FAN}")).applyInArrow(lambda k, t: compose(k, t), _PART + ", at bigint")


def _long_documents(long: DataFrame, store: Store, a: str, b: str, chunk: int, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(documents, groups): (doc, id, n_a, n_b, n_groups) of the long texts and the rows of their closed groups."""
    spark = long.sparkSession
    with arrow_rows(spark, 16):
        chunks = _chunked(long, a, b, chunk).repartition(task_count(spark), "doc", "k")
        leaves = store.write(_fragments(chunks, a, b), "leaves")
    whole = leaves.filter("place is null").groupBy("doc").agg(
        F.min("id").alias("id"), F.min("fits").alias("fits"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.max("n").alias("n"))
    whole = store.write(whole, "long")
    fits = whole.filter("fits").select("doc")
    groups = leaves.filter("place is not null")
    level = leaves.filter("place is null").withColumn("at", F.col("k")).join(fits, "doc", "left_semi")
    n, k = whole.agg(F.max("n")).first()[0] or 0, 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
        done = store.write(_composed(level, n_b), f"tree{k}")
        groups = groups.unionByName(done.filter("place is not null").drop("at"))
        level = done.filter("place is null")
    groups = groups.join(fits, "doc", "left_semi").select("doc", "id", "place", "n_groups", "groups", "codes", "times")
    return whole, groups


def _digests(groups: DataFrame) -> DataFrame:
    """(doc, groups_sha256): the digest of each document's groups in order, streamed part by part."""

    def run(batches):
        doc, h = None, None
        for batch in batches:
            for d, t in zip(batch.column("doc").to_pylist(), values(batch.column("groups"))):
                if d != doc:
                    if h:
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([h.hexdigest()])], names=["doc", "groups_sha256"])
                    doc, h = d, hashlib.sha256(t.encode())
                else:
                    h.update(b";" + t.encode())
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([h.hexdigest()])], names=["doc", "groups_sha256"])

    n = task_count(groups.sparkSession)
    return (groups.select("doc", "place", "groups").repartition(n, "doc").sortWithinPartitions("doc", "place").select("doc", "groups")
            .mapInArrow(run, "doc bigint, groups_sha256 string"))


_SUMS = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(key, docs: pa.Table, look: pa.Table) -> pa.Table:
    """Sums over each document's links, from the counts of its bundle's pairs."""
    n = look.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        place = look.column("place").to_numpy()
        count[place], best[place] = look.column("count").to_numpy(), look.column("best").to_numpy()
    places, times = docs.column("places").combine_chunks(), docs.column("times").combine_chunks()
    at = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())]).astype(np.int64)
    p, t = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(total(best[p] * t))).append_column("count_sum", pa.array(total(count[p] * t)))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, chunk: int = CHUNK,
          with_groups: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, pairs, groups) of the alignment of a byte-level and a piece tokenizer.

    documents: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for every row of `docs`; n_best counts the links
    whose pair is in as many documents as the best pair of its first id, count_sum adds up the pairs' documents over
    all links.  pairs: (a_id, b_id, n_documents, best).  groups (with `with_groups`): (id, doc, place, groups), the text
    `a1,a2|b1;a3|b2` of each document in parts, ordered by place; `doc` tells rows with one id apart.

    Texts are whole; special tokens' names in them are plain text.  Null and empty texts, and texts that a
    tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest.  Rows with equal ids are documents
    of their own, ids are integers or null, other columns are ignored whatever their names.  An empty table gives empty results.  Texts
    longer than `chunk` characters are cut where no token can reach across; a stretch without such a place is one chunk."""
    spark = docs.sparkSession
    a, b = tokenizers or default_tokenizers()
    n_b = Pieces(b).size
    store = Store(spark, "align")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    with arrow_rows(spark, 1024):
        bundles = store.write(_bundled(rows.filter(~is_long), a, b, with_groups), "bundles")
    long, parts = _long_documents(rows.filter(is_long), store, a, b, chunk, n_b)
    long_links = store.write(parts.select("doc", F.explode(F.arrays_zip("codes", "times")).alias("l"))
                             .groupBy("doc", F.col("l.codes").alias("code")).agg(F.sum("l.times").alias("times")), "long-links")

    lists, short = bundles.filter("codes is not null"), store.reread("bundles", bundles).filter("codes is null")
    seen = lists.select(F.explode(F.arrays_zip("codes", "docs")).alias("l")).select(F.col("l.codes").alias("code"), F.col("l.docs").cast("bigint").alias("n"))
    counts = store.write(seen.unionByName(long_links.select("code", F.lit(1).cast("bigint").alias("n")))
                         .groupBy("code").agg(F.sum("n").alias("count")), "counts")
    first = F.expr(f"code div {n_b}")
    top = counts.groupBy(first.alias("a_id")).agg(F.max("count").alias("top"))
    pairs = store.write(counts.withColumn("a_id", first).join(top, "a_id")
                        .select("code", "a_id", (F.col("code") % n_b).alias("b_id"), "count", (F.col("count") == F.col("top")).cast("int").alias("best")), "pairs")

    look = (lists.select("bundle", F.posexplode("codes").alias("place", "code")).join(pairs.select("code", "count", "best"), "code")
            .select("bundle", "place", "count", "best"))
    short = short.select("bundle", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    done = short.groupBy("bundle").cogroup(look.groupBy("bundle")).applyInArrow(lambda k, x, y: _summed(k, x, y), _SUMS)

    sums = long_links.join(pairs.select("code", "count", "best"), "code").groupBy("doc").agg(
        F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    per = parts.groupBy("doc").agg(F.sum("n_groups").alias("n_groups"))
    zero = lambda c: F.when(F.col("fits"), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    rest = (long.join(per, "doc", "left").join(sums, "doc", "left").join(_digests(parts), "doc", "left")
            .select("id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    documents = done.unionByName(rest).withColumnRenamed("id", id_col)
    groups = None
    if with_groups:
        groups = (bundles.filter("codes is null and groups <> ''").select("id", F.monotonically_increasing_id().alias("doc"), F.lit(0).cast("bigint").alias("place"), "groups")
                  .unionByName(parts.select("id", "doc", "place", "groups")).withColumnRenamed("id", id_col))
    return documents, pairs.select("a_id", "b_id", F.col("count").alias("n_documents"), (F.col("best") == 1).alias("best")), groups
