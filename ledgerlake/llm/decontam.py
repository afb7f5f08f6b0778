"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: every row holds one document's postings,
`terms` (sorted hashes of the distinct indexed words), `ends` (end of each
word's list) and `positions` (word positions, ascending within a word).  It is
a written table, so the scan, the word statistics and the phrase search each
read it without touching text again, and no word, however frequent, has all
its postings in one place.

A benchmark item is cut into windows of `window` consecutive words.  Words of
a window are ordered from the rarest in the corpus (counts over the whole
index) to the most frequent.  Per block of documents the search takes the
rarest word's list, shifts it by the word's offset to candidate starts, and
intersects the shifted lists of the other words in that order, stopping as
soon as nothing is left.  What survives all words is an exact phrase match.
With `slack` > 0 every word may stand up to `slack` positions off its place:
those are the proximity matches.

Benchmark items are read in blocks of at most `block_words` words, each block
being one pass, so what a task holds of the benchmark is bounded however large
the benchmark grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, lists_of, once, split, values

WINDOW = 10
BLOCK_WORDS = 1_000_000
_CACHE_WORDS = 200_000
GAP = 4096  # words between two documents of a search block, beyond any window and slack

# Words are runs of ASCII letters and digits and of everything beyond ASCII.
_SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "replace").translate(_SPLIT).split() if text else []


def word_id(word: bytes) -> int:
    """63-bit hash of a word."""
    return xxhash.xxh64_intdigest(word) >> 1


class _WordIds(dict):
    """Hashes of words; the commonest of a worker's texts are remembered."""

    def __missing__(self, word: bytes) -> int:
        i = word_id(word)
        if len(self) < _CACHE_WORDS:
            self[word] = i
        return i


def _places(wanted: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in a sorted table, and whether it is there."""
    k = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return k, table[k] == wanted if len(table) else np.zeros(len(wanted), bool)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): hashed words of every item in full, items without words left out."""

    def cut(batches):
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [word_id(x) for x in words_of(t)]
                if w:
                    ids.append(i)
                    out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.int64()))],
                                             names=["item", "words"])

    return (items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
            .mapInArrow(cut, "item string, words array<bigint>"))


def _blocks(items: DataFrame, block_words: int):
    """Item rows in blocks of at most `block_words` words (one longer item is a block of its own)."""
    block, n = [], 0
    for r in items.toLocalIterator():
        if block and n + len(r.words) > block_words:
            yield block
            block, n = [], 0
        block.append((r.item, np.array(r.words, np.int64)))
        n += len(r.words)
    if block:
        yield block


def build_index(docs: DataFrame, text_col: str, wanted: np.ndarray) -> DataFrame:
    """Adds n_words, terms, ends, positions to the columns of docs; text itself goes."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(wanted)  # at most block_words hashes

    @F.arrow_udf("n_words bigint, terms array<bigint>, ends array<int>, positions array<int>")
    def index(texts: pa.Array) -> pa.Array:
        hashes, known = once("decontam.words", "words", lambda _: _WordIds()), shared.value
        n, terms, ends, positions = [], [], [], []
        for t in values(texts):
            words = words_of(t)
            ids = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
            at = np.flatnonzero(_places(ids, known)[1])
            ids = ids[at]
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order].astype(np.int32)
            last = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if len(ids) else np.zeros(0, np.int64)
            n.append(len(words))
            terms.append(ids[last])
            ends.append((last + 1).astype(np.int32))
            positions.append(at)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), lists_of(terms, pa.int64()), lists_of(ends, pa.int32()),
             lists_of(positions, pa.int32())], names=["n_words", "terms", "ends", "positions"])

    return docs.withColumn("__index", index(F.col(text_col).cast("string")))


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): postings of each indexed word in the whole corpus, summed from per-batch counts."""

    def count(batches):
        for b in batches:
            terms = b.column(0).flatten().to_numpy()
            sizes = [np.diff(e, prepend=0) for e in split(b.column(1))]
            u, inv = np.unique(terms, return_inverse=True)
            n = np.bincount(inv, np.concatenate(sizes) if sizes else None, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    return (index.select("__index.terms", "__index.ends").mapInArrow(count, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")))


class Windows:
    """Windows of a benchmark block as arrays: `flat` holds the block's words, `counts` each one's number in the
    corpus, and a window is its `start` in flat, its `length`, and a range of `owners` (items that hold it).  Windows
    are grouped by their rarest word; those with a word that the corpus lacks are left out."""

    def __init__(self, items: list, terms: np.ndarray, n: np.ndarray, window: int):
        """`terms` (sorted) and `n`: the words that the corpus has, and how often."""
        self.items = [i for i, _ in items]
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.flat = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.int64)
        k, there = _places(self.flat, terms)
        self.counts = np.where(there, n[k] if len(n) else 0, 0)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = first + np.repeat(sizes, sizes) - np.arange(len(self.flat))  # words from here to the item's end
        start = np.flatnonzero((left >= window) | ((left == np.repeat(sizes, sizes)) & (left < window)))
        length, owner = np.minimum(left[start], window), owner[start]
        # The rarest word of each window, the first one of several, and a hash of all.
        least, offset, mixed = np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), np.int64), length.astype(np.uint64)
        for j in range(window):
            inside = length > j
            at = np.minimum(start + j, len(self.flat) - 1)
            rarer = inside & (self.counts[at] < least)
            least[rarer], offset[rarer] = self.counts[at][rarer], j
            mixed[inside] = (mixed[inside] ^ (mixed[inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.flat[at][inside].view(np.uint64)
        live = least > 0
        start, length, owner, offset, mixed = (x[live] for x in (start, length, owner, offset, mixed))
        anchor = self.flat[start + offset]
        order = np.lexsort((owner, mixed, anchor))
        start, length, owner, offset, mixed, anchor = (x[order] for x in (start, length, owner, offset, mixed, anchor))
        new = np.ones(len(start), bool)  # else the window repeats the one before it
        if len(start):
            new[1:] = (mixed[1:] != mixed[:-1]) | (length[1:] != length[:-1])
            for j in range(window):
                at = np.minimum(start + j, len(self.flat) - 1)
                new[1:] |= (length[1:] > j) & (self.flat[at[1:]] != self.flat[at[:-1]])
        head = np.flatnonzero(new)
        self.owners, self.owner_ends = owner, np.append(head[1:], len(owner))
        self.start, self.length, self.offset = start[head].astype(np.int32), length[head].astype(np.int32), offset[head].astype(np.int32)
        self.anchors, self.anchor_starts = np.unique(anchor[head], return_index=True)
        self.anchor_ends = np.append(self.anchor_starts[1:], len(head))

    def of_anchors(self, words: np.ndarray):
        """Yields (words with their offsets, rarest first; index) of the windows whose rarest word is in the sorted `words`."""
        for a in np.flatnonzero(_places(self.anchors, words)[1]):
            for w in range(self.anchor_starts[a], self.anchor_ends[a]):
                s = slice(int(self.start[w]), int(self.start[w]) + int(self.length[w]))
                ranks = np.argsort(self.counts[s], kind="stable")
                yield list(zip(self.flat[s][ranks].tolist(), ranks.tolist())), w

    def owners_of(self, w: int) -> np.ndarray:
        return self.owners[self.owner_ends[w - 1] if w else 0:self.owner_ends[w]]


def search(block: list, windows: Windows, slack: int = 0):
    """Yields (window length, owners, starts, anchors) per window with occurrences in a block of
    documents; an anchor is the place of the window's rarest word, which tells the document.

    `block` holds per document (terms, ends, positions, base), base being where its words start in
    the block's own coordinates."""
    terms = np.concatenate([np.repeat(t, np.diff(e, prepend=0)) for t, e, _, _ in block])
    at = np.concatenate([p + b for _, _, p, b in block])
    order = np.argsort(terms, kind="stable")  # documents are in order, so lists stay ascending
    terms, at = terms[order], at[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(terms))
    lists = {t: at[a:b] for t, a, b in zip(terms[first].tolist(), first.tolist(), ends.tolist())}
    for ranked, w in windows.of_anchors(terms[first]):
        if not all(t in lists for t, _ in ranked):
            continue
        starts = lists[ranked[0][0]] - ranked[0][1]
        for term, offset in ranked[1:]:
            if not len(starts):
                break
            starts = starts[_near(lists[term], starts + offset, slack)]
        if len(starts):
            yield len(ranked), windows.owners_of(w), starts, starts + ranked[0][1]


def _near(sorted_list: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """Which of `wanted` have an entry of the list at most `slack` away."""
    k = np.searchsorted(sorted_list, wanted - slack)
    found = sorted_list[np.minimum(k, len(sorted_list) - 1)]
    return (k < len(sorted_list)) & (found <= wanted + slack)


_RESULT = "n_words bigint, n_hit bigint, items array<string>, hit_starts array<int>, hit_ends array<int>"


def _match(index: DataFrame, items: list, counts: tuple[np.ndarray, np.ndarray], window: int, slack: int) -> DataFrame:
    """Replaces the column `contamination` (earlier benchmark blocks' result or null) by its union
    with this block's matches, and drops the index."""
    shared = index.sparkSession.sparkContext.broadcast((items, counts))  # at most block_words words

    @F.arrow_udf(_RESULT)
    def match(ix: pa.Array, before: pa.Array) -> pa.Array:
        windows = once("decontam.windows", shared.value, lambda v: Windows(v[0], *v[1], window))
        n_words = ix.field("n_words").to_pylist()
        lists = [split(ix.field(f)) for f in ("terms", "ends", "positions")]
        n_hit, owners, starts, ends = [], [], [], []
        for lo, hi in _ranges(lists[2]):
            base = np.zeros(hi - lo + 1, np.int64)
            np.cumsum([n + GAP for n in n_words[lo:hi]], out=base[1:])
            block = [(lists[0][i], lists[1][i], lists[2][i], base[i - lo]) for i in range(lo, hi)]
            found = {d - lo: (set(x["items"]), [np.array([x["hit_starts"], x["hit_ends"]], np.int64)])
                     for d in range(lo, hi) if (x := before[d].as_py()) and x["n_hit"]}
            for length, own, at, anchors in search(block, windows, slack):
                doc = np.searchsorted(base, anchors, side="right") - 1
                for d in np.unique(doc):
                    f = found.setdefault(int(d), (set(), []))
                    f[0].update(windows.items[k] for k in own if windows.items[k] is not None)
                    s = at[doc == d] - base[d]
                    f[1].append(np.stack([s, s + length]))
            for d in range(hi - lo):
                own, spans = found.get(d, ((), []))
                a, b = _union(spans, n_words[lo + d])
                n_hit.append(int((b - a).sum()))
                owners.append(sorted(own))
                starts.append(a)
                ends.append(b)
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(owners, pa.list_(pa.string())),
             lists_of(starts, pa.int32()), lists_of(ends, pa.int32())],
            names=["n_words", "n_hit", "items", "hit_starts", "hit_ends"])

    return index.withColumn("contamination", match("__index", "contamination")).drop("__index")


def _ranges(lists: list, most: int = 2_000_000):
    """Runs of documents with at most `most` postings together (one longer document is a run of its own)."""
    lo, n = 0, 0
    for i, x in enumerate(lists):
        if i > lo and n + len(x) > most:
            yield lo, i
            lo, n = i, 0
        n += len(x)
    if lo < len(lists):
        yield lo, len(lists)


def _union(spans: list, n_words: int):
    """Disjoint, ascending word ranges that cover the given (2, k) arrays of ranges."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(spans, axis=1)
    a, b = np.clip(both, 0, n_words)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, slack: int = 0, keep_text: bool = False,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of `docs` (without the text unless `keep_text`), with a struct
    `contamination` of n_words, n_hit (words inside an occurrence of a window), items (ids of the
    items that occur, sorted as strings), and the disjoint hit word ranges hit_starts / hit_ends.

    Null or empty texts have no words and no hits; items without words are ignored, an item with
    fewer words than `window` is one window; an item with a null id counts its hit words but is not
    listed; repeated rows and repeated ids each get their own result; an empty benchmark hits
    nothing.  Columns of `docs` already named `contamination` or `__index` are replaced.
    """
    if window < 1 or slack < 0 or window + 2 * slack >= GAP:
        raise ValueError(f"need 1 <= window and 0 <= slack with window + 2 * slack < {GAP}")
    store = Store(docs.sparkSession, "decontam")
    items = store.write(item_words(benchmark, item_id, item_text), "items")
    frame = docs.withColumn("contamination", F.lit(None).cast(f"struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>"))
    blocks = _blocks(items, block_words)
    block, k = next(blocks, []), 0
    while block is not None:
        after = next(blocks, None)
        wanted = np.unique(np.array([w for _, words in block for w in words], np.int64))
        frame = build_index(frame, text_col, wanted)
        index = store.write(frame if keep_text or after is not None else frame.drop(text_col), f"index{k}")
        found = term_counts(index).toArrow().sort_by("term")  # at most block_words rows
        counts = found["term"].to_numpy(), found["n"].to_numpy()
        frame = _match(index, block, counts, window, slack)
        block, k = after, k + 1
    return frame


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns that the registered query reports, from `decontaminate`'s result."""
    c = F.col("contamination")
    return docs.select(id_col, c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
                       F.size(c["items"]).cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", c["items"]).cast("binary"), 256).alias("items_sha256"),
                       (c["n_hit"] > 0).alias("contaminated"))
