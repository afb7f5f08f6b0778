"""Exact repeats of long byte strings by longest-previous-factor arrays.

A byte is repeated if some string of `length` bytes that covers it also starts at another place of the corpus.
Strings are grouped by their least hash among all `GRAM`-byte pieces: equal strings have the same least piece, so each
group can be judged by itself.  Neighbouring strings of a text mostly share it, so a text falls into runs of
strings, one group key a run, and runs (not strings) are shuffled.

Runs with the same bytes form a class.  A class that occurs twice repeats as a whole; keys with one run in all of the
corpus are dropped.  What is left are groups of classes that differ somewhere.  Their bytes are brought
together, and in the order of their suffixes the nearest places with a smaller text position before and after
each one give its longest previous factor, those with a larger position its longest next factor.  A string repeats if
either reaches `length`: with `keep="first"` only those with an earlier match go, with `keep="none"` all do.

Groups too large for one task (`HOT_BYTES` of different runs) are taken apart into their strings, whose
128-bit fingerprints are counted by Spark instead; that path is exact too and splits over any number of tasks.

Texts with the same bytes are one text with a number of copies.  Their bytes are written once, bucketed by
digest, so neither looking up runs nor cutting the spans out shuffles them again.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, arrow_rows, lists_of, once, split, task_count

LENGTH = 400
GRAM = 32
CHUNK = 1 << 18  # bytes hashed at a time: bounds a worker's memory on very long texts
LONGEST_RUN = 4096  # strings of a run: periodic texts have one key for very long
BATCH_BYTES = 1 << 20  # bytes whose suffixes are sorted together
HOT_BYTES = 1 << 21  # different bytes of one group beyond which its strings are counted by fingerprint
_LETTERS = np.random.default_rng(20250101).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = (1 << 63) - 1


def _gram(length: int) -> int:
    """Bytes of a piece: a power of two of at most GRAM that fits well into a string."""
    return max(1, min(GRAM, 1 << max(0, (length // 4).bit_length() - 1)))


def _pieces(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the piece of `gram` bytes at every place."""
    h, size, factor = _LETTERS[data], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * factor + h[size:]
            h ^= h >> np.uint64(29)
            size, factor = size * 2, factor * factor
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbours."""
    have = 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (span - have)], h[span - have:]) if span > have else h


def runs_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(keys, digests, starts, counts, looped): runs of consecutive strings with one key, each with the digest of all its
    bytes.  looped: the least piece occurs more than once (1), so that strings of the run may equal each other."""
    view, raw, gram = np.frombuffer(data, np.uint8), memoryview(data), _gram(length)
    span = length - gram + 1
    found = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        h = _pieces(view[at:at + CHUNK + length - 1], gram)
        k = _least(h, span)
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        n = np.diff(np.append(cut, len(k)))
        if n.max() > LONGEST_RUN:
            parts = -(-n // LONGEST_RUN)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            cut = np.repeat(cut, parts) + within * LONGEST_RUN
            n = np.diff(np.append(cut, len(k)))
        wide = n + (span - 1)
        first = np.cumsum(wide) - wide
        here = np.arange(wide.sum()) - np.repeat(first - cut, wide)
        times = np.add.reduceat(h[here] == np.repeat(k[cut], wide), first, dtype=np.int64)
        found.append((k[cut].view(np.int64), cut + at, n, (times > 1).astype(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    keys, starts, counts, looped = (np.concatenate(x) for x in zip(*found))
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(raw[s:s + n + length - 1]) for s, n in zip(starts.tolist(), counts.tolist())), np.uint64, len(starts))
    return keys, digests.view(np.int64), starts, counts, looped


def _ranks(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Block size -> a number for the block of that size at every place, in the blocks' order; by prefix doubling."""
    out, size = {1: data.astype(np.uint64)}, 1
    while size * 2 <= length:
        r = out[size]
        if size < 8:  # the bytes themselves
            out[size * 2] = (r[:-size] << np.uint64(8 * size)) | r[size:]
        else:
            if size == 8:
                r = _dense(r)
            out[size * 2] = _dense(r[:-size] * (int(r.max(initial=0)) + 1) + r[size:])
        size *= 2
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], x[order][1:] != x[order][:-1]])) if len(x) else 0
    return rank


def _nearest(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, the common prefix with the nearest one before it whose position is smaller.

    `common` holds the common prefix of each suffix with the one before.  Pointers jump over larger
    positions until they stand on a smaller one; what lies between bounds the common prefix."""
    n = len(position)
    at, low = np.arange(-1, n - 1), common.copy()
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[(at[todo] >= 0) & (position[at[todo]] > position[todo])]):
        p = at[todo]
        low[todo], at[todo] = np.minimum(low[todo], low[p]), at[p]
    low[at < 0] = 0
    return low


def factors(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous, longest next) factor of each suffix in suffix order: previous and next smaller (larger) positions."""
    def both(pos):
        back = _nearest(pos[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
        return np.maximum(_nearest(pos, common), back)

    if not len(position):
        return common, common
    return both(position), both(-position)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the starts in the order of their first `length` bytes, and the common prefix of each with
    the one before it, at most `length`."""
    ranks = _ranks(data, length)
    size = max(ranks)
    head, tail = _dense(ranks[size][starts]), _dense(ranks[size][starts + length - size])
    order = starts[np.argsort(head * (len(starts) + 1) + tail, kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    reach = np.zeros(len(a), np.int64)
    for s in sorted(ranks, reverse=True):
        fits = np.flatnonzero(reach + s <= length)
        fits = fits[ranks[s][a[fits] + reach[fits]] == ranks[s][b[fits] + reach[fits]]]
        reach[fits] += s
    common[1:] = reach
    return order, common


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def repeated_within(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, in text order, (earlier, later): does the string at each start also start earlier, later?"""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begins, ends)])
    order, common = suffix_order(data, starts, length)
    previous, following = factors(order, common)
    earlier, later = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    earlier[order], later[order] = previous >= length, following >= length
    return [(earlier[a:b - length + 1], later[a:b - length + 1]) for a, b in zip(begins, ends)]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that overlap or touch, united."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_REP = "sha string, first_id bigint, copies bigint, data binary, keys array<bigint>, digests array<bigint>, starts array<bigint>, counts array<bigint>, looped array<bigint>"
_MARKED = "key bigint, digest bigint, earlier array<struct<lo:bigint,hi:bigint>>, later array<struct<lo:bigint,hi:bigint>>"
_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _representatives(rows: DataFrame, store: Store, length: int) -> tuple[DataFrame, str]:
    """One row a text of at least `length` bytes with its runs, as a table bucketed by digest; and the table's name."""
    reps = (rows.filter(F.col("n_bytes") >= length).groupBy("sha")
            .agg(F.coalesce(F.min("id"), F.lit(_LAST)).alias("first_id"), F.count("*").alias("copies"), F.first("data").alias("data")))

    def measure(batches):
        once("repeats.none", None)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [runs_of(d.as_py(), length) for d in part.column("data")]
                lists = [lists_of([f[k] for f in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, "keys", "digests", "starts", "counts", "looped"])

    spark = rows.sparkSession
    name = f"ledgerlake_repeats_{uuid.uuid4().hex[:12]}"
    with arrow_rows(spark, 500):
        (reps.select("sha", "first_id", "copies", "data").mapInArrow(measure, _REP)
         .write.option("compression", "zstd").option("path", store.path("reps")).bucketBy(task_count(spark), "sha").saveAsTable(name))
    return spark.table(name), name


def _runs(reps: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("keys", "digests", "starts", "counts", "looped")
    return reps.select("sha", "first_id", "copies", F.explode(zipped).alias("r")).select(
        "sha", "first_id", "copies", F.col("r.keys").alias("key"), F.col("r.digests").alias("digest"),
        F.col("r.starts").alias("start"), F.col("r.counts").alias("n"), F.col("r.looped").alias("looped"))


def _bytes_of(classes: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(key, digest, first, data) of classes, the bytes cut from the text where each class occurs first."""
    wanted = (classes.select(F.col("first.sha").alias("sha"), F.struct("key", "digest", "n", "first").alias("c")).groupBy("sha")
              .agg(F.collect_list("c").alias("cs")))
    first = "struct<first_id:bigint,sha:string,start:bigint>"
    kind = pa.struct([("first_id", pa.int64()), ("sha", pa.string()), ("start", pa.int64())])

    def cut(batches):
        for b in batches:
            for data, cs in zip(b.column("data"), b.column("cs")):
                data, cs = data.as_py(), cs.as_py()
                for i in range(0, len(cs), 512):
                    some = cs[i:i + 512]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c["key"] for c in some], pa.int64()), pa.array([c["digest"] for c in some], pa.int64()),
                        pa.array([c["first"] for c in some], kind),
                        pa.array([data[(s := c["first"]["start"]):s + c["n"] + length - 1] for c in some], pa.binary())],
                        names=["key", "digest", "first", "data"])

    return wanted.join(reps.select("sha", "data"), "sha").select("cs", "data").mapInArrow(cut, f"key bigint, digest bigint, first {first}, data binary")


def _by_suffixes(classes: DataFrame, length: int) -> DataFrame:
    """Repeated strings within each group of classes, as ranges of starts; whole groups at a time, some of them together."""
    def judge(held):
        t = pa.Table.from_batches(held).to_pylist()
        t.sort(key=lambda r: (r["first"]["first_id"], r["first"]["sha"], r["first"]["start"]))
        found = repeated_within([r["data"] for r in t], length)
        ranges = [pa.array([[{"lo": int(a), "hi": int(b)} for a, b in zip(*_intervals(f[k]))] for f in found], _RANGES) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in t], pa.int64()) for n in ("key", "digest")] + ranges,
                                          names=["key", "digest", "earlier", "later"])

    def run(batches):
        once("repeats.none", None)
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, begin = b.column("key").to_numpy(), 0
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.add.reduceat(pc.binary_length(b.column("data")).to_numpy().astype(np.int64), cuts)
            for a, n in zip(cuts.tolist(), sizes.tolist()):
                if keys[a] != last and size >= BATCH_BYTES:
                    held.append(b.slice(begin, a - begin))
                    yield judge(held)
                    held, size, begin = [], 0, a
                size, last = size + n, keys[a]
            held.append(b.slice(begin))
        if held:
            yield judge(held)

    keyed = classes.repartition(task_count(classes.sparkSession), "key").sortWithinPartitions("key")
    return keyed.mapInArrow(run, _MARKED)


def _united(offsets: pa.Array) -> pa.Array:
    """The offsets of a class (LONGEST_RUN at most) as ranges of consecutive ones."""
    found = []
    for x in split(offsets):
        x = np.sort(x)
        cut = np.flatnonzero(np.diff(x) > 1)
        found.append([{"lo": a, "hi": b + 1} for a, b in zip(x[np.append(0, cut + 1)].tolist(), x[np.append(cut, len(x) - 1)].tolist())] if len(x) else [])
    return pa.array(found, _RANGES)


def _by_fingerprints(classes: DataFrame, length: int, store: Store) -> DataFrame:
    """The same for groups of any size: every string's fingerprint, counted by Spark."""
    def prints(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = memoryview(b.column("data")[i].as_py())
                n = len(raw) - length + 1
                out = pa.array([xxhash.xxh3_128_digest(raw[p:p + length]) for p in range(n)], pa.binary())
                same = {c: pa.array([b.column(c)[i].as_py()] * n, b.column(c).type) for c in ("key", "digest", "first")}
                yield pa.RecordBatch.from_arrays([*same.values(), pa.array(np.arange(n)), out], names=[*same, "offset", "print"])

    strings = classes.mapInArrow(prints, "key bigint, digest bigint, first struct<first_id:bigint,sha:string,start:bigint>, offset bigint, print binary")
    place = F.struct("first.first_id", "first.sha", (F.col("first.start") + F.col("offset")).alias("start"))
    strings = strings.select("key", "digest", "offset", "print", place.alias("place"))
    ends = strings.groupBy("print").agg(F.min("place").alias("least"), F.max("place").alias("most")).filter("least < most")
    # Written first: a join of plain exchanges splits a string that very many classes hold over tasks.
    hit = strings.join(store.write(ends, "hot-ends"), "print")
    offsets = hit.groupBy("key", "digest").agg(F.collect_list(F.when(F.col("place") > F.col("least"), F.col("offset"))).alias("earlier"),
                                               F.collect_list(F.when(F.col("place") < F.col("most"), F.col("offset"))).alias("later"))

    @F.arrow_udf("array<struct<lo:bigint,hi:bigint>>")
    def ranges(offsets: pa.Array) -> pa.Array:
        return _united(offsets)

    return offsets.select("key", "digest", ranges("earlier").alias("earlier"), ranges("later").alias("later"))


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first",
                 hot_bytes: int = HOT_BYTES, with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256) for every row: the byte spans of its UTF-8 text that are covered by
    strings of `length` bytes which also start elsewhere in the table, and the digest of what is left.  `with_bytes` adds that itself, as
    binary column `kept` (a cut may fall inside a character).

    keep="none": every copy goes, also within one text, overlaps included.  keep="first": a string goes if
    it also starts earlier, in the order of ids, then of the texts' digests, then of places; of rows with one text the one with the
    smallest id is the first.  Strings are judged on the input, not on what is left, and matches never cross rows.

    Null texts count as empty; texts shorter than `length` have no spans.  Rows with equal ids are rows of their own, so a
    repeated row's text is a copy.  Null ids come last.  Ids are integers; other columns are ignored, whatever their names.  An empty table
    gives an empty result.  Very long texts are hashed in pieces of CHUNK bytes and may be one class of runs with any number of others."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep: {keep}")
    spark = docs.sparkSession
    store = Store(spark, "repeats")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = (docs.select(F.col(id_col).cast("bigint").alias("id"), data.alias("data"))
            .withColumn("sha", F.sha2("data", 256)).withColumn("n_bytes", F.octet_length("data").cast("bigint")))
    ids = store.write(rows.select("id", "sha", "n_bytes", *["data"] * with_bytes).withColumn("uid", F.monotonically_increasing_id()), "ids")
    reps, name = _representatives(rows, store, length)
    runs = _runs(reps)
    classes = runs.groupBy("key", "digest").agg(F.sum("copies").alias("members"), F.first("n").alias("n"), F.max("looped").alias("looped"),
                                                F.min(F.struct("first_id", "sha", "start")).alias("first"))
    groups = (classes.groupBy("key").agg(F.sum("members").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") + (length - 1)).alias("size"),
                                         F.max("looped").alias("loops")).filter("total > 1 or loops = 1"))
    classes = store.write(classes.join(groups, "key"), "classes")
    # The strings of a lone class without loops all differ from each other.
    some = classes.filter("kinds > 1 or loops = 1")
    with arrow_rows(spark, 200):
        cold = store.write(_by_suffixes(_bytes_of(some.filter(F.col("size") <= hot_bytes), reps, length), length), "cold")
        hot = store.write(_by_fingerprints(_bytes_of(some.filter(F.col("size") > hot_bytes), reps, length), length, store), "hot")

    place = F.struct("first_id", "sha", "start")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi")))
    if keep == "none":
        ranges = F.when(F.col("members") > 1, whole).otherwise(F.concat("earlier", "later"))
        runs = runs.filter("copies = 1")  # texts with copies go as a whole
    else:
        ranges = F.when(place == F.col("first"), F.col("earlier")).otherwise(whole)
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    marks = (classes.drop("n", "looped").join(cold.unionByName(hot), ["key", "digest"], "left")
             .withColumns({c: F.coalesce(c, none) for c in ("earlier", "later")}).filter("members > 1 or size(earlier) > 0 or size(later) > 0"))
    spans = (runs.join(marks, ["key", "digest"]).select("sha", "start", F.explode(ranges).alias("r"))
             .groupBy("sha").agg(F.collect_list(F.struct((F.col("start") + F.col("r.lo")).alias("start"),
                                                         (F.col("start") + F.col("r.hi") + (length - 1)).alias("end"))).alias("spans")))
    with arrow_rows(spark, 200):
        cuts = store.write(_cut(spans.join(reps.select("sha", "data"), "sha"), with_bytes), "cuts")
    spark.sql(f"DROP TABLE IF EXISTS {name}")

    # Of rows with one text the first has the smallest id, then the smallest row number.
    order = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "uid")
    copies = ids.groupBy("sha").agg(F.count("*").alias("c"), F.min(order).alias("one")).filter("c > 1")
    gone = F.col("c").isNotNull() & (F.col("n_bytes") >= length) & (F.lit(True) if keep == "none" else order != F.col("one"))
    all_of = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    pick = lambda of_gone, of_cut, of_rest: F.when(F.col("gone"), of_gone).when(F.col("spans").isNotNull(), of_cut).otherwise(of_rest)
    out = (ids.join(copies, "sha", "left").withColumn("gone", F.coalesce(gone, F.lit(False))).join(cuts, "sha", "left")
           .select("*", pick(all_of, F.col("spans"), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed")))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("bigint")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.col("removed").alias("spans"),
        pick(F.sha2(F.lit("").cast("binary"), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        *[pick(F.lit("").cast("binary"), F.col("kept"), F.col("data")).alias("kept")] * with_bytes)


def _cut(texts: DataFrame, with_bytes: bool) -> DataFrame:
    """(sha, spans, n_removed, kept_sha256, kept) of texts with spans to be cut out."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        once("repeats.none", None)
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("data")[i].as_py()
                spans = merged([(x["start"], x["end"]) for x in b.column("spans")[i].as_py()])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                yield pa.RecordBatch.from_arrays([
                    b.column("sha").slice(i, 1), pa.array([[{"start": x, "end": y} for x, y in spans]], kind), pa.array([len(data) - len(kept)], pa.int64()),
                    pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept if with_bytes else None], pa.binary())],
                    names=["sha", "spans", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "sha string, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, kept_sha256 string, kept binary")
