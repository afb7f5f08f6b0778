"""Hard negatives by exact search in a packed R-tree.

Vectors are packed sort-tile-recursively: Spark range-sorts the rows by the coordinate that varies most, and
within a stretch of sorted rows they are cut into slabs by the next coordinates down to leaves.  A tile is one row
of a written table: a subtree of some thousand vectors with the bounding box of its root, of its inner boxes and of its
leaves.  A box gives an interval for each coordinate's product with an anchor, and their sums an interval for the score.

Anchors meet tiles in blocks.  For each anchor a best-first queue takes boxes by their upper bound; a box outside
every wanted score window, or strictly below the worst of an answer that is already full (ties go by id, so equal bounds
are still looked at), is pruned.  The best rows of each task are merged by Spark.  The same search runs twice: first for the
positives (one window without limits, rows of the anchor's label), then for the negatives (a window a positive, rows of other labels).

Nothing is approximate: the pruning bounds are exact in integers.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, arrow_rows, split, task_count



@dataclass(frozen=True)
class Shape:
    """Sizes of the tree and of the work handed to a task; they change no result."""

    leaf: int = 128  # vectors of a leaf
    fan: int = 8  # leaves of an inner box
    tile: int = 4096  # vectors of a tile
    stretch: int = 16 * 4096  # sorted rows that a task packs at a time
    dims: int = 3  # coordinates that the packing sorts by
    group: int = 16  # most tiles that a task holds for one pass over the anchors
    block: int = 512  # anchors that travel together


ARROW_ROWS = 4  # pairs of a tile and a block in a batch for Python
LIMIT = 1 << 28  # components are cut off there: 64 products of two then fit 64 bits
_EXACT = 1 << 20  # below it sums of products are exact in doubles
_NO_ID = np.iinfo(np.int64).max


def clean(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, label, vec): rows with a label and a vector without null or non-finite components, each component
    floor(scale * x).  Components beyond +-LIMIT are cut off there."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.lit(float(scale)) * v).cast("double"))).cast("bigint"))
    return (rows.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
            .select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("vec")))


def _by_spread(vectors: DataFrame, n: int) -> list[int]:
    """The places of the n coordinates with the largest variance: one row a coordinate."""
    found = (vectors.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v"))
             .orderBy(F.desc("v"), "d").limit(n).collect())
    return [r.d for r in found]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows are filled up with zeros."""
    parts = split(column)
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for k, p in enumerate(parts):
        out[k, :len(p)] = p
    return out


def slabs(m: np.ndarray, dims: list[int], size: int) -> list[np.ndarray]:
    """Row numbers of tiles of at most `size` rows: sorted and cut by the first of `dims`, each slab likewise by the rest."""
    def cut(rows: np.ndarray, rest: list[int]) -> list[np.ndarray]:
        if len(rows) <= size:
            return [rows]
        if rest:
            rows = rows[np.argsort(m[rows, rest[0]], kind="stable")]
        n = math.ceil(len(rows) / size)
        step = size * math.ceil(n ** (1 - 1 / max(1, len(rest)))) if len(rest) > 1 else size
        return [t for i in range(0, len(rows), step) for t in (cut(rows[i:i + step], rest[1:]) if len(rest) > 1 else [rows[i:i + step]])]

    return cut(np.arange(len(m)), [d for d in dims if d < m.shape[1]])


_TILE = "dim int, ids array<bigint>, labels array<bigint>, vecs array<int>, sizes array<int>, low array<int>, high array<int>"


def pack(vectors: DataFrame, store: Store, shape: Shape = Shape()) -> DataFrame:
    """The tiles of all vectors, as a written table; a leaf of a tile is a run of its rows, with their number in `sizes`
    and their box in `low` and `high`."""
    dims = _by_spread(vectors, shape.dims)
    keys: list[Column] = [F.coalesce(F.get("vec", F.lit(d)), F.lit(0)) for d in dims]
    # Ids last: rows with equal vectors are spread as well.
    order = [*keys, F.col("id")]
    fields = pa.schema([("dim", pa.int32()), *((n, pa.list_(pa.int64())) for n in ("ids", "labels")),
                        *((n, pa.list_(pa.int32())) for n in ("vecs", "sizes", "low", "high"))])

    def tiles(batches):
        def packed(held):
            t = pa.Table.from_batches(held).combine_chunks()
            m = _matrix(t.column("vec").combine_chunks())
            ids = t.column("id").fill_null(_NO_ID).to_numpy()
            labels = t.column("label").to_numpy()
            for rows in slabs(m, dims, shape.tile):
                leaves = [rows[x] for x in slabs(m[rows], dims[1:] + dims[:1], shape.leaf)]
                rows, boxes = np.concatenate(leaves), [m[x] for x in leaves]
                row = {"dim": m.shape[1], "ids": ids[rows], "labels": labels[rows], "vecs": m[rows].ravel(),
                       "sizes": np.array([len(x) for x in leaves], np.int32),
                       "low": np.concatenate([x.min(axis=0) for x in boxes]), "high": np.concatenate([x.max(axis=0) for x in boxes])}
                yield pa.RecordBatch.from_pylist([row], fields)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= shape.stretch:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    out = vectors.repartitionByRange(task_count(vectors.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(tiles, _TILE)
    return store.write(out.withColumn("tile", F.monotonically_increasing_id()), "tiles")


class Tile:
    """A packed subtree: box 0 is the root, then inner boxes, then leaves."""

    def __init__(self, fan: int, dim: int, ids, labels, vecs, sizes, low, high):
        self.dim, self.ids, self.labels = dim, ids, labels
        vecs = vecs.reshape(len(ids), dim)
        kind = np.float64 if not vecs.size or max(-vecs.min(), vecs.max()) <= _EXACT else np.int64
        self.vecs = vecs.astype(kind)
        low, high = low.reshape(len(sizes), dim).astype(np.int64), high.reshape(len(sizes), dim).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        inner = range(0, len(sizes), fan)
        self.leaf0 = 1 + len(inner)
        self.children = {0: list(range(1, self.leaf0))} | {1 + k: [self.leaf0 + j for j in range(i, min(i + fan, len(sizes)))] for k, i in enumerate(inner)}
        self.rows = [slice(a, b) for a, b in zip(at[:-1], at[1:])]
        self.low = np.concatenate([low.min(axis=0)[None], *[low[i:i + fan].min(axis=0)[None] for i in inner], low])
        self.high = np.concatenate([high.max(axis=0)[None], *[high[i:i + fan].max(axis=0)[None] for i in inner], high])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with any point of each box, the per-coordinate intervals summed up."""
        kind = np.float64 if max(np.abs(anchors).max(initial=0), np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) <= _EXACT else np.int64
        plus, minus = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        low, high = self.low.T.astype(kind), self.high.T.astype(kind)
        return plus @ low + minus @ high, plus @ high + minus @ low


class Best:
    """The k best (score, id) of one window; larger scores come first, then smaller ids."""

    __slots__ = ("low", "high", "k", "found")

    def __init__(self, low, high, k):
        self.low, self.high, self.k, self.found = low, high, k, []

    def wants(self, least, most) -> bool:
        """May a box with scores in [least, most] hold a row for the answer?  Equal bounds count, since ids decide ties."""
        return most >= self.low and least <= self.high and (len(self.found) < self.k or most >= self.found[0][0])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.low) & (scores <= self.high)
        if len(self.found) == self.k:
            ok &= scores >= self.found[0][0]
        if not ok.any():
            return
        scores, ids = scores[ok], ids[ok]
        if len(scores) > self.k:
            top = np.lexsort((ids, -scores))[:self.k]
            scores, ids = scores[top], ids[top]
        for s, i in zip(scores.tolist(), ids.tolist()):
            item = (int(s), -i)  # the heap's least is the worst: lowest score, then largest id
            if len(self.found) < self.k:
                heapq.heappush(self.found, item)
            elif item > self.found[0]:
                heapq.heapreplace(self.found, item)


def search(tile: Tile, anchor: np.ndarray, label: int, own_id: int, same: bool, windows: list[Best], least, most) -> int:
    """Best-first search of one tile for one anchor; returns the number of leaves read.

    `same`: rows of the anchor's label, but for one row with `own_id` and the anchor's vector (itself); else rows of other labels."""
    queue, read = [(-most[0], 0)], 0
    # Products of a vector in doubles and an anchor in integers would lose exactness: both in one type.
    anchor = anchor.astype(tile.vecs.dtype) if np.abs(anchor).max(initial=0) <= _EXACT else anchor
    vecs = tile.vecs if anchor.dtype == tile.vecs.dtype else tile.vecs.astype(np.int64)
    while queue:
        bound, box = heapq.heappop(queue)
        if not any(w.wants(least[box], -bound) for w in windows):
            continue
        if box < tile.leaf0:
            for c in tile.children[box]:
                if any(w.wants(least[c], most[c]) for w in windows):
                    heapq.heappush(queue, (-most[c], c))
            continue
        rows, read = tile.rows[box - tile.leaf0], read + 1
        labels, ids = tile.labels[rows], tile.ids[rows]
        ok = labels == label if same else labels != label
        if same and (own := np.flatnonzero(ok & (ids == own_id))).size:
            mine = own[(vecs[rows][own] == anchor).all(axis=1)]
            ok[mine[:1]] = False
        if ok.any():
            scores = vecs[rows] @ anchor
            for w in windows:
                w.add(scores[ok], ids[ok])
    return read


def _searched(tiles: DataFrame, anchors: DataFrame, same: bool, k: int, shape: Shape) -> DataFrame:
    """(row, window, id, score): for each window of each anchor the k best rows, merged over all tiles.

    Tiles are held in groups; each group meets every block of anchors, and no state outlives a block and group."""
    n = tiles.count()
    groups = max(1, -(-n // shape.group), min(n, task_count(tiles.sparkSession)))
    numbered = tiles.withColumn("g", F.pmod(F.hash("tile"), F.lit(groups))).repartition(groups, "g")
    spread = _blocks(anchors, shape.block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
    out = pa.schema([("row", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def answers(state) -> pa.RecordBatch:
        found = [(r, w, -i, s) for r, windows in state for w, best in windows for s, i in best.found]
        cols = list(zip(*found)) if found else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    def run(batches):
        # Rows come block by block or tile by tile, as the join likes: bests are kept for some blocks and merged by Spark in the end.
        states: dict = {}
        built: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                col = {n: b.column(n).slice(i, 1) for n in b.schema.names}
                row = {n: col[n][0].as_py() for n in ("g", "block", "tile", "dim")}
                flat = lambda n: col[n].flatten().to_numpy(zero_copy_only=False)
                if row["tile"] not in built:
                    while len(built) >= shape.group:
                        built.pop(next(iter(built)))
                    built[row["tile"]] = Tile(shape.fan, row["dim"], *(flat(n) for n in ("ids", "labels", "vecs", "sizes", "low", "high")))
                tile = built[row["tile"]]
                m = _matrix(col["a_vecs"].flatten())
                dim = max(tile.dim, m.shape[1])
                m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
                if tile.dim < dim:
                    tile = _widened(tile, dim)
                key = (row["g"], row["block"])
                if key not in states:
                    if len(states) >= 16:
                        yield answers(states.pop(next(iter(states))))
                    lows, highs, names = (col[n].flatten().to_pylist() for n in ("a_low", "a_high", "a_window"))
                    states[key] = [(r, [(w, Best(lo, hi, k)) for w, lo, hi in zip(ws, los, his)])
                                   for r, ws, los, his in zip(flat("a_rows").tolist(), names, lows, highs)]
                least, most = tile.bounds(m)
                least, most = least.tolist(), most.tolist()
                ids = col["a_ids"].flatten().fill_null(_NO_ID).to_pylist()
                labels = flat("a_labels").tolist()
                for j, (_, windows) in enumerate(states[key]):
                    search(tile, m[j], labels[j], ids[j], same, [w for _, w in windows], least[j], most[j])
        for s in states.values():
            yield answers(s)

    found = spread.join(numbered, "g").mapInArrow(run, "row bigint, window int, id bigint, score bigint")
    best = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _widened(tile: Tile, dim: int) -> Tile:
    """The same tile with more coordinates, all zero."""
    wide = Tile.__new__(Tile)
    wide.__dict__.update(tile.__dict__)
    pad = ((0, 0), (0, dim - tile.dim))
    wide.dim, wide.vecs, wide.low, wide.high = dim, np.pad(tile.vecs, pad), np.pad(tile.low, pad), np.pad(tile.high, pad)
    return wide


def _blocks(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors with their windows, `size` of them a row."""
    names = ("row", "id", "label", "vec", "window", "low", "high")
    out = dict(zip(names, ("a_rows", "a_ids", "a_labels", "a_vecs", "a_window", "a_low", "a_high")))
    # Rows are numbered from 0 within each partition of the written table: a block is a run of one partition.
    per = F.collect_list(F.struct(*names)).alias("x")
    return (anchors.groupBy(F.expr(f"row div {size}").alias("block")).agg(per)
            .select("block", *[F.col(f"x.{n}").alias(out[n]) for n in names]))


def hard_negatives(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   shape: Shape = Shape()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives`
    best other rows of its label, the `negatives` best rows of other labels with low * p <= 100 * n <= high * p, where p and n are
    their scores.  Scores are inner products of the components floor(scale * x); ties go by id.

    `anchors` is a condition on the input's columns.  Rows with a null label, a null vector or any null or non-finite
    component take no part; empty vectors and shorter ones count as filled up with zeros.  Rows with equal ids are rows of their own: an
    anchor that occurs twice answers twice, and its copy is one of its positives.  A null id is never an anchor by a condition on the id,
    comes last among ties and is returned as null.  Anchors without another row of their label, or without a row in a window, have no rows
    there; an empty table gives an empty result.  Other columns are ignored, whatever their names."""
    store = Store(vectors.sparkSession, "hardneg")
    names = {"id_col": id_col, "label_col": label_col, "vec_col": vec_col, "scale": scale}
    tiles = pack(clean(vectors, **names), store, shape)
    picked = clean(vectors.filter(F.coalesce(anchors, F.lit(False))), **names)
    picked = picked.repartition(1 + picked.count() // (4 * shape.block))
    picked = store.write(picked.withColumn("row", F.monotonically_increasing_id()), "anchors")

    whole = picked.select("*", F.array(F.lit(0)).alias("window"), F.array(F.lit(-(1 << 62)).cast("bigint")).alias("low"),
                          F.array(F.lit(1 << 62).cast("bigint")).alias("high"))
    found = _searched(tiles, whole, True, positives, shape)
    with arrow_rows(vectors.sparkSession, ARROW_ROWS):
        pos = store.write(found.select("row", F.col("rank").cast("int").alias("window"), F.col("id").alias("positive"), F.col("score").alias("p")),
                          "positives")
    # 100 * n lies between low * p and high * p: whole numbers from ceil(low * p / 100) to floor(high * p / 100).
    least = F.ceil(F.expr(f"cast(p as decimal(25, 0)) * {low} / 100")).cast("bigint")
    most = F.floor(F.expr(f"cast(p as decimal(25, 0)) * {high} / 100")).cast("bigint")
    wanted = pos.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("window", least.alias("low"), most.alias("high")))).alias("w"))
    inner = picked.join(wanted.select("row", F.col("w.window").alias("window"), F.col("w.low").alias("low"), F.col("w.high").alias("high")), "row")
    found = _searched(tiles, inner, False, negatives, shape)
    with arrow_rows(vectors.sparkSession, ARROW_ROWS):
        neg = store.write(found, "negatives")
    ids = lambda c: F.nullif(F.col(c), F.lit(int(_NO_ID)))
    return (neg.join(pos, ["row", "window"]).join(picked.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", ids("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), ids("id").alias("negative_id"),
                    F.col("p").alias("positive_score"), F.col("score").alias("negative_score")))
