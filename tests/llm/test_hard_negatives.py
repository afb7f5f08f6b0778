"""Hard negatives: the packed tree and the best-first search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, row string, tile string, anchor string, window int, vec int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "r", "t", "a", 2, 3) for i, v, c in rows], SCHEMA)


def brute(rows, is_anchor, k=5, low=80, high=100):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, c) in enumerate(fine):
        if not is_anchor(i):
            continue
        scored = [(dot(v, w), j, d) for m, (j, w, d) in enumerate(fine) if m != n]
        pos = sorted([s for s in scored if s[2] == c], key=key)[:k]
        for p, j, _ in pos:
            neg = sorted([s for s in scored if s[2] != c and low * p <= 100 * s[0] <= high * p], key=key)[:k]
            out += [(i, j, r, x, p, s) for r, (s, x, _) in enumerate(neg, 1)]
    return sorted(out, key=str)


def mined(df, cond, **more):
    return sorted(map(tuple, hardneg.hard_negatives(df, cond, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Ties, repeated vectors and rows, hot labels; small leaves and tiles, so that trees have all their levels."""
    shape = hardneg.Shape(leaf=4, fan=3, tile=32, stretch=96, group=2, block=5)
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        v = [rng.choice([-1.0, -.5, 0.0, .25, .5, 1.0]) for _ in range(4)] if seed == 1 else [rng.gauss(1, 1) for _ in range(6)]
        rows.append((i, v, 0 if rng.random() < 0.4 else rng.randrange(4)))
    rows += [(400 + i, rows[7][1], rng.randrange(2)) for i in range(60)] + [(20, rows[20][1], rows[20][2]), (None, rows[5][1], 0)]
    df = frame(spark, rows)
    assert mined(df, F.col("vec_id") % 20 == 0, shape=shape) == brute(rows, lambda i: i is not None and i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.75], 2), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 2),
            (7, [1.0, 2.0], None), (8, [], 2), (9, [1.0], 2), (10, [1.0, 2.0, 3.0], 2), (11, [], 1), (100, [-5.0, -5.0], 3)]
    df = frame(spark, rows)
    pad = lambda v: None if v is None else v + [0.0] * (3 - len(v))
    assert mined(df, F.col("vec_id") % 100 == 0) == brute([(i, pad(v), c) for i, v, c in rows], lambda i: i % 100 == 0)
    assert mined(df.limit(0), F.col("vec_id") % 100 == 0) == []
    assert mined(df, F.lit(None).cast("boolean")) == []


def test_large_components_stay_exact(spark):
    """Beyond doubles' 53 bits: whole-number products."""
    rows = [(i, [900000.0 + i, -900001.0, 3.0 * i], i % 2) for i in range(40)]
    assert mined(frame(spark, rows), F.col("vec_id") == 0) == brute(rows, lambda i: i == 0)


def test_boxes_bound_scores_and_prune():
    rng = np.random.default_rng(5)
    vecs = np.concatenate([rng.integers(-40, 40, (500, 3)) + c for c in ([0, 0, 0], [900, 0, 0], [0, -900, 0])]).astype(np.int64)
    leaves = hardneg.slabs(vecs, [0, 1, 2], 128)
    assert sorted(np.concatenate(leaves)) == list(range(1500)) and max(map(len, leaves)) <= 128
    rows = np.concatenate(leaves)
    tile = hardneg.Tile(8, 3, rows, np.zeros(1500, np.int64), vecs[rows].ravel(), np.array([len(x) for x in leaves]),
                        np.concatenate([vecs[x].min(axis=0) for x in leaves]), np.concatenate([vecs[x].max(axis=0) for x in leaves]))
    anchor = np.array([1, 0, 0])
    least, most = tile.bounds(anchor[None])
    scores = tile.vecs @ anchor
    assert least[0, 0] == scores.min() and most[0, 0] == scores.max()
    best = hardneg.Best(-math.inf, math.inf, 5)
    read = hardneg.search(tile, anchor, 0, -1, True, [best], least[0], most[0])
    assert sorted((-s, -i) for s, i in best.found) == sorted(zip(-scores, rows))[:5]
    assert read <= len(leaves) / 2  # far boxes are never read
