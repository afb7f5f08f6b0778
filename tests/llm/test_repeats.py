"""Exact repeats against brute force over all byte strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import repeats

SCHEMA = "doc_id bigint, text string, sha string, data string, key string, start int, id int, copies int, spans string, first string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "d", "k", 1, 2, 3, "x", "f") for i, t in rows], SCHEMA)


def brute(rows, length, keep):
    """Sorted (id, n_bytes, n_removed, spans, kept)."""
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, hashlib.sha256(data[r]).hexdigest(), r))
    places = {}
    for r in order:
        for p in range(len(data[r]) - length + 1):
            places.setdefault(data[r][p:p + length], []).append((r, p))
    cover = [np.zeros(len(d), bool) for d in data]
    for found in places.values():
        for r, p in (found if keep == "none" else found[1:]) if len(found) > 1 else []:
            cover[r][p:p + length] = True
    out = []
    for (i, _), d, c in zip(rows, data, cover):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
        kept = bytes(np.frombuffer(d, np.uint8)[~c])
        out.append((i, len(d), int(c.sum()), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), kept))
    return sorted(out, key=str)


def found(df, **more):
    rows = repeats.find_repeats(df, with_bytes=True, **more).collect()
    for r in rows:
        assert r.n_spans == len(r.spans) and r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gämma", "δ", "e", "zeta\n", "日本"]) + str(rng.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, template = text(12), [text(5) for _ in range(8)]
    rows = [(i, text(rng.randrange(30))) for i in range(40)]
    rows += [(100 + i, text(6) + passage + text(6)) for i in range(10)]
    rows += [(200 + i, " ".join(f"{t} {rng.randrange(3)}" for t in template)) for i in range(40)]
    rows += [(300 + i, rows[45][1]) for i in range(5)] + [rows[3], rows[47], (None, rows[47][1]), (None, None), (7000, ""), (7001, None)]
    rows += [(400, "ab" * 150), (401, "x" * 300 + passage + "x" * 300), (402, text(20) * 3), (403, "abc" * 40 + text(4) + "abc" * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep,hot", [("none", repeats.HOT_BYTES), ("first", repeats.HOT_BYTES), ("none", 1), ("first", 1)])
def test_against_brute_force(spark, keep, hot):
    rows = corpus(3)
    assert found(docs_of(spark, rows), length=48, keep=keep, hot_bytes=hot) == brute(rows, 48, keep)


def test_production_length_and_long_texts(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, text), (2, "q" + text[300_000:300_400] + "r"), (3, text[10:409] + "!"), (4, "z" * 500_000), (5, text[:399]), (6, "z" * 400)]
    got = {r[0]: r for r in found(docs_of(spark, rows), keep="none")}
    assert got[1][3] == ((300_000, 300_400),) and got[2][3] == ((1, 401),) and got[3][2] == got[5][2] == 0
    assert got[4][2] == 500_000 and got[6][2] == 400
    first = {r[0]: r for r in found(docs_of(spark, rows), keep="first")}
    assert first[1][2] == 0 and first[2][3] == ((1, 401),) and first[4][3] == ((1, 500_000),) and first[6][2] == 400


def test_empty_table(spark):
    assert found(docs_of(spark, [(1, "x")]).limit(0)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=60).map(str.encode), min_size=1, max_size=6))
def test_suffix_order_and_factors(texts):
    """Order, common prefixes and factors of every string of six bytes against plain Python."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.array([p for t, at in zip(texts, np.cumsum([0] + [len(t) for t in texts])) for p in range(at, at + len(t) - 5)])
    cut = lambda p: bytes(data[p:p + 6])
    same = lambda x, y: next((k for k in range(6) if x[k] != y[k]), 6)
    order, common = repeats.suffix_order(data, starts, 6)
    assert [cut(p) for p in order] == sorted(map(cut, starts))
    assert common[1:].tolist() == [same(cut(a), cut(b)) for a, b in zip(order[:-1], order[1:])]
    previous, following = repeats.factors(order, common)
    for p, lpf, lnf in zip(order, previous, following):
        assert lpf == max((same(cut(p), cut(q)) for q in starts if q < p), default=0)
        assert lnf == max((same(cut(p), cut(q)) for q in starts if q > p), default=0)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=300).map(str.encode), st.integers(1, 40))
def test_runs_cover_all_strings_once(data, length):
    keys, digests, starts, counts, looped = repeats.runs_of(data, length)
    assert [p for s, n in zip(starts, counts) for p in range(s, s + n)] == list(range(max(0, len(data) - length + 1)))
    key_of = {}
    for k, s, n, loop in zip(keys, starts, counts, looped):
        strings = [data[p:p + length] for p in range(s, s + n)]
        assert loop or len(set(strings)) == n
        for x in strings:
            assert key_of.setdefault(x, k) == k


def test_strings_counted_by_fingerprint_are_ranges(spark):
    """A row for every string of a passage that large groups share made millions of rows."""
    common = random.Random(1).randbytes(300).hex()[:300].encode()
    rows = [(7, k, (k, f"s{k}", 0), b"%d-" % k + common + b"-%d" % k) for k in (1, 2, 3)]
    classes = spark.createDataFrame(rows, "key bigint, digest bigint, first struct<first_id:bigint,sha:string,start:bigint>, data binary")
    out = repeats._by_fingerprints(classes, 100, repeats.Store(spark, "repeats")).collect()
    got = {r.digest: ([tuple(x) for x in r.earlier], [tuple(x) for x in r.later]) for r in out}
    span = [(1, 204)]  # "-" + common + "-"
    assert got == {1: ([], span), 2: (span, span), 3: (span, [])}
