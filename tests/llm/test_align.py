"""Alignment of two tokenizers against brute force, and the fragment monoid's laws."""

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import align
from ledgerlake.llm.tokencount import byte_letters

SCHEMA = "doc_id bigint, text string, id int, doc string, code int, bundle string, place int, groups string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "d", 2, "b", 3, "g") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(text, tokenizers):
    """[(id, bytes)] of both tokenizers, or None."""
    a, b = tokenizers
    letters = byte_letters()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    y = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (x, y) if text and b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else None


def brute(rows, tokenizers):
    groups, links = [], []
    for _, text in rows:
        found = spelled(text or "", tokenizers)
        gs = []
        if found:
            ends = [list(np.cumsum([len(t) for _, t in side])) for side in found]
            lo = 0
            for e in sorted(set(ends[0]) & set(ends[1])):
                gs.append(tuple([i for (i, _), x in zip(side, es) if lo < x <= e] for side, es in zip(found, ends)))
                lo = e
        groups.append(gs)
        links.append(Counter((x, y) for a, b in gs for x in a for y in b))
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), gs, c in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str), count


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "naïve", "über", "日本語", "don't", "it's", "12345", "3.14", "…", "—", "\n", "  ", "\t", "<s>", "<|endoftext|>", "<0x41>", "emoji😀", "aaaa",
             "x" * 30, "МОСКВА", "한국어", "\r\n", "https://a.b/c?d=1", "'ll", "!!!'s", "ꙮ", "​", "𝔘nicode", "ǅ", "中文。中文，"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 40))) for i in range(60)]
    rows += [(200 + i, text(400)) for i in range(6)] + [(300, "日本語中文" * 200), (301, "a" * 3000), (302, " " * 700), (303, "\n" * 700)]
    return rows + [(400, None), (401, ""), (402, "has ▁ inside"), (403, "▁" + text(300)), (404, " "), (5, rows[5][1]), (None, rows[6][1]), (405, text(300) + "▁")]


@pytest.mark.parametrize("chunk", [align.CHUNK, 100, 9])
def test_against_brute_force(spark, tokenizers, chunk):
    rows = rows_of(4)
    want, count = brute(rows, tokenizers)
    documents, pairs, groups = align.align(docs_of(spark, rows), chunk=chunk, with_groups=True)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, documents.select(cols).collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n_documents for r in pairs.collect()} == dict(count)
    parts = {}
    for r in sorted(groups.collect(), key=lambda r: r.place):
        parts.setdefault((r.doc_id, r.doc), []).append(r.groups)
    shown = Counter((i, hashlib.sha256(";".join(p).encode()).hexdigest()) for (i, _), p in parts.items())
    assert shown == Counter((r[0], r[-1]) for r in want if r[-1])


def test_empty_table(spark):
    documents, pairs, _ = align.align(docs_of(spark, [(1, "x")]).limit(0))
    assert documents.collect() == [] and pairs.collect() == []


def shape(f):
    """A fragment's prefix, closed groups and suffix in plain values."""
    side = lambda s: list(zip(s.ids.tolist(), s.ends.tolist()))
    closed = None if f.closed is None else ";".join(g.text() for g in f.closed if g.n)
    return [side(s) for s in f.prefix], closed, [side(s) for s in f.suffix]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40)), st.lists(st.integers(0, 40), min_size=2, max_size=5), st.lists(st.integers(0, 40), min_size=2, max_size=5))
def test_fragments_are_a_monoid(a, b, cut_a, cut_b):
    """However a stretch is cut, and however its fragments are composed, the result is the fragment of the whole."""
    sides = [align.Side(range(len(e)), sorted(e)) for e in (a, b)]
    whole = align.Fragment.of(*sides)

    def pieces(side, cuts):
        cuts = [0, *sorted(cuts), 99]
        return [align.Side(side.ids[(side.ends > lo) & (side.ends <= hi)], side.ends[(side.ends > lo) & (side.ends <= hi)]) for lo, hi in zip(cuts[:-1], cuts[1:])]

    k = min(len(cut_a), len(cut_b))
    parts = [align.Fragment.of(x, y) for x, y in zip(pieces(sides[0], cut_a[:k]), pieces(sides[1], cut_b[:k]))]
    add = lambda x, y: x + y
    left = reduce(add, parts, align.EMPTY)
    right = reduce(lambda x, y: y + x, reversed(parts), align.EMPTY)
    tree = reduce(add, [reduce(add, parts[i:i + 2]) for i in range(0, len(parts), 2)])
    assert shape(left) == shape(right) == shape(tree) == shape(whole)
