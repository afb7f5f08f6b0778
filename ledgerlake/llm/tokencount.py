"""Greedy longest-match piece counts in one linear pass over each word.

The vocabulary is a trie over bytes and an end-of-word symbol.  Every trie
node has a failure link and the number of pieces that are popped on the way
there: when no edge fits the next symbol, the pieces that greedy matching
would have cut off so far are counted at once and matching goes on from the
failure node.  No piece is ever built and no symbol is read twice.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, values

END = 256  # symbol after a word's last byte
CACHE_WORDS = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file as symbol sequences; special pieces are left out."""
    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    end = spec["model"].get("end_of_word_suffix") or ""
    special = {t["content"] for t in spec.get("added_tokens", [])}
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            ends = bool(end) and piece.endswith(end)
            out.append(tuple(letters[c] for c in (piece[:-len(end)] if ends else piece)) + (END,) * ends)
    return out


class Automaton:
    """Trie with failure links (-1: none) and popped-piece counts."""

    def __init__(self, pieces):
        self.edges: dict[int, int] = {}  # state * 512 + symbol -> state
        whole, parent, symbol = [False], [0], [0]
        for piece in pieces:
            u = 0
            for c in piece:
                v = self.edges.get(u * 512 + c)
                if v is None:
                    v = self.edges[u * 512 + c] = len(whole)
                    whole.append(False)
                    parent.append(u)
                    symbol.append(c)
                u = v
            whole[u] = u != 0
        depth = [0] * len(whole)
        for v in range(1, len(whole)):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        for v in sorted(range(1, len(whole)), key=depth.__getitem__):
            if whole[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, n, c = parent[v], 0, symbol[v]
            n, z = self.popped[u], self.fail[u]
            while z >= 0 and (z * 512 + c) not in self.edges:
                n, z = n + self.popped[z], self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.edges[z * 512 + c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if its greedy cut meets a symbol that no piece starts with."""
        edges, fail, popped = self.edges, self.fail, self.popped
        u = n = 0
        for c in (*word, END):
            while (v := edges.get(u * 512 + c)) is None:
                n, u = n + popped[u], fail[u]
                if u < 0:
                    return 1
            u = v
        while u:
            n, u = n + popped[u], fail[u]
            if u < 0:
                return 1
        return n


class _Counts(dict):
    def __init__(self, path: str):
        super().__init__()
        self.automaton = Automaton(load_pieces(path))

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) < CACHE_WORDS:
            self[word] = n
        return n


def token_counts(df: DataFrame, text_col: str = "text", *, out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """Adds the long column `out`: pieces of all words of the text, words being runs of anything but
    the six ASCII blanks, with A-Z lower-cased.  Null and empty texts have none; repeated rows
    repeat; a column already named `out` is replaced."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        counts = once("tokencount.words", path, _Counts)
        n = [sum(map(counts.__getitem__, t.encode("utf-8", "replace").lower().split())) if t else 0
             for t in values(texts)]
        return pa.array(np.array(n, np.int64))

    return df.withColumn(out, count(F.col(text_col).cast("string")))
