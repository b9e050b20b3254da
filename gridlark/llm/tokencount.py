"""Token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens of a slice of texts (white-space words behind a word mark) are
inserted in a trie, level by level over their sorted order. Forward scores are
computed once per trie node, so once per shared prefix, and each pre-token's count
is read off its terminal node. Counts are kept from slice to slice in a bounded
table. The best segmentation is the one the unigram model gives: highest sum of
scores, the longest last piece first among equals; characters that no piece covers
cost the lowest score less ten and count one token per UTF-8 byte.

The vocabulary is a public model file (a parameter). Files of unigram type carry
scores; files of merge type carry ranks, which are read as Zipf scores -ln(rank + 2).

Defined cases: null and empty texts have no tokens; very long words are worked off
alone; repeated rows are judged alone; only id and text are read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import annotate, per_text
from .piece import parse_model

MARK = "▁"
WIDE = 64  # longest word, mark included, that goes through the trie
KEPT = 150_000  # words whose counts are kept from slice to slice


def unigram_scores(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a model file's normal pieces, and whether unknown characters fall back to bytes."""
    model = parse_model(path)
    if model["type"] == 1:
        pieces = [(p, s) for p, s, kind in model["pieces"] if kind == 1]
    else:
        pieces = [(p, -math.log(2.0 - s)) for p, s, kind in model["pieces"] if kind == 1 and s > -1e8]
    return pieces, model["byte_fallback"]


class TrieCounter:
    """Counts of tokens by word, by forward scores over a trie."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.pieces = dict(pieces)
        self.fallback = byte_fallback
        self.unknown = min(self.pieces.values(), default=0.0) - 10.0
        self.most = max(map(len, self.pieces), default=1)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.powers = np.array([pow(int(self.base), k, 1 << 64) for k in range(self.most + 1)], dtype=np.uint64)
        keys = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        assert len(np.unique(self.keys)) == len(self.keys), "two pieces share a hash"
        self.scores = np.array(list(self.pieces.values()))[order]
        self.names = np.array(list(self.pieces), dtype=object)[order]
        # The lookup is exact: a hash in this table stands for one piece, and other
        # substrings are ruled out by a second, independent hash.
        self.second = np.array([self._second(p) for p in self.names], dtype=np.uint64)
        self.bits = 21
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.more: dict[int, int] = {}
        for i, k in enumerate(self.keys.tolist()):
            h = k >> (64 - self.bits)
            if self.slot[h] == -1:
                self.slot[h] = i
            else:
                self.more[k] = i
        self.extra = np.array(sorted(self.more), dtype=np.uint64)
        self.extra_at = np.array([self.more[k] for k in sorted(self.more)], dtype=np.int32)
        self.known: dict[str, int] = {}

    def _hash(self, s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(self.base) + (ord(c) + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _second(s: str) -> int:
        h = 0
        for c in s:
            h = (h * 0xC2B2AE3D27D4EB4F + (ord(c) + 1) * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
        return h

    def plain(self, word: str) -> int:
        """The same count for one word, without a trie."""
        best = [0.0] + [-math.inf] * len(word)
        count = [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.most), end):
                s = self.pieces.get(word[start:end])
                c = 1
                if s is None:
                    if end - start > 1:
                        continue
                    s, c = self.unknown, len(word[start:end].encode("utf-8", "surrogatepass")) if self.fallback else 1
                if best[start] + s > best[end]:
                    best[end], count[end] = best[start] + s, count[start] + c
        return count[-1]

    def by_trie(self, words: list[str]) -> np.ndarray:
        """Counts of distinct words that are sorted by code point and no longer than WIDE."""
        n = len(words)
        m = np.array(words, dtype=f"U{WIDE}").view(np.uint32).reshape(n, WIDE)
        size = np.array(list(map(len, words)))
        deepest = int(size.max())
        m = m[:, :deepest]
        # Length of the prefix shared with the word before: where a word's own nodes begin.
        shared = np.zeros(n, dtype=np.int64)
        if n > 1:
            diff = m[1:] != m[:-1]
            shared[1:] = np.where(diff.any(1), diff.argmax(1), deepest)
        second = np.uint64(0xC2B2AE3D27D4EB4F)
        second_powers = np.array([pow(int(second), k, 1 << 64) for k in range(self.most + 1)], dtype=np.uint64)
        best: list[np.ndarray] = [np.zeros(1)]
        count: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        node: list[np.ndarray] = [np.zeros(n, dtype=np.int32)]
        h1: list[np.ndarray] = [np.zeros(1, dtype=np.uint64)]
        h2: list[np.ndarray] = [np.zeros(1, dtype=np.uint64)]
        result = np.zeros(n, dtype=np.int64)
        for depth in range(1, deepest + 1):
            fresh = (size >= depth) & (shared < depth)
            rep = np.nonzero(fresh)[0]  # one word for each node of this level
            node.append((np.cumsum(fresh) - 1).astype(np.int32))
            char = m[rep, depth - 1].astype(np.uint64) + np.uint64(1)
            up = node[depth - 1][rep]
            h1.append(h1[-1][up] * self.base + char * np.uint64(0xD6E8FEB86659FD93))
            h2.append(h2[-1][up] * second + char * np.uint64(0x165667B19E3779F9))
            top = np.full(len(rep), -np.inf)
            n_top = np.zeros(len(rep), dtype=np.int64)
            for length in range(min(self.most, depth), 0, -1):
                before = node[depth - length][rep]
                key = h1[depth] - h1[depth - length][before] * self.powers[length]
                at = self.slot[(key >> np.uint64(64 - self.bits)).astype(np.int64)]
                hit = (at >= 0) & (self.keys[at] == key)
                if len(self.extra):
                    maybe = np.nonzero((at >= 0) & ~hit)[0]
                    if len(maybe):
                        j = np.minimum(np.searchsorted(self.extra, key[maybe]), len(self.extra) - 1)
                        ok = self.extra[j] == key[maybe]
                        at[maybe[ok]] = self.extra_at[j[ok]]
                        hit[maybe[ok]] = True
                i = np.nonzero(hit)[0]
                if len(i):
                    check = h2[depth][i] - h2[depth - length][before[i]] * second_powers[length]
                    i = i[self.second[at[i]] == check]
                if length == 1:
                    lost = np.ones(len(rep), bool)
                    lost[i] = False
                    u = np.nonzero(lost)[0]
                    code = m[rep[u], depth - 1]
                    wide = (1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)) if self.fallback else np.ones(len(u), dtype=np.int64)
                    s = best[depth - 1][before[u]] + self.unknown
                    better = s > top[u]
                    top[u[better]] = s[better]
                    n_top[u[better]] = (count[depth - 1][before[u]] + wide)[better]
                if len(i):
                    s = best[depth - length][before[i]] + self.scores[at[i]]
                    better = s > top[i]
                    top[i[better]] = s[better]
                    n_top[i[better]] = count[depth - length][before[i[better]]] + 1
            best.append(top)
            count.append(n_top)
            ends = np.nonzero(size == depth)[0]
            result[ends] = n_top[node[depth][ends]]
        return result

    def counts(self, words: set[str]) -> dict[str, int]:
        """Counts of words (mark included), by trie for all but very long ones."""
        fit = sorted(w for w in words if len(w) <= WIDE and "\0" not in w)
        out = {w: self.plain(w) for w in words if len(w) > WIDE or "\0" in w}
        for k in range(0, len(fit), 50_000):
            part = fit[k : k + 50_000]
            out.update(zip(part, self.by_trie(part).tolist(), strict=True))
        return out

    def __call__(self, texts: list[str]) -> dict:
        lists = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        known = self.known
        missing = set(chain.from_iterable(lists)).difference(known)
        if len(known) + len(missing) > KEPT:
            known = self.known = {}
            missing = set(chain.from_iterable(lists))
        marked = {MARK + w.decode("utf-8", "surrogatepass"): w for w in missing}
        for word, c in self.counts(set(marked)).items():
            known[marked[word]] = c
        return {"n_chars": [len(t) for t in texts], "n_pretokens": [len(x) for x in lists], "n_tokens": [sum(map(known.__getitem__, x)) for x in lists]}


SCHEMA = "n_chars long, n_pretokens long, n_tokens long"


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: code points, pre-tokens and tokens. The model is read once, on the driver."""
    pieces, fallback = unigram_scores(model_path)
    return annotate(docs, per_text(lambda: TrieCounter(pieces, fallback), SCHEMA), id_col, text_col)
