"""Repeated 50-byte strings against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from gridlark.llm import substrings as S


def plain(rows):
    key = lambda i: (i is None, i or 0)
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if w not in first or key(i) < key(first[w]):
                first[w] = i
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if key(first[b[p : p + 50]]) < key(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    syl = "ba co dué fe gi ho ju ka lé mo nü pa re si to".split()
    text = lambda k: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(k))
    shared = [text(k) for k in (6, 8, 9, 12, 60, 300)] + ["ab" * 40, "x" * 70]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 90)))
        rows.append((i * 3 % n, " ".join(parts)))
    copies = [(1000 + k, rng.choice(rows)[1]) for k in range(30)]
    near = []
    for k in range(30):
        t = list(rng.choice(rows)[1])
        if t:
            t[rng.randrange(len(t))] = "#"
        near.append((2000 + k, "".join(t)))
    odd = [(None, rows[3][1]), (None, shared[5]), (5000, None), (5001, ""), (5002, "y" * 49), (5003, "y" * 50), (5004, "y" * 51), (5005, "\0" * 120), (5006, "\0" * 60), rows[7], (rows[7][0], shared[4] + "!"), (-5, shared[5][:400])]
    return rows + copies + near + odd


@pytest.mark.parametrize(("batch", "shard"), [(S.BATCH, S.SHARD), (3000, 700)])
def test_against_plain(spark, batch, shard):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, bid string, kind int").repartition(3)
    got = sorted((tuple(r) for r in S.repeated_bytes(df, batch=batch, shard=shard).collect()), key=repr)
    assert got == plain(rows)


def test_empty_table(spark):
    assert S.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    for raw in (b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"a", b"\0\0\0ab\0\0", bytes(rng.integers(97, 99, 700, dtype=np.uint8)), b"abcabcabd" * 60):
        sa, mark = S.suffix_array(raw, 1 << 20)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        assert not mark.any()
    for trial in range(200):
        base = bytes(rng.integers(97, 100, 60, dtype=np.uint8))
        raw = b"".join(base[int(x) : int(x) + int(y)] for x, y in zip(rng.integers(0, 40, 40), rng.integers(5, 60, 40), strict=True))[: 60 + 4 * trial]
        sa, mark = S.suffix_array(raw)
        heads = [raw[k : k + 50] for k in sa.tolist()]
        assert heads == sorted(heads)
        lcp = S.common_prefixes(raw, sa, mark, 50, lane=7 + trial % 60).tolist()
        for x, y, n in zip(heads, heads[1:], lcp[1:], strict=False):
            assert n == next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def test_texts(spark):
    t = "some words that are long enough to be found twice in two documents, surely"
    df = spark.createDataFrame([(1, t), (2, "a " + t + " z")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in S.repeated_bytes(df, texts=True).collect()} == {1: t, 2: "a  z"}
