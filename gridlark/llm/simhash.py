"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: the majority of each bit over the XXH64 hashes (seed 42) of 3-word
shingles. Equal fingerprints are one class. Classes whose fingerprints differ in at
most `radius` bits are found by pigeonhole: of radius + 2 parts at least two are
equal, so classes meet under the pairs of parts that they share. Within a meeting,
fingerprints are stored as vertical bit planes, 64 to a machine word; the distances
of one fingerprint to all others of a block come from carry-save counters over the
planes, and a block is abandoned as soon as all its counters exceed the radius.
Meetings of two are compared together, pair by pair, on planes of the same kind.
Meetings of more than a block are cut into pairs of blocks dealt over tasks. Each
block pair returns a spanning forest of its links, not all of them, which keeps
components the same. Components are contracted on the cluster.

Defined cases: null and empty texts have no words: fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; null ids keep their row, with the
component of their class; repeated rows and ids are rows of their own; very long texts
are hashed whole, their bits counted in slices; an empty table gives an empty result;
only id and text are read. `nearcopies` drops rows, on 5-word shingles.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import materialize, parallelism, ship

from .common import per_text
from .components import components, forest

RADIUS = 2
BLOCK = 2048
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; fewer words than a shingle are one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(w) < words:
        return np.array([digest(b" ".join(w))] if w else [], dtype=np.uint64)
    return np.fromiter(map(digest, map(b" ".join, zip(*(w[k:] for k in range(words))))), dtype=np.uint64, count=len(w) - words + 1)


def majority(h: np.ndarray) -> np.uint64:
    """The fingerprint of hashes: a bit is 1 where over half of them have it; zero without any."""
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        count += np.unpackbits(h[k : k + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(texts: list[str], words: int = 3, seed: int = 42) -> np.ndarray:
    return np.array([majority(hashes(t, words, seed)) for t in texts], dtype=np.uint64)


def planes(fp: np.ndarray) -> np.ndarray:
    """[64, ceil(n / 64)]: bit b of fingerprint i is bit i % 64 of planes[b, i // 64]."""
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-n // 64) * 64), dtype=np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Distances of many fingerprints in binary, one bit plane a digit, with a sticky overflow.

    Planes of differing bits are added two at a time by a carry-save adder; its carry
    ripples into the higher digits.
    """

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.digits = [np.zeros(shape, dtype=np.uint64) for _ in range(max(2, radius.bit_length()))]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        low = self.digits[0]
        half = low ^ one
        carry = (low & one) | (half & two)
        self.digits[0] = half ^ two
        for k in range(1, len(self.digits)):
            self.digits[k], carry = self.digits[k] ^ carry, self.digits[k] & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Bits of the counters that are past the radius."""
        more, same = self.over.copy(), ~self.over
        for k in reversed(range(len(self.digits))):
            if self.radius >> k & 1:
                same &= self.digits[k]
            else:
                more |= same & self.digits[k]
                same &= ~self.digits[k]
        return more

    def keep(self, alive: np.ndarray) -> None:
        self.digits = [d[alive] for d in self.digits]
        self.over = self.over[alive]


def near(one: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of one, j of others) whose fingerprints differ in at most radius bits (under 64).

    64 distances a machine word, and all of `one` at a time; a fingerprint of `one` is
    abandoned as soon as all its counters are past the radius.
    """
    store = planes(others)
    found_i, found_j = [], []
    step = max(1, 500_000 // max(1, store.shape[1]))
    for at in range(0, len(one), step):
        q = one[at : at + step]
        rows = np.arange(len(q))
        count = Counters((len(q), store.shape[1]), radius)
        for b in range(0, 64, 2):
            flip = [np.where((q >> np.uint64(k)) & np.uint64(1), ONES, np.uint64(0))[:, None] for k in (b, b + 1)]
            count.add(store[b][None, :] ^ flip[0], store[b + 1][None, :] ^ flip[1])
            if b % 8 == 6:
                alive = (count.beyond() != ONES).any(1)
                if not alive.all():
                    rows, q = rows[alive], q[alive]
                    count.keep(alive)
                    if not len(rows):
                        break
        if len(rows):
            bits = np.unpackbits((~count.beyond()).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")[:, : len(others)]
            i, j = np.nonzero(bits)
            found_i.append(rows[i] + at)
            found_j.append(j)
    if not found_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Flags: left[k] and right[k] differ in at most radius bits. 64 pairs a word; words past the radius are abandoned."""
    n = len(left)
    if not n:
        return np.zeros(0, dtype=bool)
    diff = planes(left) ^ planes(right)
    words = np.arange(diff.shape[1])
    count = Counters((len(words),), radius)
    for b in range(0, 64, 2):
        count.add(diff[b, words], diff[b + 1, words])
        if b % 8 == 6:
            alive = count.beyond() != ONES
            if not alive.all():
                words = words[alive]
                count.keep(alive)
                if not len(words):
                    break
    hit = np.zeros(diff.shape[1], dtype=np.uint64)
    hit[words] = ~count.beyond()
    return np.unpackbits(hit.view(np.uint8), bitorder="little")[:n].astype(bool)


def parts(radius: int = RADIUS) -> list[int]:
    """Masks under which two fingerprints within radius must agree at least once: pairs of radius + 2 parts."""
    n = radius + 2
    cut = [64 * k // n for k in range(n + 1)]
    mask = [((1 << cut[k + 1]) - (1 << cut[k])) for k in range(n)]
    return [a | b for a, b in combinations(mask, 2)]


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between class representatives, enough for the components. classes: fp long, rep long."""
    spark = classes.sparkSession
    ship(spark)
    masks = [m - (1 << 64) if m >> 63 else m for m in parts(radius)]
    meet = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("__m")).select("fp", "rep", "__m.part", "__m.key")
    counts = meet.groupBy("part", "key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    meet = meet.join(counts, ["part", "key"])
    cut = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), cut).cast("int")
    meet = meet.select("fp", "rep", "part", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
    meet = meet.select("fp", "rep", "own", "part", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    group = ["part", "key", "lo", "hi"]
    dealt = meet.repartition(parallelism(spark), *group).sortWithinPartitions(*group)

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None and len(held) else pdf
            if not len(pdf):
                continue
            k = pdf[group].to_numpy()
            change = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
            edges = np.concatenate([[0], change])
            held = pdf.iloc[edges[-1] :]  # the last group may go on
            yield from work(pdf, edges)
        if held is not None and len(held):
            yield from work(held.reset_index(drop=True), np.array([0, len(held)]))

    def work(pdf, edges):
        fp, rep, own = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["own"].to_numpy()
        lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        out_a, out_b = [], []
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]  # most groups: compared together
        if len(two):
            ok = within(fp[two], fp[two + 1], radius)
            out_a.append(rep[two[ok]])
            out_b.append(rep[two[ok] + 1])
        for s, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            f, r = fp[s : s + n], rep[s : s + n]
            if lo[s] == hi[s]:
                i, j = near(f, f, radius)
            else:
                left, right = np.nonzero(own[s : s + n] == lo[s])[0], np.nonzero(own[s : s + n] == hi[s])[0]
                if not len(left) or not len(right):
                    continue
                i, j = near(f[left], f[right], radius)
                i, j = left[i], right[j]
            a, b = forest(n, i, j)
            out_a.append(r[a])
            out_b.append(r[b])
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return dealt.mapInPandas(compare, "a long, b long")


SCHEMA = "fp long"


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    ship(docs.sparkSession)
    udf = per_text(lambda: lambda texts: {"fp": fingerprints(texts, words).view(np.int64)}, SCHEMA)
    prints = materialize(docs.select(F.col(id_col).alias("__id"), udf(F.coalesce(F.col(text_col), F.lit(""))).alias("__r")).select("__id", F.col("__r.fp").alias("fp")))
    classes = materialize(prints.groupBy("fp").agg(F.min("__id").alias("least")))
    # Links run between fingerprints; a fingerprint names its class.
    found = components(links(classes.select("fp", F.col("fp").alias("rep")), radius))
    member = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(tops, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints["fp"] == named["__fp"]).select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
