"""SimHash near dedup of documents: 5-word shingles, Jaccard similarity of 0.8 or more.

The dealt bit-sliced comparison of `simhash`, with a radius wide enough for this
similarity, between documents that can have it at all:

1. A document is the set of 64-bit hashes of its word shingles, mixed from those of the words;
   equal sets are one class, named by a digest, with the SimHash fingerprint of the set.
2. Candidates come from a prefix filter that misses no pair: of n shingles in any common
   order, the first n - ceil(0.8 n) + 1 of both texts have one in common. The order is by
   hash, with shingles that are frequent in a bounded sample last; the sample decides speed
   only. Classes meet under the shingles of their prefixes.
3. In a meeting, fingerprints are compared in bit planes with carry-save counters. Two sets
   of similarity 0.8 differ in 10 bits of 64 on average (12 for the smallest sets); RADIUS
   lies four to five standard deviations above, and leaves out 97% of unlike pairs. This
   is the only step that could lose a link, with a chance of about 1e-6 at the very limit
   of the similarity (1e-4 for sets of under ten shingles), less above it.
4. Pairs that pass are verified on their whole sets, unless counts of their hashes in BINS bins
   already differ by more than such sets can. First every class is compared with the
   head of each meeting and with all others in it, and verified with its nearest of either
   kind; then once more with its nearest of another component. So large groups of near
   copies fall together by two pairs a class. Then all pairs of different components that
   are left are compared, in blocks. Links inside a component are not needed.

One row of each component stays: that with the smallest id (nulls last), of several such
the one with the smallest digest of its text, and one of rows equal in both.

Defined cases: null and empty texts have no shingles and are copies of each other; texts
of fewer words than a shingle are one shingle; rows with null ids stay where their
component has no other id; repeated ids with different texts are rows of their own; very
long texts are read whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import materialize, parallelism, release, ship

from .common import digest_of, give_back, only_rows, per_text, slight, text
from .components import FEW, components
from .simhash import majority, near, within

WORDS = 5
#: Similarity as a fraction of whole numbers.
NUM, DEN = 4, 5
RADIUS = 24
BLOCK = 2048
BINS = 256
#: Meetings up to this size are compared together, pair by pair; larger ones each by itself.
TOGETHER = 32

#: An odd multiplier, its inverse modulo 2^64, and a number for every byte.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], dtype=np.uint64)
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of base modulo 2^64, kept for texts of usual length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word: the difference of a running polynomial over all bytes at its ends, brought to one exponent."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_GAP[b], [False]])
    ends = np.nonzero(inside[1:] != inside[:-1])[0]
    start, end = ends[::2], ends[1::2]
    running = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=running[1:])
    return (running[end] - running[start]) * _power(_BACK, len(b) + 1)[start] ^ (end - start).astype(np.uint64)


def shingles(t: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, each mixed from its words' hashes in order; fewer words are one shingle."""
    one = word_hashes(t.encode("utf-8", "surrogatepass").lower())
    if not len(one):
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(one) - words + 1)
    h = np.full(n, min(len(one), words), dtype=np.uint64)
    for k in range(min(len(one), words)):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += one[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def node_of(h: np.ndarray) -> int:
    """Digest of a set, which names its class."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def prefixes(texts: list[str], hot: np.ndarray, words: int) -> dict:
    """Digest, size, fingerprint, prefix and counts in bins of each text's set."""
    out: dict[str, list] = {"node": [], "n": [], "fp": [], "keys": [], "bins": []}
    for t in texts:
        h = shingles(t, words)
        n = len(h)
        order = h
        if len(hot) and n:
            often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
            order = np.concatenate([h[~often], h[often]])
        take = n - -(-NUM * n // DEN) + 1 if n else 0
        out["node"].append(node_of(h))
        out["n"].append(n)
        out["fp"].append(majority(h).view(np.int64))
        out["keys"].append(order[:take].view(np.int64))
        out["bins"].append(np.minimum(np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
    return out


def frequent(docs: DataFrame, text_col: str, id_col: str, words: int, sample: int = 5000, least: int = 10, most: int = 100_000) -> np.ndarray:
    """Sorted hashes of shingles held by `least` or more of about `sample` texts of least hash of the id."""
    udf = per_text(lambda: lambda texts: {"keys": [shingles(t, words).view(np.int64) for t in texts]}, "keys array<long>")
    rank = F.xxhash64(id_col, F.length(text_col))
    top = [r[0] for r in docs.select(rank.alias("__h")).orderBy("__h").limit(sample).collect()]
    if not top:
        return np.zeros(0, dtype=np.uint64)
    some = docs.where(rank <= top[-1]).select(F.explode(udf(text(text_col))["keys"]).alias("key"))
    rows = some.groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(most).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def alike_in_size(a, b):
    """Only sets of these sizes can have the similarity."""
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def longer(batches, rows: int = 10_000):
    """The batches joined to frames of at least so many rows: few long steps are cheaper, and rows without texts are slim."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def by_group(names: list[str], work):
    """Feed whole groups of sorted rows to work(pdf, edges); a batch may end inside a group."""

    def run(batches):
        held: list[pd.DataFrame] = []
        last = None
        for pdf in longer(batches):
            if not len(pdf):
                continue
            k = pdf[names].to_numpy()
            change = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
            if last is not None and (k[0] != last).any():
                yield from _whole(held, work, names)
                held = []
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from _whole([*held, pdf.iloc[:cut]], work, names)
                held = []
            held.append(pdf.iloc[cut:])
            last = k[-1]
        if held:
            yield from _whole(held, work, names)
        give_back()

    return run


def _whole(frames: list[pd.DataFrame], work, names: list[str]):
    pdf = pd.concat(frames, ignore_index=True)
    k = pdf[names].to_numpy()
    yield from work(pdf, np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1, [len(pdf)]]))


def bounded(bins, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Flags of pairs of rows: their bins leave the similarity possible. Rows without bins pass."""
    ok = np.ones(len(i), dtype=bool)
    if not len(i) or any(b is None for b in bins):
        return ok
    counts = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS).astype(np.int16)
    for s in range(0, len(i), 10_000):
        x, y = i[s : s + 10_000], j[s : s + 10_000]
        ok[s : s + 10_000] = np.abs(counts[x] - counts[y]).sum(1, dtype=np.int64) * (NUM + DEN) <= (n[x].astype(np.int64) + n[y]) * (DEN - NUM)
    return ok


def little_pairs(edges: np.ndarray, little: np.ndarray):
    """Index pairs of all rows of the meetings flagged, a slice of them at a time; no row twice on one side of a slice."""
    size = np.diff(edges)
    end = np.where(np.repeat(little, size), np.repeat(edges[1:], size), 0)
    at = np.arange(edges[-1])
    for d in range(1, int(size[little].max(initial=0))):
        i = at[at + d < end]
        for s in range(0, len(i), 500_000):
            yield i[s : s + 500_000], i[s : s + 500_000] + d


def nearest_pairs(radius: int, heads: bool):
    """Each class with the nearest one of another component in its meeting, within the radius; heads: also with the meeting's head.

    Rows b, a, d, and kind: 0 for the nearest, 1 for the head.
    """

    def work(pdf, edges):
        node, n, root, fp = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["root"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        best, arg = np.full(len(pdf), 255, dtype=np.int64), np.full(len(pdf), -1, dtype=np.int64)
        size = np.diff(edges)
        little = size <= TOGETHER

        def alike(i, j):
            ok = alike_in_size(n[i], n[j]) & (root[i] != root[j])
            return i[ok], j[ok]

        for i, j in little_pairs(edges, little):
            i, j = alike(i, j)
            ok = within(fp[i], fp[j], radius)
            i, j = i[ok], j[ok]
            d = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
            for x, y in ((i, j), (j, i)):
                better = d < best[x]
                best[x[better]], arg[x[better]] = d[better], y[better]
        for s, e in zip(edges[:-1][~little].tolist(), edges[1:][~little].tolist(), strict=True):
            i, j = near(fp[s:e], fp[s:e], radius)
            i, j = alike(i + s, j + s)
            ok = bounded(pdf["bins"].iloc[s:e], i - s, j - s, n[s:e])
            i, j = i[ok], j[ok]
            d = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.append(True, i[1:] != i[:-1]) if len(i) else np.zeros(0, bool)
            best[i[first]], arg[i[first]] = d[first], j[first]
        k = np.nonzero(arg >= 0)[0]
        out = [(node[k], node[arg[k]], best[k], np.zeros(len(k), dtype=np.int32))]
        if heads:
            head = np.repeat(edges[:-1], size)
            i, j = alike(np.arange(len(pdf)), head)
            ok = within(fp[i], fp[j], radius)
            i, j = i[ok], j[ok]
            out.append((node[i], node[j], np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64), np.ones(len(i), dtype=np.int32)))
        b, a, d, kind = (np.concatenate(c) for c in zip(*out, strict=True))
        if len(b):
            yield pd.DataFrame({"b": b, "a": a, "d": d.astype(np.int32), "kind": kind}).drop_duplicates()

    return work


def cross_pairs(radius: int):
    """All pairs of a meeting, or of two of its blocks, within the radius and of different components."""

    def work(pdf, edges):
        node, n, root = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["root"].to_numpy()
        fp, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()

        def listed(i, j):
            return pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])}).drop_duplicates()

        little = (np.diff(edges) <= TOGETHER) & (lo[edges[:-1]] == hi[edges[:-1]])
        for i, j in little_pairs(edges, little):
            ok = (root[i] != root[j]) & alike_in_size(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = within(fp[i], fp[j], radius)
            if ok.any():
                yield listed(i[ok], j[ok])
        for s, e in zip(edges[:-1][~little].tolist(), edges[1:][~little].tolist(), strict=True):
            if (root[s:e] == root[s]).all():
                continue
            if lo[s] == hi[s]:
                left = right = np.arange(s, e)
            else:
                left, right = s + np.nonzero(own[s:e] == lo[s])[0], s + np.nonzero(own[s:e] == hi[s])[0]
            i, j = near(fp[left], fp[right], radius)
            i, j = left[i], right[j]
            ok = (root[i] != root[j]) & alike_in_size(n[i], n[j])
            if lo[s] == hi[s]:
                ok &= i < j
            i, j = i[ok], j[ok]
            ok = bounded(pdf["bins"].iloc[s:e], i - s, j - s, n[s:e])
            if ok.any():
                yield listed(i[ok], j[ok])

    return work


def may_link(m: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """False only where the similarity is surely less: sets differ in a ninth of their sizes at most, and bins bound how much they do."""
    out = []
    for s in range(0, len(a), 2000):
        x, y = (np.frombuffer(b"".join(c.iloc[s : s + 2000]), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (a, b))
        out.append(np.abs(x - y).sum(1, dtype=np.int64))
    apart = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return pd.Series(apart * (NUM + DEN) <= (m.to_numpy(np.int64) + n.to_numpy(np.int64)) * (DEN - NUM))


def verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have the similarity. Only texts of candidates are read again."""
    slim = prints.select("node", "n", "bins").dropDuplicates(["node"])
    left, right = (slim.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"bins{c}")) for c in ("a", "b"))
    pairs = materialize(pairs.select("a", "b").join(left, "a").join(right, "b").where(F.pandas_udf(may_link, "boolean")("na", "nb", "binsa", "binsb")).select("a", "b"))
    nodes = slight(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    one = prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__hash")).alias("__one"))
    one = slight(one.select("node", F.col("__one.__id").alias("__one"), F.col("__one.__hash").alias("__with")))
    rows = docs.select(F.col(id_col).alias("__id"), text(text_col).alias("__text"))
    rows = rows.join(one, rows["__id"].eqNullSafe(one["__one"]) & (digest_of(F.col("__text")) == one["__with"])).select("node", "__text")
    texts = materialize(rows.dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("__text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("__text").alias("t")), "b")

    @F.pandas_udf("boolean")
    def similar(s: pd.Series, t: pd.Series) -> pd.Series:
        out: list[bool] = []
        for x, y in zip(s, t, strict=True):
            x, y = shingles(x, words), shingles(y, words)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared * (NUM + DEN) >= (len(x) + len(y)) * NUM)
        del s, t
        give_back()
        return pd.Series(out, dtype=bool)

    return materialize(both.where(similar("s", "t")).select("a", "b"))


def fingerprinted(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """A slim row per row of docs (__id, __hash, node, n, bins), and a row per class and shingle of its prefix (node, n, fp, key)."""
    hot = frequent(docs, text_col, id_col, words)
    udf = per_text(lambda: lambda texts: prefixes(texts, hot, words), "node long, n int, fp long, keys array<long>, bins binary")
    wide = materialize(docs.select(F.col(id_col).alias("__id"), digest_of(text(text_col)).alias("__hash"), udf(text(text_col)).alias("__r")).select("__id", "__hash", "__r.*"))
    classes = wide.select("node", "n", "fp", "keys").dropDuplicates(["node"])
    spread = materialize(classes.select("node", "n", "fp", F.explode("keys").alias("key")))
    # The prefixes are most of the wide rows' bytes, and done with.
    return materialize(wide.drop("fp", "keys")), spread


def meetings(prints: DataFrame, spread: DataFrame, cut: Column) -> DataFrame:
    """The rows of spread whose key has several classes, with its size and the row's own block of cut."""
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    meet = materialize(spread.join(counts, "key").select("key", "node", "n", "fp", "size"))
    dealt = meet.withColumn("own", F.pmod(F.xxhash64("node"), cut).cast("int"))
    # Only rows of larger meetings carry their bins: there they keep the pairs few, elsewhere pairs are.
    bins = prints.select(F.col("node").alias("__of"), "bins").dropDuplicates(["__of"])
    large = dealt.where(F.col("size") > TOGETHER).join(bins, F.col("node") == F.col("__of")).drop("__of")
    return materialize(dealt.where(F.col("size") <= TOGETHER).withColumn("bins", F.lit(None).cast("binary")).unionByName(large))


def classes_of(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: __id, __hash (of its text), root (the component's name)."""
    spark = docs.sparkSession
    ship(spark)
    prints, spread = fingerprinted(docs, id_col, text_col, words)
    release(spark)
    cut = F.ceil(F.col("size") / F.lit(block)).cast("int")
    dealt = meetings(prints, spread, cut)
    del spread
    release(spark)
    sorted_by = lambda df, *by: df.repartition(parallelism(spark), *by).sortWithinPartitions(*by, "n", "node")

    def joined_to(found: DataFrame | None) -> DataFrame:
        """dealt with each class's component so far."""
        if found is None:
            return dealt.withColumn("root", F.col("node"))
        met = dealt.join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
        return met.withColumn("root", F.coalesce("root", "node")).drop("__node")

    def nearest(rows: DataFrame, heads: bool) -> DataFrame:
        """One pair of each class with its nearest of another component, and one with a head."""
        several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        rows = rows.join(several, "key").select("key", "own", "node", "n", "fp", "root", "bins")
        picked = sorted_by(rows, "key", "own").mapInPandas(by_group(["key", "own"], nearest_pairs(radius, heads)), "b long, a long, d int, kind int")
        one = picked.groupBy("b", "kind").agg(F.min(F.struct("d", "a")).alias("x"))
        return one.select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b")).distinct()

    heads = dealt.where(F.col("size") > block).groupBy("key", "own").agg(F.min(F.struct("node", "n", "fp")).alias("x"))
    hubs = heads.groupBy("key").agg(F.min("x").alias("y"))
    apart = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    between = heads.join(hubs, "key").where((F.col("x.node") != F.col("y.node")) & (apart <= radius)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    links = verified(nearest(joined_to(None), True).unionByName(between).distinct(), prints, docs, id_col, text_col, words)
    found = components(links, FEW)
    release(spark)
    second = verified(nearest(joined_to(found), False), prints, docs, id_col, text_col, words)
    if not second.isEmpty():
        links = links.unionByName(second)
        found = components(links, FEW)
    release(spark)

    rows = materialize(joined_to(found).select("key", "node", "n", "fp", "root", "own", "size", "bins"))
    several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = rows.join(several, "key").select("key", "node", "n", "fp", "root", "own", "bins", F.explode(F.sequence(F.lit(0), cut - 1)).alias("other"))
    left = left.select("key", "node", "n", "fp", "root", "own", "bins", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    more = sorted_by(left, "key", "lo", "hi").mapInPandas(by_group(["key", "lo", "hi"], cross_pairs(radius)), "a long, b long").distinct()
    more = verified(more, prints, docs, id_col, text_col, words)
    release(spark)
    if not more.isEmpty():
        found = components(links.unionByName(more), FEW)
    found = found.withColumnRenamed("node", "__node")
    return prints.join(found, F.col("node") == F.col("__node"), "left").select("__id", "__hash", F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id and component_id, the smallest id reachable over links."""
    member = materialize(classes_of(docs, id_col, text_col, words, radius, block))
    tops = member.groupBy("root").agg(F.min("__id").alias("component_id"))
    return member.join(tops, "root").select(F.col("__id").alias(id_col), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component; all columns stay."""
    member = materialize(classes_of(docs, id_col, text_col, words, radius, block))
    release(docs.sparkSession)
    first = member.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")).alias("top"))
    named = member.groupBy("root", "__id", "__hash").agg(F.count(F.lit(1)).alias("times")).join(first, "root")
    stays = F.col("__id").eqNullSafe(F.col("top.__id")) & (F.col("__hash") == F.col("top.__hash"))
    named = named.select("__id", F.col("__hash").alias("__key"), "times", stays.alias("stays")).where("not stays or times > 1")
    return only_rows(docs, named, id_col, digest_of(text(text_col)))
