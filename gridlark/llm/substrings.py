"""Suffix-array dedup: bytes of 50-byte strings that an earlier document also holds.

Texts are packed into batches of whole documents, written once to the shared folder;
everything after that works on batches, and results come back to them by number.

1. Anchors. Each 50-byte window picks the 24-byte gram of least hash in it, so equal
   windows pick equal grams. Runs of windows with one gram are grouped into blocks, cut
   where the gram's hash says so. A block that a smaller document also holds (equal
   128-bit digest of all its bytes) is settled as a whole: copies and near copies go here.
   Runs are then split by the side on which their windows reach SIDE bytes beyond the gram,
   and known by the hash of the gram with those bytes.
2. Candidates. A window's first occurrence never lies in a settled block, so settled blocks
   are left aside on both sides. Of the other runs, only those whose gram occurs there in
   more than one document can lead to a match: a small part of the text.
3. Suffix arrays. These runs' bytes are dealt by gram to shards. Each shard sorts its
   suffixes by Larsson-Sadakane refinement (groups of equal prefixes, ranked by the rank
   of what follows, prefix length doubling), takes common prefixes by Kasai's recurrence
   in many lanes at once, and finds, for each group of suffixes that agree on 50 bytes,
   the smallest document. A gram with too many bytes for one array is cut into several
   shards whose sorted windows are merged by binary search.
4. Windows found are covered on the batches' bytes.

Nothing is sampled or capped: grams and digests only leave out what cannot match.

Defined cases: null and empty texts have 0 bytes; a null id counts as larger than any
other; rows with one id never match each other; ids that are no whole numbers are an
error; very long texts are a batch of their own; an empty table gives an empty result;
only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.runtime import materialize, parallelism, ship

from .common import give_back

WIDTH = 50  # bytes of a window
GRAM = 24  # bytes of a gram; a window holds WIDTH - GRAM + 1 of them
SIDE = (WIDTH - GRAM) // 2  # bytes that every window has on one side of its gram at least
CUT = 16  # one gram in CUT starts a block
BATCH = 1_000_000  # bytes of a batch, but for longer documents
SHARD = 2_000_000  # bytes of one suffix array
LAST = np.int64(2**63 - 1)
_HI, _LO = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _expand(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


# ---- batches


def pack(docs: DataFrame, id_col: str, text_col: str, batch: int = BATCH) -> DataFrame:
    """Whole documents in batches: bid, ids (null flags apart), sizes and bytes, compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes] = []
        n = size = 0

        def out() -> pd.DataFrame:
            null = np.array([i is None for i in ids])
            one = {
                "bid": (part << 32) + n,
                "ids": _squeeze(np.array([0 if i is None else i for i in ids], dtype=np.int64)),
                "nulls": np.packbits(null).tobytes(),
                "sizes": _squeeze(np.array(list(map(len, texts)), dtype=np.int64)),
                "bytes": zstandard.ZstdCompressor(level=3).compress(b"".join(texts)),
            }
            return pd.DataFrame([one])

        for pdf in frames:
            for i, t in zip(pdf["i"].astype(object), pdf["t"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
                size += len(texts[-1])
                if size >= batch or len(ids) >= 20_000:
                    yield out()
                    ids, texts, n, size = [], [], n + 1, 0
        if ids:
            yield out()

    # ids travel as text, since nulls would turn them into floats
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, "bid long, ids binary, nulls binary, sizes binary, bytes binary")


class Batch:
    """A batch opened: bytes, documents, and the runs and blocks of its windows."""

    def __init__(self, ids: bytes, nulls: bytes, sizes: bytes, data: bytes):
        self.ids = _expand(ids, np.int64)
        self.sizes = _expand(sizes, np.int64)
        self.null = np.unpackbits(np.frombuffer(nulls, np.uint8))[: len(self.ids)].astype(bool)
        self.order = np.where(self.null, LAST, self.ids)
        self.raw = zstandard.ZstdDecompressor().decompress(data) if self.sizes.sum() else b""
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def analyse(self) -> None:
        n = len(self.buf)
        none = np.zeros(0, dtype=np.int64)
        self.p0 = self.p1 = self.doc = self.block = self.q0 = self.q1 = self.block_doc = none
        self.gram = np.zeros(0, dtype=np.uint64)
        if n < WIDTH:
            return
        word = np.ndarray((n - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        h = word[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += word[8 : n - GRAM + 9]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += word[16 : n - GRAM + 17]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least = (h & _HI) | np.arange(len(h), dtype=np.uint64)
        span, need = 1, WIDTH - GRAM + 1
        while span * 2 <= need:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < need:
            least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
        anchor = (least & _LO).astype(np.int64)
        edge = np.zeros(n + 1, dtype=np.int8)
        wide = self.sizes >= WIDTH
        np.add.at(edge, self.starts[wide], 1)
        np.add.at(edge, (self.starts + self.sizes)[wide] - WIDTH + 1, -1)
        valid = np.cumsum(edge, dtype=np.int8)[: n - WIDTH + 1] > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        last = np.ones(len(anchor), bool)
        last[:-1] = new[1:] | ~valid[1:]
        self.p0 = np.nonzero(new & valid)[0]
        self.p1 = np.nonzero(last & valid)[0]
        if not len(self.p0):
            return
        at = anchor[self.p0]
        cut = h[at]
        cut = ((cut ^ (cut >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(33)
        # A window reaches at least SIDE bytes beyond its gram on one side: runs are split by that side.
        left, right = self.p0 <= at - SIDE, self.p1 > at - SIDE
        n_of = left.astype(np.int64) + right
        run = np.repeat(np.arange(len(at)), n_of)
        second = np.append(False, run[1:] == run[:-1])
        is_left = left[run] & ~second
        p0, p1, at = self.p0[run], self.p1[run], at[run]
        self.p0 = np.where(is_left, p0, np.maximum(p0, at - SIDE + 1))
        self.p1 = np.where(is_left, np.minimum(p1, at - SIDE), p1)
        self.doc = np.searchsorted(self.starts, self.p0, "right") - 1
        s = np.where(is_left, at - SIDE, at)
        g = np.where(is_left, np.uint64(1), np.uint64(2))
        for k in (0, 8, 16, 24, GRAM + SIDE - 8):
            g = (g ^ word[s + k]) * np.uint64(0xFF51AFD7ED558CCD)
            g ^= g >> np.uint64(32)
        self.gram = g
        first = ((cut[run] % np.uint64(CUT)) == 0) & ~second
        first[0] = True
        first[1:] |= self.doc[1:] != self.doc[:-1]
        self.block = np.cumsum(first) - 1
        s = np.nonzero(first)[0]
        self.q0 = self.p0[s]
        self.q1 = self.p1[np.append(s[1:], len(self.p0)) - 1]
        self.block_doc = self.doc[s]

    def digests(self) -> np.ndarray:
        """128-bit digests of the blocks' bytes, as [blocks, 2]."""
        view = memoryview(self.raw)
        out = b"".join(xxhash.xxh3_128_digest(view[a : b + WIDTH]) for a, b in zip(self.q0.tolist(), self.q1.tolist(), strict=True))
        return np.frombuffer(out, dtype="<u8").reshape(-1, 2)


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    return frame.itertuples(index=False, name=None)


_BLOCK = np.dtype([("a", "<u8"), ("b", "<u8"), ("order", "<i8"), ("i", "<u4")])


def block_keys(batches: DataFrame, shards: int) -> DataFrame:
    """Kind 1: what each batch asks each shard, its blocks' digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for bid, *cols in _rows(pdf):
                b = Batch(*cols)
                b.analyse()
                d = b.digests()
                rec = np.zeros(len(d), dtype=_BLOCK)
                rec["a"], rec["b"], rec["order"], rec["i"] = d[:, 0], d[:, 1], b.order[b.block_doc], np.arange(len(d))
                to = (rec["a"] >> np.uint64(20)) % np.uint64(shards)
                out = [(1, r, bid, _squeeze(rec[rows])) for r, rows in _split(to, shards)]
                if out:
                    yield pd.DataFrame(out, columns=["kind", "r", "bid", "load"])

    return batches.mapInPandas(run, "kind int, r int, bid long, load binary")


def gram_keys(batches: DataFrame, settled: DataFrame, shards: int) -> DataFrame:
    """Kind 2: what each batch asks each shard, the grams of runs outside settled blocks, with a flag where two of its documents hold one."""

    def run(bid: int, own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame | None:
        b = _opened(own)
        b.analyse()
        left = ~_settled(b, rest)[b.block]
        g, order_of = b.gram[left], b.order[b.doc[left]]
        if not len(g):
            return None
        order = np.argsort(g, kind="stable")
        g, order_of = g[order], order_of[order]
        at = np.nonzero(np.append(True, g[1:] != g[:-1]))[0]
        many = np.minimum.reduceat(order_of, at) != np.maximum.reduceat(order_of, at)
        g = g[at]
        out = []
        for r, rows in _split((g >> np.uint64(32)) % np.uint64(shards), shards):
            low = (g[rows] & _LO).astype(np.uint32)
            by = np.argsort(low, kind="stable")
            low, flag = low[by], many[rows][by]
            step = np.diff(low, prepend=np.uint32(0)).astype("<u4")
            out.append((2, r, bid, _squeeze(step.view(np.uint8).reshape(-1, 4).T.copy()) + np.packbits(flag).tobytes() + len(low).to_bytes(8, "little")))
        return pd.DataFrame(out, columns=["kind", "r", "bid", "load"])

    return _with_batches(batches, settled, run, "kind int, r int, bid long, load binary")


def _grams(load: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(load[-8:], "little")
    flags = load[len(load) - 8 - -(-n // 8) : -8]
    step = _expand(load[: len(load) - 8 - len(flags)], np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]
    return np.cumsum(step, dtype=np.uint32), np.unpackbits(np.frombuffer(flags, np.uint8))[:n].astype(bool)


def _split(to: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, row numbers) for each shard that has rows."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1, dtype=to.dtype))
    for r in range(shards):
        if cuts[r] < cuts[r + 1]:
            yield r, order[cuts[r] : cuts[r + 1]]


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups of sorted frames."""
    held: list[pd.DataFrame] = []
    key = None
    for pdf in frames:
        if not len(pdf):
            continue
        k = pdf[by].to_numpy()
        edges = [0, *(np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1).tolist(), len(pdf)]
        for s, e in zip(edges, edges[1:], strict=False):
            if held and tuple(k[s]) != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            key = tuple(k[s])
            held.append(pdf.iloc[s:e])
    if held:
        yield pd.concat(held, ignore_index=True)


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """Per batch and shard: numbers of settled blocks (kind 1), grams that occur elsewhere (kind 2)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["kind", "r"]):
            out = []
            kind, r = int(group["kind"].iloc[0]), int(group["r"].iloc[0])
            bids = group["bid"].tolist()
            if kind == 1:
                parts = [_expand(x, _BLOCK) for x in group["load"]]
                rec = np.concatenate(parts)
                source = np.repeat(np.arange(len(parts)), list(map(len, parts)))
                order = np.lexsort((rec["b"], rec["a"]))
                a, b = rec["a"][order], rec["b"][order]
                at = np.nonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[0]
                least = np.minimum.reduceat(rec["order"][order], at)
                hit = np.zeros(len(rec), bool)
                hit[order] = rec["order"][order] > np.repeat(least, np.diff(np.append(at, len(rec))))
                value = rec["i"]
            else:
                parts, flags = zip(*map(_grams, group["load"]), strict=True)
                value = np.concatenate(parts)
                source = np.repeat(np.arange(len(parts)), list(map(len, parts)))
                order = np.argsort(value, kind="stable")
                v = value[order]
                at = np.nonzero(np.append(True, v[1:] != v[:-1]))[0]
                size = np.diff(np.append(at, len(v)))
                many = np.maximum.reduceat(np.concatenate(flags)[order].astype(np.int8), at) > 0
                hit = np.zeros(len(v), bool)
                hit[order] = np.repeat((size > 1) | many, size)
            value, cuts = value[hit], np.searchsorted(source[hit], np.arange(len(bids) + 1))  # source ascends
            out = [(bid, kind, r, _squeeze(value[a:e])) for bid, a, e in zip(bids, cuts, cuts[1:], strict=False) if e > a]
            if out:
                yield pd.DataFrame(out, columns=["bid", "kind", "r", "load"])

    dealt = asked.repartition(shards, "kind", "r").sortWithinPartitions("kind", "r")
    return dealt.mapInPandas(run, "bid long, kind int, r int, load binary")


# ---- segments and suffix arrays

_SEGMENT = np.dtype([("gram", "<u8"), ("order", "<i8"), ("p", "<i8"), ("size", "<i4")])


def _with_batches(batches: DataFrame, load: DataFrame, fn, schema: str) -> DataFrame:
    """fn on each batch with what belongs to it. batches lie by bid already, and are not moved again."""

    def run(own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        out = fn(int(own["bid"].iloc[0]), own, rest) if len(own) else None
        return pd.DataFrame({c.strip().split(" ")[0]: [] for c in schema.split(",")}) if out is None else out

    return batches.groupBy("bid").cogroup(load.select("bid", "kind", "r", "load").groupBy("bid")).applyInPandas(run, schema)


def _opened(own: pd.DataFrame) -> Batch:
    one = own.iloc[0]
    return Batch(one["ids"], one["nulls"], one["sizes"], one["bytes"])


def _settled(b: Batch, rest: pd.DataFrame) -> np.ndarray:
    """Flags of the batch's blocks that a smaller document also holds."""
    out = np.zeros(len(b.q0), bool)
    for load in rest.loc[rest["kind"] == 1, "load"]:
        out[_expand(load, np.uint32)] = True
    return out


def segments(batches: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """Bytes of the candidate runs, by shard of their gram."""

    def run(bid: int, own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame | None:
        grams = rest[rest["kind"] == 2]
        if not len(grams):
            return None
        b = _opened(own)
        b.analyse()
        shared = np.sort(np.concatenate([_expand(x, np.uint32).astype(np.uint64) | (np.uint64(r) << np.uint64(32)) for r, x in zip(grams["r"], grams["load"], strict=True)]))
        to = (b.gram >> np.uint64(32)) % np.uint64(shards)
        mine = (to << np.uint64(32)) | (b.gram & _LO)
        at = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
        k = np.nonzero((shared[at] == mine) & ~_settled(b, rest)[b.block])[0]
        rec = np.zeros(len(k), dtype=_SEGMENT)
        rec["gram"], rec["order"], rec["p"], rec["size"] = b.gram[k], b.order[b.doc[k]], b.p0[k], b.p1[k] - b.p0[k] + WIDTH
        out = []
        for r, rows in _split(to[k], shards):
            data = b"".join(b.raw[p : p + n] for p, n in zip(rec["p"][rows].tolist(), rec["size"][rows].tolist(), strict=True))
            out.append((r, bid, zstandard.ZstdCompressor(level=3).compress(len(rows).to_bytes(8, "little") + rec[rows].tobytes() + data)))
        return pd.DataFrame(out, columns=["r", "bid", "load"])

    return _with_batches(batches, answered, run, "r int, bid long, load binary")


def suffix_array(raw: bytes, depth: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes or more, by Larsson-Sadakane refinement.

    Also each suffix's mark: 0 in its place, 1 first and 2 later in a group that agrees
    on more than `depth` bytes and so is not ordered inside.

    Starts from groups of equal eight bytes. A round orders each group by the rank of
    the suffix one prefix length on and doubles the prefix; groups of one rest.
    """
    n = len(raw)
    padded = raw + b"\0" * 8
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    # From the back, so that suffixes of under eight bytes, which tie with zero bytes, come first and the shorter before the longer.
    sa = n - 1 - np.argsort(key[::-1], kind="stable")
    k = key[sa]
    new = np.append(True, k[1:] != k[:-1])
    short = np.nonzero(sa > n - 8)[0]
    new[short] = True
    new[short[short + 1 < n] + 1] = True
    start = np.nonzero(new)[0]
    group = np.repeat(start, np.diff(np.append(start, n)))  # a group's number is its first place
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = group
    length = 8
    open_ = np.nonzero(~(new & np.append(new[1:], True)))[0]  # places in groups of two or more
    while length < depth and len(open_):
        s = sa[open_]
        g = rank[s]
        nxt = rank[np.minimum(s + length, n)]
        order = np.lexsort((nxt, g))
        s, g, nxt = s[order], g[order], nxt[order]
        sa[open_] = s  # places of a group are adjacent and ascending, so order by group keeps them
        new = np.append(True, (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1]))
        first = np.nonzero(new)[0]
        count = np.diff(np.append(first, len(s)))
        rank[s] = np.repeat(open_[first], count)
        open_ = open_[np.repeat(count > 1, count)]
        length *= 2
    mark = np.zeros(n, dtype=np.int8)
    mark[sa[open_]] = np.where(rank[sa[open_]] == open_, 1, 2)
    return sa, mark


def common_prefixes(raw: bytes, sa: np.ndarray, mark: np.ndarray, most: int = WIDTH, lane: int = 64) -> np.ndarray:
    """Common prefix (up to `most`) of each suffix of the array with the one before it, by Kasai's recurrence.

    In text order a common prefix shrinks by one at most from one suffix to the next.
    That needs the array's order: later suffixes of a group not ordered inside share `most`
    at least with the one before, and the recurrence starts anew behind them and at a
    group's first. The text is cut into lanes that run through it side by side.
    """
    n = len(raw)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.ndarray((n + most + 8,), dtype="<u8", buffer=raw + b"\0" * (most + 16), strides=(1,))
    out = np.zeros(n, dtype=np.int64)
    anew = mark == 1
    anew[1:] |= mark[:-1] == 2
    lanes = np.arange(0, n, lane)
    held = np.zeros(len(lanes), dtype=np.int64)
    for t in range(lane):
        i = lanes + t
        live = i < n
        i, l = i[live], np.maximum(held[live] - 1, 0)
        j = before[i]
        room = np.minimum(most, n - np.maximum(i, j))
        l = np.where((j >= 0) & ~anew[i], np.minimum(l, room), 0)
        l = np.where(mark[i] == 2, most, l)
        todo = np.nonzero((j >= 0) & (l < room))[0]
        while len(todo):
            x = word[i[todo] + l[todo]] ^ word[j[todo] + l[todo]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            l[todo] = np.minimum(l[todo] + same, room[todo])
            todo = todo[(same == 8) & (l[todo] < room[todo])]
        out[i] = l
        held[: len(l)] = l
        held = held[: len(lanes)]
    return out[sa]


def repeated(raw: bytes, seg: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Flags of raw's bytes: a window starts there that a segment of a smaller document also holds.

    seg: the segments of raw in order, _SEGMENT rows sorted by gram. Cut into suffix
    arrays of about `shard` bytes, between grams where that is possible; windows of
    grams that lie on both sides of a cut are merged by binary search.
    """
    ends = np.cumsum(seg["size"].astype(np.int64))
    starts = ends - seg["size"]
    hit = np.zeros(len(raw), bool)
    if not len(seg):
        return hit
    cuts = [0]
    while cuts[-1] < len(seg):
        stop = int(np.searchsorted(ends, starts[cuts[-1]] + shard, "right"))
        stop = max(stop, cuts[-1] + 1)
        if stop < len(seg):
            whole = int(np.searchsorted(seg["gram"], seg["gram"][stop], "left"))  # first segment of the gram being cut
            stop = whole if whole > cuts[-1] else stop
        cuts.append(min(stop, len(seg)))
    torn = {seg["gram"][c] for c in cuts[1:-1] if seg["gram"][c] == seg["gram"][c - 1]}
    parts = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        a, b = int(starts[s]), int(ends[e - 1])
        text = raw[a:b]
        size = seg["size"][s:e].astype(np.int64)
        order = np.repeat(seg["order"][s:e], size)
        room = np.repeat(starts[s:e] - a + size, size) - np.arange(b - a)
        order = np.where(room >= WIDTH, order, LAST)  # windows that leave their segment count for nothing
        sa, mark = suffix_array(text)
        lcp = common_prefixes(text, sa, mark)
        at = np.nonzero(np.append(True, lcp[1:] < WIDTH))[0]
        least = np.minimum.reduceat(order[sa], at)
        count = np.diff(np.append(at, len(sa)))
        own = np.empty(b - a, dtype=np.int64)
        own[sa] = np.repeat(least, count)
        hit[a:b] = (room >= WIDTH) & (own < order)
        if torn:
            inside = np.repeat(np.isin(seg["gram"][s:e], list(torn)), size)
            valid = (room >= WIDTH) & inside
            rep = np.array([k for k in sa.tolist() if valid[k]], dtype=np.int64)  # in suffix order
            parts.append((a, text, rep, order, own))
    # Merge: each part's sorted windows are looked up in every other part's by binary search.
    views = [np.array([t[k : k + WIDTH] + b"\x01" for k in rep.tolist()], dtype=f"S{WIDTH + 1}") for _, t, rep, _, _ in parts]
    for x, (a, _, rep, order, _) in enumerate(parts):
        if not len(rep):
            continue
        for y, (_, _, other, _, own) in enumerate(parts):
            if x != y and len(other):
                at = np.minimum(np.searchsorted(views[y], views[x]), len(other) - 1)
                found = views[y][at] == views[x]
                hit[a + rep[found]] |= own[other[at[found]]] < order[rep[found]]
    return hit


def matches(cut: DataFrame, shards: int, shard: int = SHARD) -> DataFrame:
    """Per batch: starts of windows that a smaller document also holds (kind 3)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, ["r"]):
            segs, texts, source = [], [], []
            for k, load in enumerate(group["load"]):
                raw = zstandard.ZstdDecompressor().decompress(load)
                n = int.from_bytes(raw[:8], "little")
                seg = np.frombuffer(raw[8 : 8 + n * _SEGMENT.itemsize], dtype=_SEGMENT)
                base = 8 + n * _SEGMENT.itemsize
                end = base + np.cumsum(seg["size"].astype(np.int64))
                texts += [raw[e - m : e] for e, m in zip(end.tolist(), seg["size"].tolist(), strict=True)]
                segs.append(seg)
                source += [k] * n
            seg, source = np.concatenate(segs), np.array(source)
            order = np.lexsort((seg["order"], seg["gram"]))
            seg, source = seg[order], source[order]
            # Equal segments go into the arrays once, as the smallest document's; the others follow from it.
            kept: dict[tuple[int, bytes], int] = {}
            grams = seg["gram"].tolist()
            rep = np.array([kept.setdefault((grams[n], texts[k]), n) for n, k in enumerate(order.tolist())], dtype=np.int64)
            one = np.nonzero(rep == np.arange(len(rep)))[0]
            raw = b"".join(texts[k] for k in order[one].tolist())
            del kept, texts
            flags = repeated(raw, seg[one], shard)
            begin = np.zeros(len(seg), dtype=np.int64)
            begin[one] = np.cumsum(seg["size"][one].astype(np.int64)) - seg["size"][one]
            n_windows = seg["size"].astype(np.int64) - WIDTH + 1
            s = np.repeat(np.arange(len(seg)), n_windows)
            offset = np.arange(len(s)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
            hit = flags[begin[rep[s]] + offset] | (seg["order"][rep] < seg["order"])[s]
            s, p = s[hit], (seg["p"][s] + offset)[hit]
            by = np.argsort(source[s], kind="stable")
            p, cuts = p[by], np.searchsorted(source[s][by], np.arange(len(group) + 1))
            r = int(group["r"].iloc[0])
            out = [(bid, 3, r, _squeeze(p[a:e])) for bid, a, e in zip(group["bid"].tolist(), cuts, cuts[1:], strict=False) if e > a]
            if out:
                yield pd.DataFrame(out, columns=["bid", "kind", "r", "load"])
        give_back()

    return cut.repartition(shards, "r").sortWithinPartitions("r").mapInPandas(run, "bid long, kind int, r int, load binary")


# ---- results

SCHEMA = "i string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(b: Batch, rest: pd.DataFrame) -> np.ndarray:
    """Flags of the batch's bytes that lie in a window found."""
    edge = np.zeros(len(b.buf) + 1, dtype=np.int32)
    settled = _settled(b, rest)
    np.add.at(edge, b.q0[settled], 1)
    np.add.at(edge, b.q1[settled] + WIDTH, -1)
    for load in rest.loc[rest["kind"] == 3, "load"]:
        p = _expand(load, np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + WIDTH, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, batch: int = BATCH, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256.

    texts: also kept_text, the remaining bytes (invalid UTF-8 at cuts is left out).
    """
    spark = docs.sparkSession
    ship(spark)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} has to be a whole number, since smaller ids keep what they share with larger ones")
    shards = parallelism(spark)
    batches = materialize(pack(docs, id_col, text_col, batch).repartition(shards, "bid"))
    settled = materialize(answers(block_keys(batches, shards), shards))
    shared = answers(gram_keys(batches, settled, shards), shards)
    found = matches(segments(batches, settled.unionByName(shared), shards), shards, shard)

    def run(bid: int, own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        b = _opened(own)
        gone = np.zeros(len(b.buf), bool)
        if len(rest):
            b.analyse()
            gone = _covered(b, rest)
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        inner = b.starts[b.sizes > 0]
        start[inner] = gone[inner]  # spans never cross documents
        total, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(start))
        ends = b.starts + b.sizes
        removed = total[ends] - total[b.starts]
        kept = [b.raw[s:e] if n == 0 else b.buf[s:e][~gone[s:e]].tobytes() for s, e, n in zip(b.starts.tolist(), ends.tolist(), removed.tolist(), strict=True)]
        out = {
            "i": [None if x else str(i) for i, x in zip(b.ids.tolist(), b.null.tolist(), strict=True)],
            "n_bytes": b.sizes,
            "n_removed": removed,
            "n_spans": spans[ends] - spans[b.starts],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }
        if texts:
            out["kept_text"] = [k.decode("utf-8", "ignore") for k in kept]
        return pd.DataFrame(out)

    result = _with_batches(batches, settled.unionByName(found), run, SCHEMA + ", kept_text string" * texts)
    kind = docs.schema[id_col].dataType
    return result.select(F.col("i").cast(kind).alias(id_col), *[c for c in result.columns if c != "i"])
