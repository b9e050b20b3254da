"""Mixing sources to target weights, by blocks of tokens.

Each source's documents are packed end to end, in a pseudorandom but fixed order, into
one stream of words that is cut into blocks of fixed length. The mix is made of output
shards of a fixed number of slots. Every shard draws its sources' counts from a
multinomial distribution whose weights are the sources' targets. The draws' totals miss
the targets by chance, so they are reconciled: of a source drawn too often, slots picked
by a pseudorandom permutation pass to the sources drawn too seldom, which keeps shards
whole and meets every target to the block. Slot j of a source is mapped to a block by a
pseudorandom permutation of the source's block numbers (swap-or-not rounds, one
permutation for each pass over the source), and slots are joined to blocks by index.

All of it is DataFrame operations. Positions come from prefix sums over two or three
levels of buckets, so no window holds a whole source.

Defined cases: null texts have size 0; a null source is a source of its own, ordered
last; documents without words take none; an empty table gives an empty result;
repeated rows and ids are packed one after the other, as rows of their own; a very long
text reaches into many blocks; only id, text and source are read. Of rows equal in id,
text and source, mixed_documents gives the further columns of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.runtime import materialize, parallelism

from .common import WORD, digest_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 64
ROUNDS = 16
SEED = 1
PER_BUCKET = 512
SHARD = 4096
CELLS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets by source: source, source_size, target. sizes has one row per source (source, source_size).

    Weights repeat over the sources in code point order, null last. The water level
    is found at once: sources ordered by the level at which they reach their cap are
    full up to the first that the level does not fill. One row per source is sorted.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__r", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__r") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", w).withColumn("__full", F.lit(float(cap)) * F.col("source_size"))
    ranked = ranked.withColumn("__at", F.col("__full") / F.col("__w"))
    by = Window.orderBy("__at", "__r")
    everything = Window.orderBy("__at", "__r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    ranked = ranked.withColumn("__level", level)
    water = F.min(F.when(F.col("__at") >= F.col("__level"), F.struct("__at", "__level"))).over(everything)["__level"]
    ranked = ranked.withColumn("__water", water)
    got = F.when(F.col("__water").isNull(), F.col("__full")).otherwise(F.least(F.col("__full"), F.col("__w") * F.col("__water")))
    return ranked.select("source", "source_size", got.alias("target"))


def prf(*parts: Column) -> Column:
    """Pseudorandom non-negative number below 2^62 from integer columns."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def permuted(x: Column, n: Column, source: Column, turn: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Image of x, a number below n, under a pseudorandom permutation that belongs to (source, turn).

    A round pairs each number with key - number (modulo n) and swaps the pair or
    leaves it, as a pseudorandom bit of the pair's larger number says. Rounds are a
    fold, since each uses the last one's result several times.
    """

    def swap(acc: Column, k: Column) -> Column:
        partner = F.pmod(prf(F.lit(seed), k, source, turn) - acc, n)
        bit = F.xxhash64(F.lit(seed), k, source, turn, F.greatest(acc, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, swap)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """Each document's place in its source's stream: __id, __key (its text's digest), source, size, start (first word's number).

    keep names further columns to carry. The order within a source is by hashed
    bucket, then id and text hash; three levels of prefix sums find the places.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__hash"), digest_of(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"), *[F.col(c) for c in keep])
    rows = materialize(rows)  # texts are read once; what follows works on sizes
    n = rows.count()
    fan = max(1, n // PER_BUCKET)
    wide = max(1, fan // PER_BUCKET)
    rows = rows.withColumn("__b", F.pmod("__hash", F.lit(fan))).withColumn("__w", F.floor(F.col("__b") * wide / fan).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    buckets = rows.groupBy("source", "__w", "__b").agg(F.sum("size").alias("__sum"))
    wides = buckets.groupBy("source", "__w").agg(F.sum("__sum").alias("__sum"))
    wides = wides.select("source", "__w", zero(F.sum("__sum").over(upto(Window.partitionBy("source").orderBy("__w")))).alias("__w0"))
    buckets = buckets.join(wides, buckets["source"].eqNullSafe(wides["source"]) & (buckets["__w"] == wides["__w"])).select(
        buckets["source"], buckets["__w"], "__b", (F.col("__w0") + zero(F.sum("__sum").over(upto(Window.partitionBy(buckets["source"], buckets["__w"]).orderBy("__b"))))).alias("__b0")
    )
    within = Window.partitionBy("source", "__b").orderBy("__hash", "__id", "__key")
    placed = rows.withColumn("__in", zero(F.sum("size").over(upto(within))))
    return placed.join(buckets.drop("__w"), placed["source"].eqNullSafe(buckets["source"]) & (placed["__b"] == buckets["__b"])).select(placed["__id"], placed["__key"], placed["source"], placed["size"], (F.col("__in") + F.col("__b0")).alias("start"), *[placed[c] for c in keep])


def plan(sizes: DataFrame, block: int = BLOCK, **rules) -> DataFrame:
    """Block slots by source: sid (its place in order), source, source_size, target, n_blocks, n_slots.

    Slots are the target in blocks of the source's mean fill; at most `cap` passes, as targets are capped.
    """
    t = targets(sizes, **rules)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return t.select(sid.alias("sid"), "source", "source_size", "target", blocks.alias("n_blocks"), slots.alias("n_slots"))


def intervals(rows: DataFrame, size: str, cells: int = CELLS) -> DataFrame:
    """Sources laid end to end by `size`: sid, lo, hi, and every cell (of whole width __width) that [lo, hi) touches."""
    before = F.sum(size).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))
    laid = rows.where(F.col(size) > 0).withColumn("lo", F.coalesce(before, F.lit(0)).cast("long"))
    laid = laid.withColumn("hi", (F.col("lo") + F.col(size)).cast("long"))
    width = F.greatest(F.lit(1), F.ceil(F.max("hi").over(Window.partitionBy()) / F.lit(cells))).cast("long")
    laid = laid.withColumn("__width", width)
    div = lambda c: F.floor(c / F.col("__width")).cast("long")
    return laid.select("sid", "lo", "hi", "__width", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1))).alias("__cell"))


def shard_counts(planned: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The multinomial draw: shard, sid, count. Shards have `shard` slots, the last one the rest.

    A slot's draw is a pseudorandom place among all slots of the targets, looked up in
    the sources' intervals; counts are added up before they are shuffled.
    """
    total = planned.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("__all"))
    shards = total.where("__all > 0").select("__all", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__all") - 1) / shard))).alias("shard"))
    shards = shards.repartition(parallelism(planned.sparkSession), "shard")
    draws = shards.select("shard", "__all", F.explode(F.sequence(F.col("shard") * shard, F.least((F.col("shard") + 1) * shard, F.col("__all")) - 1)).alias("__slot"))
    draws = draws.withColumn("__place", F.pmod(prf(F.lit(seed), F.lit(7), F.col("__slot")), F.col("__all")))
    laid = intervals(planned, "n_slots")
    laid = _few(materialize(laid))
    width = F.greatest(F.lit(1), F.ceil(F.col("__all") / F.lit(CELLS))).cast("long")
    met = draws.withColumn("__cell", F.floor(F.col("__place") / width).cast("long")).join(laid, "__cell").where("lo <= __place and __place < hi")
    return met.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("count"))


def slots(planned: DataFrame, shard: int = SHARD, seed: int = SEED, group: int = 1024) -> DataFrame:
    """Every slot of the mix: source, slot (number within the source), shard, block (number in its source's stream), turn."""
    counts = materialize(shard_counts(planned, shard, seed)).withColumn("__g", F.floor(F.col("shard") / group).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("sid", "__g").agg(F.sum("count").alias("__n"))
    sums = sums.select("sid", "__g", F.coalesce(F.sum("__n").over(upto(Window.partitionBy("sid").orderBy("__g"))), F.lit(0)).alias("__g0"))
    inner = F.coalesce(F.sum("count").over(upto(Window.partitionBy("sid", "__g").orderBy("shard"))), F.lit(0))
    placed = counts.withColumn("__in", inner).join(sums, ["sid", "__g"]).select("sid", "shard", "count", (F.col("__g0") + F.col("__in")).alias("__from"))
    drawn = counts.groupBy("sid").agg(F.sum("count").alias("__drawn"))
    by = planned.join(drawn, "sid", "left").select("sid", "source", "n_blocks", "n_slots", F.coalesce("__drawn", F.lit(0)).alias("__drawn"))
    by = materialize(by.withColumn("__over", F.greatest(F.lit(0), F.col("__drawn") - F.col("n_slots"))).withColumn("__under", F.greatest(F.lit(0), F.col("n_slots") - F.col("__drawn"))))
    over0 = F.coalesce(F.sum("__over").over(upto(Window.orderBy("sid"))), F.lit(0)).cast("long")
    spare_of = F.sum("__under").over(Window.partitionBy()).cast("long")
    few = _few(materialize(by.select("sid", "n_slots", "__drawn", over0.alias("__over0"), spare_of.alias("__all"))))
    s = placed.join(few, "sid").repartition(parallelism(planned.sparkSession), "shard", "sid")
    s = s.select("sid", "shard", "n_slots", "__drawn", "__over0", "__all", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("count") - 1)).alias("__j"))
    # Which slots a source drawn too often gives away: those that a permutation maps beyond its target.
    s = s.withColumn("slot", F.when(F.col("__drawn") > F.col("n_slots"), permuted(F.col("__j"), F.col("__drawn"), F.col("sid"), F.lit(-1), seed)).otherwise(F.col("__j")))
    own = s.where(F.col("slot") < F.col("n_slots")).select("sid", "shard", "slot")
    spare = s.where(F.col("slot") >= F.col("n_slots")).select("shard", "__all", (F.col("__over0") + F.col("slot") - F.col("n_slots")).alias("__place"))
    laid = _few(materialize(intervals(by, "__under").join(by.select("sid", "__drawn"), "sid")))
    width = F.greatest(F.lit(1), F.ceil(F.col("__all") / F.lit(CELLS))).cast("long")
    spare = spare.withColumn("__cell", F.floor(F.col("__place") / width).cast("long"))
    given = spare.join(laid, "__cell").where("lo <= __place and __place < hi").select("sid", "shard", (F.col("__drawn") + F.col("__place") - F.col("lo")).alias("slot"))
    out = own.unionByName(given).join(_few(by.select("sid", "source", "n_blocks")), "sid")
    out = out.withColumn("turn", F.floor(F.col("slot") / F.col("n_blocks")).cast("int"))
    block = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), F.col("turn"), seed)
    return out.select("source", "slot", "shard", block.alias("block"), "turn")


def spread(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents with words, one row for each block that they reach into: block, and their first word and word count there."""
    rows = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("*", (first - F.col("start")).alias("first"), (end - first).alias("words"))


def _sources(placed: DataFrame) -> DataFrame:
    return placed.groupBy("source").agg(F.sum("size").alias("source_size"))


def _few(by_source: DataFrame, most: int = 10_000) -> DataFrame:
    """Marked for broadcast where it has at most `most` rows, counted; else left to a shuffled join."""
    return F.broadcast(by_source) if by_source.count() <= most else by_source


def takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, **rules) -> DataFrame:
    """One row per row of docs: id, size, source_size, target (its source's) and taken, the words that the mix holds of it."""
    placed = materialize(packed(docs, id_col, text_col, source_col, seed=seed))
    planned = materialize(plan(_sources(placed), block, **rules))
    times = slots(planned, seed=seed).groupBy("source", "block").agg(F.count(F.lit(1)).alias("__times")).withColumnRenamed("source", "__source").withColumnRenamed("block", "__block")
    parts = spread(placed, block)
    # Sizes estimated before sequences are unfolded are far too low: without the hint the slots' side would be broadcast.
    met = parts.join(times.hint("merge"), parts["source"].eqNullSafe(times["__source"]) & (parts["block"] == times["__block"]), "left")
    key = ["__id", "source", "start", "size"]
    took = met.groupBy(*key).agg(F.sum(F.coalesce(F.col("__times"), F.lit(0)) * F.col("words")).alias("taken"))
    none = placed.where(F.col("size") == 0).select(*key, F.lit(0).cast("long").alias("taken"))
    by = _few(planned.select(F.col("source").alias("__source"), "source_size", "target"))
    out = took.unionByName(none)
    return out.join(by, out["source"].eqNullSafe(by["__source"])).select(F.col("__id").alias(id_col), "size", "source_size", "target", "taken")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, **rules) -> DataFrame:
    """The mix itself: shard, slot, source, and the words of the slot's block in stream order."""
    placed = materialize(packed(docs, id_col, text_col, source_col, (text_col,) if text_col not in ("source", "size", "start") else (), seed))
    planned = materialize(plan(_sources(placed), block, **rules))
    parts = spread(placed, block)
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
    held = parts.select("source", "block", "start", words.alias("w")).groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "w"))), lambda x: x["w"])).alias("words"))
    held = held.withColumnRenamed("source", "__source").withColumnRenamed("block", "__block")
    s = slots(planned, seed=seed)
    return s.join(held.hint("merge"), s["source"].eqNullSafe(held["__source"]) & (s["block"] == held["__block"])).select("shard", "slot", "source", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, **rules) -> DataFrame:
    """The mix as documents: docs' columns, one row per document and pass that takes words of it.

    text holds the words taken in that pass, in the document's order, joined by one
    space; n_chars, where docs has it, is counted anew. Documents are known by id, text
    and source, so rows that share an id stay apart.
    """
    placed = materialize(packed(docs, id_col, text_col, source_col, seed=seed))
    planned = materialize(plan(_sources(placed), block, **rules))
    s = slots(planned, seed=seed).select(F.col("source").alias("__source"), F.col("block").alias("__block"), "turn")
    parts = spread(placed, block)
    met = parts.join(s.hint("merge"), parts["source"].eqNullSafe(s["__source"]) & (parts["block"] == s["__block"]))
    ranges = met.groupBy("__id", "__key", "source", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("__ranges"))
    ranges = ranges.select(F.col("__id").alias("__mixed"), F.col("__key").alias("__with"), F.col("source").alias("__of"), "__ranges")
    known = docs.select(*docs.columns, digest_of(F.coalesce(F.col(text_col), F.lit(""))).alias("__digest"))
    if not placed.groupBy("__id", "__key", "source").count().where("count > 1").isEmpty():
        known = known.dropDuplicates([id_col, "__digest", source_col])
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    got = known.join(ranges.hint("merge"), known[id_col].eqNullSafe(ranges["__mixed"]) & (known["__digest"] == ranges["__with"]) & known[source_col].eqNullSafe(ranges["__of"]))
    # A lambda's argument is computed once; a column used inside would be split into words anew for each range.
    cut = lambda w: F.array_join(F.flatten(F.transform("__ranges", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int")))), " ")
    text = F.element_at(F.transform(F.array(words), cut), 1)
    got = got.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length(text_col).cast("long"))
    return got.select(*docs.columns)
