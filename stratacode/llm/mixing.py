"""Mixing sources to target weights, with Spark expressions only.

The mix is a sequence of slots of ``block`` words. A source with a target of T words has
ceil(T / block) of them, the last in part, and owns as many consecutive points of 0 .. n-1; point p
is slot p * step mod n, with a step near n / golden ratio and prime to n. So each slot has one
source, and every stretch of the mix holds close to the target share of every source.
Slots are ranked per source. A source's documents, in hashed order, form a stream of words, read
again from its start at its end, and slot rank r takes words r * block to (r + 1) * block of it:
so a source of any size meets its target to the word, the last document in part. Ranks and stream
offsets are prefix sums in two levels (per shard, then within it), so no window sees a whole source.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, is_empty, table, written

GOLDEN = 0.6180339887498949
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of documents, and slots, that one shard of a prefix sum holds; slots of a task that makes them.
SHARD_ROWS, SHARD_SLOTS, TASK_SLOTS = 4_000, 4_000, 500_000
#: So many slots are numbered with 64-bit products, more with decimals.
LONG_SLOTS = 3_000_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size; a row a source) -> also target, weight and rank.

    Sources by code point, null last, take the weights in turn. Targets share ``share`` times
    the whole by weight, and stop at ``most`` times their source's size; the excess goes to the
    others by weight, until none is above. That is the level L with sum(min(cap, L * weight)) =
    the whole, found with one cumulative sum over sources in order of cap / weight. A source
    without words has target 0. The table holds a row for each source, not for each document.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    c = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.withColumn("caps", F.sum("cap").over(up)).withColumn("heavy", F.sum("weight").over(up))
    every = W.partitionBy()
    c = c.withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weights", F.sum("weight").over(every))
    # the level if exactly the sources before this one are full; the first that stays within reach is the level
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - F.col("heavy") + F.col("weight"))
    c = c.withColumn("level", F.min(F.when(level <= F.col("full_at"), F.struct("full_at", level.alias("level")))).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return c.select("source", "source_size", "weight", "rank", target.alias("target"))


def _key(source: str = "source") -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def golden_step(n: int) -> int:
    """The step prime to ``n``, of those near n / golden ratio, whose multiples mod n are spread most evenly."""

    def worst(m: int) -> int:  # largest partial quotient of m / n
        found, x = 0, n
        while m:
            found, x, m = max(found, x // m), m, x % m
        return found

    near = round(n * GOLDEN)
    return min((m for m in range(max(1, near - 30), max(1, min(n - 1, near + 30)) + 1) if gcd(m, n) == 1), key=lambda m: (worst(m), abs(m - near)))


def slots(targets: DataFrame, block: int = 64) -> DataFrame:
    """(key, goal, rank; a row a source) -> key, rank, slot: the source's slots in order. Slots of all sources are 0 .. n-1, each once."""
    t = targets.select("key", F.col("rank").alias("nth"), F.expr(f"(goal + {block - 1}) div {block}").alias("n")).where("n > 0")
    total = t.agg(F.sum("n")).first()[0] or 0
    number = "long" if total < LONG_SLOTS else "decimal(19,0)"
    up = W.orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("until", F.sum("n").over(up)).withColumn("first", F.col("until") - F.col("n"))
    part = F.explode(F.expr(f"sequence(first div {SHARD_SLOTS}, (until - 1) div {SHARD_SLOTS})")).alias("part")
    t = t.select("key", "first", "until", part).repartition(total // TASK_SLOTS + 1, "key", "part")
    s = t.select("key", F.explode(F.expr(f"sequence(greatest(first, part * {SHARD_SLOTS}), least(until, (part + 1) * {SHARD_SLOTS}) - 1)")).alias("point"))
    step, n = golden_step(max(1, total)), max(1, total)
    s = s.select("key", F.pmod(F.col("point").cast(number) * F.lit(step).cast(number), F.lit(n).cast(number)).cast("long").alias("slot"))
    s = s.withColumn("shard", F.expr(f"slot div {SHARD_SLOTS}"))
    per = s.groupBy("key", "shard").agg(F.count("*").alias("m"))
    before = per.select("key", "shard", (F.sum("m").over(W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")).alias("before"))
    s = s.withColumn("nth", F.row_number().over(W.partitionBy("key", "shard").orderBy("slot")) - 1).join(before, ["key", "shard"])
    return s.select("key", (F.col("before") + F.col("nth")).alias("rank"), "slot")


def _streams(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """A row a document: row, doc_id, key, size, h, same (rows equal to it), start (words before it in its source's stream), source_size, target, goal; a row a source."""
    base = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    # equal rows as one with their number, so that a much repeated one fills no shard
    base = written(base.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("same")), "mix-base")
    sums = base.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"))
    targets = source_targets(sums, share, most, weights).withColumn("key", _key()).withColumn("goal", F.floor(F.col("target") + 1e-6))
    targets = written(targets, "mix-targets")
    n_rows = base.count()
    shards = max(1, -(-n_rows // SHARD_ROWS))

    # stream offsets: words before a document in its source, by (shard, hash)
    shard = F.pmod(F.xxhash64(F.col("h"), F.lit(seed)), F.lit(shards))
    keyed = base.select("doc_id", _key().alias("key"), "size", "h", "same", shard.alias("shard"))
    words = F.col("size") * F.col("same")
    per = keyed.groupBy("key", "shard").agg(F.sum(words).alias("words"))
    before = per.select("key", "shard", (F.sum("words").over(W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")).alias("before"))
    inner = W.partitionBy("key", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    # targets join the shards, a row for each source and shard, and reach the documents with their shard's offset: no join on a hot source
    before = written(before.join(targets.select("key", "source", "source_size", "target", "goal"), "key"), "mix-shards")
    placed = keyed.withColumn("start", F.sum(words).over(inner) - words).join(before, ["key", "shard"]).withColumn("start", F.col("start") + F.col("before"))
    placed = placed.withColumn("nth", F.explode(F.expr("sequence(0L, same - 1)"))).withColumn("start", F.expr("start + nth * size"))
    placed = placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "size", "h", "same", "start", "source", "source_size", "target", "goal")
    return written(placed, "mix-streams"), targets


def _readings(placed: DataFrame) -> DataFrame:
    """A row each time that the mix reads a document, also in part: row, key, h, size, same, and the words at .. end of the source's endless stream."""
    again = F.explode(F.expr("sequence(0L, (goal - 1) div source_size)"))
    r = placed.where("size > 0 and goal > 0").withColumn("pass", again).withColumn("at", F.expr("start + pass * source_size")).where("at < goal")
    return r.select("row", "key", "h", "size", "same", "at", F.expr("least(at + size, goal)").alias("end"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 64, seed: int = 17) -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, size, source, source_size, target, taken, first_slot; a row for each row.

    size: words of the whole text (null: 0). taken: words that the mix's slots take from the row,
    repeats counted; at most ``most`` times its size, rounded up to whole passes. A source's sum is
    its target, rounded down. first_slot: the first slot that takes from the row, null if none does.
    ``block``: words of a slot of the mix; a source's last slot may be part of one, so what is taken
    does not depend on it. Rows that repeat a doc_id count each. Reruns on equal rows agree: order
    comes from hashes of doc_id, size and text. A null source is a source of its own. An empty
    table, or one without words, takes nothing.
    """
    placed, targets = _streams(docs, share, most, weights, seed)
    pieces = _readings(placed).withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    pieces = pieces.withColumn("words", F.expr(f"least(end, (rank + 1) * {block}) - greatest(at, rank * {block})")).select("row", "key", "rank", "words")
    # merged: compressed slots are small enough for Spark to broadcast where their rows are not
    got = pieces.join(slots(targets, block).hint("merge"), ["key", "rank"]).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(got.hint("merge"), "row", "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 64, seed: int = 17) -> DataFrame:
    """The mix as rows of ``docs``, all columns, in the order of its slots: a row for each time that the mix reads its text.

    Texts stay whole: of a source's last reading, which the mix may take in part, the row is there if at least half of its
    words are taken, or if it is the source's only one. So a source's words are within half a document of its target, but for
    that only one. Rows stand in the order in which slots take their first words. Rows without words are in no mix. Rows that
    are equal in doc_id, text and source are numbered in one window a group. Columns may have any names.
    """
    placed, targets = _streams(docs, share, most, weights, seed)
    r = _readings(placed).where("at = 0 or 2 * (end - at) >= size").withColumn("rank", F.expr(f"at div {block}"))
    r = r.join(slots(targets, block).hint("merge"), ["key", "rank"]).groupBy("h", "key", "row", "same").agg(F.collect_list(F.struct("slot", "at")).alias("mix_spots"))
    r = written(r.select(F.col("h").alias("mix_hash"), F.col("key").alias("mix_key"), "row", "same", "mix_spots"), "mix-readings")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix_hash"), _key().alias("mix_key"))
    on = ["mix_hash", "mix_key"]
    out = rows.join(r.where("same = 1").drop("row", "same").hint("merge"), on).select("doc", "mix_spots")
    again = r.where("same > 1")
    if not is_empty(again):
        own = W.partitionBy(*on)
        again = again.select(*on, "mix_spots", F.row_number().over(own.orderBy("row")).alias("mix_nth"))
        equal = rows.join(again.select(*on).distinct(), on, "left_semi").withColumn("mix_nth", F.row_number().over(own.orderBy(F.xxhash64(F.to_json("doc")))))
        out = out.unionByName(equal.join(again, [*on, "mix_nth"]).select("doc", "mix_spots"))
    # written before the sort, whose sampling would run the joins again
    out = written(out, "mix-rows", compression="zstd").select("doc", F.explode("mix_spots").alias("spot"))
    return out.orderBy("spot.slot", "spot.at").select("doc.*")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")
