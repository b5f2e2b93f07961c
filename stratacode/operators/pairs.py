"""Training pairs of names: of one page (positive), of another (negative), of a page with a like title (hard).

Samples are drawn by hashes, so a rerun draws the same. A group's pairs are bounded by its bounded list of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sampled(names, most: int, seed: int, key):
    """At most ``most`` of an array of names, first by a hash of key and name."""
    ordered = F.array_sort(F.transform(names, lambda n: F.struct(F.xxhash64(key, n, F.lit(seed)).alias("h"), n.alias("n"))))
    return F.transform(F.slice(ordered, 1, most), lambda x: x["n"])


def positive_pairs(groups: DataFrame, most_names: int = 50, most_pairs: int = 10, seed: int = 1) -> DataFrame:
    """Groups (key, names) -> key, a, b with a < b: at most ``most_pairs`` pairs of at most ``most_names`` distinct names of a group."""
    own = F.array_sort(sampled(F.array_distinct("names"), most_names, seed, F.col("key")))
    pairs = F.flatten(F.transform("own", lambda a, i: F.transform(F.slice("own", i + 2, most_names), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    x = groups.select("key", own.alias("own")).select("key", pairs.alias("pairs"))
    ordered = F.array_sort(F.transform("pairs", lambda p: F.struct(F.xxhash64("key", p["a"], p["b"], F.lit(seed)).alias("h"), p.alias("p"))))
    return x.select("key", F.explode(F.slice(ordered, 1, most_pairs)).alias("x")).select("key", "x.p.a", "x.p.b")


def negative_pairs(groups: DataFrame, per_group: int = 10, seed: int = 2) -> DataFrame:
    """Each group's names with names of other groups -> key, other, a, b; ``per_group`` pairs a group of several groups.

    Groups are numbered in order of a hash; a group's partners are those that follow it at growing distances, around the end: an
    equi-join on numbers, in place of a cross join. Numbers are those of range-partitioned rows: no window sees all groups.
    """
    spark = groups.sparkSession
    g = groups.where(F.size("names") > 0).select("key", "names", F.xxhash64("key", F.lit(seed)).alias("h"))
    total = g.count()
    if total < 2:
        return spark.createDataFrame([], g.schema).select("key", F.col("key").alias("other"), F.col("names")[0].alias("a"), F.col("names")[0].alias("b"))
    parts = g.repartitionByRange("h", "key").sortWithinPartitions("h", "key").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    parts = parts.withColumn("nth", F.col("row") - F.shiftleft(F.col("part").cast("long"), 33)).drop("row", "h")
    sizes = sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())  # a row for each partition
    start, at = {}, 0
    for part, n in sizes:
        start[part], at = at, at + n
    offset = F.element_at(F.create_map(*(F.lit(v) for kv in start.items() for v in kv)), F.col("part"))
    numbered = parts.select("key", "names", (F.col("nth") + offset).alias("no"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(min(per_group, total - 1)))).alias("step")
    asked = numbered.select("key", "names", "no", steps).withColumn("to", F.pmod(F.col("no") + F.col("step"), F.lit(total)))
    other = numbered.select(F.col("key").alias("other"), F.col("names").alias("theirs"), F.col("no").alias("to"))
    one = lambda names, salt: F.get(F.col(names), F.pmod(F.xxhash64("key", "step", F.lit(seed + salt)), F.size(names).cast("long")).cast("int"))
    return asked.join(other, "to").select("key", "other", one("names", 1).alias("a"), one("theirs", 2).alias("b"))


def hard_negatives(pages: DataFrame, close: DataFrame, names_each: int = 2, seed: int = 3) -> DataFrame:
    """Pages (page_id, names), close matches (page_id, other_id) of titles -> page_id, other_id, a, b: every name of the other page with ``names_each`` of the page's own."""
    own = close.where("page_id <> other_id").join(pages, "page_id").select("page_id", "other_id", "names")
    both = own.join(pages.select(F.col("page_id").alias("other_id"), F.col("names").alias("theirs")), "other_id")
    x = both.select("page_id", "other_id", "names", F.explode("theirs").alias("b"))
    return x.select("page_id", "other_id", "b", F.explode(sampled(F.col("names"), names_each, seed, F.col("b"))).alias("a")).select("page_id", "other_id", "a", "b")


def labelled_pairs(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """A, b and label 1 or 0."""
    return positive.select("a", "b", F.lit(1).alias("label")).unionByName(negative.select("a", "b", F.lit(0).alias("label")))


def nearest_titles(queries: DataFrame, titles: DataFrame, k: int = 4) -> DataFrame:
    """Queries (query) -> query, title, lcs, n: the k titles with the longest common subsequence, among titles that share a word with it."""
    from ..functions.letters import lcs_length
    from .search import terms_of

    q = queries.select("query", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))
    t = titles.select("title", F.explode(F.array_distinct(terms_of(F.col("title")))).alias("term"))
    pairs = q.join(t, "term").select("query", "title").distinct().withColumn("lcs", lcs_length("query", "title"))
    w = W.partitionBy("query").orderBy(F.col("lcs").desc(), "title")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
