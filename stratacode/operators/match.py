"""Lookups: countries, agents, pages, offices, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_query, cosine

def grep_country(texts: DataFrame, patterns: list[tuple[str, str]], column: str = "text") -> DataFrame:
    """Append country and remainder: of the patterns (regex, code) that match, the one that leaves least text; ties: first.

    A pattern needs no word boundary on its left, and is not followed by a lower-case letter. One pass over the rows: a cheap alternation decides which rows look at
    the patterns one by one. No match: null country and the text as it is.
    """
    anyone = "|".join(f"(?:{p})" for p, _ in patterns)
    tries = [F.struct(F.length(r).alias("n"), F.lit(k).alias("ord"), F.lit(code).alias("country"), r.alias("remainder")) for k, (p, code) in enumerate(patterns) for r in [clean_query(F.regexp_replace(column, f"(?:{p})(?![a-z])", ""))]]
    hits = [F.when(F.col(column).rlike(f"(?:{p})(?![a-z])"), t) for (p, _), t in zip(patterns, tries, strict=True)]
    best = F.when(F.col(column).rlike(anyone), F.array_min(F.array_compact(F.array(*hits))))
    return texts.withColumn("_b", best).select(*texts.columns, F.col("_b.country").alias("country"), F.coalesce(F.col("_b.remainder"), F.col(column)).alias("remainder"))


#: Agents that may travel beside each row, at some hundred bytes each.
MOST_AGENTS = 10_000


def _held(agents: DataFrame) -> DataFrame:
    """All agents in one row. The query itself fails where there are more than MOST_AGENTS: no job runs to find out beforehand."""
    all_of = agents.agg(F.array_sort(F.collect_list(F.struct("agent", "agent_vector"))).alias("a"))
    fits = F.size("a") <= MOST_AGENTS
    return all_of.select(F.when(fits, F.col("a")).otherwise(F.raise_error(F.lit("too many agents to travel with a query"))).alias("_agents"))


def nearest(rows: DataFrame, agents: DataFrame, least: float, vector: str = "embedding") -> DataFrame:
    """Append the agent (agent, code, agent_vector) of largest cosine, if ``least`` or more; ties: smallest agent.

    Agents are a bounded dimension (at most MOST_AGENTS, else an error): they travel as one array beside each row, so nothing is shuffled.
    """
    held = _held(agents)
    scored = F.transform("_agents", lambda a: F.struct(F.round(cosine(F.col(vector), a["agent_vector"]), 6).alias("sim"), (-a["agent"]).alias("neg")))
    out = rows.crossJoin(F.broadcast(held)).withColumn("_best", F.array_max(scored))
    keep = F.col("_best.sim") >= least
    return out.select(*rows.columns, F.when(keep, -F.col("_best.neg")).alias("agent"), F.col("_best.sim").alias("sim"))


def labels_above(rows: DataFrame, agents: DataFrame, least: float, vector: str = "embedding") -> DataFrame:
    """Append labels: every agent whose cosine is above ``least``, in order."""
    held = _held(agents)
    above = F.filter("_agents", lambda a: F.round(cosine(F.col(vector), a["agent_vector"]), 6) > least)
    return rows.crossJoin(F.broadcast(held)).select(*rows.columns, F.transform(above, lambda a: a["agent"]).alias("labels"))


def most_common_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the value that a key has most often; ties go to the one seen first. Two partial aggregates."""
    per = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return per.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("first_seen")).alias("neg"))).alias("x")).select(key, f"x.{value}", "x.n")


def active_terms(terms: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """Interval join: dates (key, at) with the term (key, start, end) that holds then; a null end is open."""
    return dates.join(terms, key).where((F.col("start") < F.col("at")) & (F.col("end").isNull() | (F.col("end") > F.col("at"))))


def search_whole_items(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, terms array), (doc_id, text) -> the k documents with the highest term count that hold all terms.

    Documents that hold a query's rarest term are its candidates; only those are counted term by term.
    """
    q = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    each = q.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("term")).join(each.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rarest = each.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    wanted = tf.join(rarest, "term").select("query_id", F.col("doc_id").alias("id")).join(each, "query_id").withColumnRenamed("term", "t")
    both = wanted.join(tf, (F.col("t") == F.col("term")) & F.col("id").eqNullSafe(F.col("doc_id")))
    hits = both.groupBy("query_id", "doc_id").agg(F.count("*").alias("found"), F.sum("tf").alias("score"), F.max("n_terms").alias("n_terms")).where("found = n_terms")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def first_sentence_with(docs: DataFrame, needle: Column) -> DataFrame:
    """Append sentence: the first that contains the needle, else the empty string.

    Sentences and needle are bound once as an array element: a filter would compute the needle again for every sentence.
    """
    bound = F.array(F.struct(F.split("text", r"\. |\n").alias("sentences"), needle.alias("needle")))
    first = F.transform(bound, lambda x: F.get(F.filter(x["sentences"], lambda s: F.contains(s, x["needle"])), F.lit(0)))
    return docs.withColumn("sentence", F.coalesce(F.get(first, F.lit(0)), F.lit("")))
