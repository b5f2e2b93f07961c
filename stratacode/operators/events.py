"""Stories to events, questions, answers and their assignment to roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.letters import roll_up

DEFAULT_QUESTIONS = {
    "ACTOR": "Who did the {type} to someone?",
    "LOC": "Where did the {type} take place?",
    "DATE": "When did the {type} take place?",
    "RECIP": "Who was the target of the {type}?",
}


def stories_to_events(stories: DataFrame) -> DataFrame:
    """A row for each type of a story, or for each of its modes of that type; narrow, without a shuffle.

    id becomes ``id_TYPE_mode`` (``id_TYPE_`` without modes), orig_id keeps the story's. Modes of
    types the story doesn't have vanish; stories without types give no row; a null mode list is an empty one.
    """
    t = stories.withColumn("type", F.explode("event_type"))
    own = F.filter(F.coalesce("event_mode", F.array().cast("array<string>")), lambda m: F.substring_index(m, "-", 1) == F.col("type"))
    t = t.withColumn("mode_of_type", F.explode_outer(own))
    mode = F.coalesce(F.when(F.instr("mode_of_type", "-") > 0, F.regexp_replace("mode_of_type", "^[^-]*-", "")), F.lit(""))
    keep = [c for c in stories.columns if c not in ("id", "event_type", "event_mode", "orig_id")]
    return t.select(F.concat_ws("_", F.col("id"), F.col("type"), mode).alias("id"), F.col("id").alias("orig_id"), F.col("type").alias("event_type"), mode.alias("event_mode"), *keep)


def fill_questions(events: DataFrame, questions: DataFrame) -> DataFrame:
    """Events x attributes -> id, attr, question. ``questions``: key (TYPE_mode), attr, question; a small dimension.

    A missing key falls back on the default wording; an empty question is skipped; placeholders become "someone".
    """
    e = events.select("id", F.concat_ws("_", "event_type", "event_mode").alias("key"), F.lower("event_type").alias("lower_type"))
    defaults = F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.lit(q).alias("wording")) for a, q in DEFAULT_QUESTIONS.items())))
    e = e.select("*", defaults.alias("d")).select("id", "key", "lower_type", "d.attr", "d.wording")
    known = questions.select("key").distinct().withColumn("known", F.lit(True))
    e = e.join(known, "key", "left").join(questions, ["key", "attr"], "left")
    q = F.when(F.col("known"), F.col("question")).otherwise(F.replace("wording", F.lit("{type}"), F.col("lower_type")))
    q = F.replace(F.replace(q, F.lit("{recip_text}"), F.lit("someone")), F.lit("{actor_text}"), F.lit("someone"))
    return e.select("id", "attr", q.alias("question")).where("question <> ''")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys, the last in order (ties: any, all order columns being equal)."""
    w = W.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sum_answers(answers: DataFrame) -> DataFrame:
    """(event, attr, text, score, ...) -> the score of each distinct text, summed and rounded to six digits."""
    return answers.groupBy("event", "attr", "text").agg(F.round(F.sum("score"), 6).alias("score"))


def pivot_scores(scores: DataFrame, attrs: list) -> DataFrame:
    """A row for each (event, text), a column for each attribute; 0 where it has no answer."""
    cols = [F.round(F.coalesce(F.sum(F.when(F.col("attr") == a, F.col("score"))), F.lit(0.0)), 6).alias(f"attr_{a}") for a in attrs]
    return scores.groupBy("event", "text").agg(*cols)


def assign_best(scores: DataFrame, attrs: list, keep: str | None = None) -> DataFrame:
    """Each attribute gets a text of its own so that the total score is largest; exact, in an expression.

    ``scores``: (event, attr, text, score), one row for each attribute and text; more than the n best texts of one of n
    attributes can't be needed. Attribute by attribute, every choice so far goes on with each of its texts that is not yet
    taken, or with none: (n + 1)^n choices at most, whatever an event's number of texts. Ties: the better and then the
    smaller text of the first attribute. Unserved attributes are absent. ``keep``: a column that goes with a text.
    -> event, attr, text, score.
    """
    n = len(attrs)
    at = F.coalesce(*(F.when(F.col("attr") == a, F.lit(i)) for i, a in enumerate(attrs)))
    texts = scores.where(F.col("attr").isin(*attrs) & (F.col("score") > 0)).withColumn("i", at)
    texts = texts.withColumn("r", F.row_number().over(W.partitionBy("event", "attr").orderBy(F.col("score").desc(), "text"))).where(F.col("r") <= n)
    row = texts.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("i", "r", F.col("text").cast("string").alias("text"), "score", *([keep] if keep else [])))).alias("ts"))
    kind = row.schema["ts"].dataType.simpleString()
    none = F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast(kind).alias("pick")))

    def with_attribute(states, i):
        own = F.filter("ts", lambda t: t["i"] == i)
        grown = lambda s: F.transform(F.filter(own, lambda t: ~F.exists(s["pick"], lambda p: p["text"] == t["text"])), lambda t: F.struct((s["total"] + t["score"]).alias("total"), F.concat(s["pick"], F.array(t)).alias("pick")))
        return F.flatten(F.transform(states, lambda s: F.concat(grown(s), F.array(s))))

    states = F.aggregate(F.array(*map(F.lit, range(n))), none, with_attribute) if n else none
    top = F.aggregate(states, none[0], lambda a, s: F.when(s["total"] > a["total"], s).otherwise(a))
    names = F.array(*map(F.lit, attrs))
    best = row.select("event", F.explode(top["pick"]).alias("p"))
    return best.select("event", F.element_at(names, F.col("p.i") + 1).alias("attr"), F.col("p.text").alias("text"), F.col("p.score").alias("score"), *([F.col(f"p.{keep}").alias(keep)] if keep else []))


def without_doc(stories: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Stories that no annotated document has; empty where the two tables fit together."""
    return stories.join(docs.select(key), key, "left_anti")


def join_docs(stories: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Stories with their annotation (ents: text, label) by key, and its people, organisations and places, distinct and sorted."""
    x = stories.join(docs, key)
    return x.withColumns({"story_people": roll_up(F.col("ents"), "PERSON"), "story_organizations": roll_up(F.col("ents"), "ORG"), "story_places": roll_up(F.col("ents"), "GPE", "LOC", "FAC")})


def drop_bookkeeping(spans, *fields: str):
    """P10: an array of spans without working fields; fields that it lacks don't matter."""
    return F.transform(spans, lambda s: s.dropFields(*fields))
