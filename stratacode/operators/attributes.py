"""Attributes of events by question answering in three rounds, with any reader behind one interface."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import split_actors
from ..models import Models
from .events import DEFAULT_QUESTIONS, assign_best

ATTRIBUTES = ("ACTOR", "LOC", "DATE", "RECIP")
ANSWER = "id string, attr string, question string, text string, score double, start int, end int, round int"


def wordings(events: DataFrame, questions: DataFrame) -> DataFrame:
    """Append wordings, the questions (attr, wording) of an event's TYPE_mode; a key that the table lacks takes the default ones.

    A question table has a row for each question; empty ones are skipped. One join on the key, and no row more than before.
    """
    one = F.when(F.col("question") != "", F.struct("attr", F.col("question").alias("wording")))
    by = questions.groupBy(F.col("key").alias("_k")).agg(F.array_sort(F.collect_set(one)).alias("_own"))
    default = F.array(*(F.struct(F.lit(a).alias("attr"), F.replace(F.lit(q), F.lit("{type}"), F.lower("event_type")).alias("wording")) for a, q in DEFAULT_QUESTIONS.items()))
    key = F.concat_ws("_", "event_type", F.coalesce("event_mode", F.lit("")))
    return events.join(by, key == F.col("_k"), "left").select(*events.columns, F.coalesce("_own", default).alias("wordings"))


def filled(wording: str, other: str | None) -> str:
    """both placeholders of a wording filled with the counterpart's text, "someone" where it has none."""
    return wording.replace("{recip_text}", other or "someone").replace("{actor_text}", other or "someone")


def answer_rounds(events: DataFrame, questions: DataFrame, models: Models) -> DataFrame:
    """Events (id, event_type, event_mode, event_text) -> id, attr, question, text, score, start, end, round: all answers.

    Round 1 asks for the four attributes of "someone"; round 2 for the recipient of each actor found; round 3 for the actor on
    each recipient found (U1). In each round an event is asked a question once (A5). A batch of events goes through the three
    rounds together, a call of the reader each, so no answer is computed twice and no row is shuffled.
    """
    asked = wordings(events.select("id", "event_type", "event_mode", "event_text"), questions).select("id", "event_text", "wordings")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = ["" if t is None else t for t in p["event_text"]]
            own = [[(w["attr"], w["wording"]) for w in ws] for ws in p["wordings"]]
            todo = [(i, a, filled(w, None)) for i, ws in enumerate(own) for a, w in ws if a in ATTRIBUTES]
            rows: list[tuple] = []
            for n, (found, wanted) in enumerate((("ACTOR", "RECIP"), ("RECIP", "ACTOR"), (None, None)), 1):
                todo = list(dict.fromkeys(todo))
                got = models.answer([q for _, _, q in todo], [texts[i] for i, _, _ in todo]) if todo else []
                rows += [(p["id"].iloc[i], a, q, *x, n) for (i, a, q), x in zip(todo, got, strict=True)]
                todo = [(i, wanted, filled(w, x[0])) for (i, a, _), x in zip(todo, got, strict=True) if a == found for b, w in own[i] if b == wanted]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return asked.mapInPandas(run, ANSWER)


def grouped_answers(answers: DataFrame) -> DataFrame:
    """A1: id, attr -> its answers as a list in order of round, then question. An event asks a bounded number of questions."""
    return answers.groupBy("id", "attr").agg(F.array_sort(F.collect_list(F.struct("round", "question", "text", "score", "start", "end"))).alias("answers"))


def best_attributes(answers: DataFrame) -> DataFrame:
    """A2, A4: answers -> id, attr, text, score, start, end: each attribute with a text of its own, of the largest total score.

    Scores of one text in one attribute add up; its offsets are those of its first answer. Empty answers are none.
    """
    found = answers.where("text <> ''")
    scored = found.groupBy(F.col("id").alias("event"), "attr", "text").agg(F.round(F.sum("score"), 6).alias("score"), F.min_by(F.struct("start", "end"), F.struct("round", "question", "start", "end")).alias("at"))
    best = assign_best(scored, list(ATTRIBUTES), "at")
    return best.select(F.col("event").alias("id"), "attr", "text", "score", "at.start", "at.end")


def with_attributes(events: DataFrame, questions: DataFrame, models: Models, docs: DataFrame | None = None) -> DataFrame:
    """Append attributes, map attr -> array<struct<text, qa_start_char, qa_end_char>>, to each event; without answers an empty map.

    docs (orig_id, tokens): where given, an answer is split into its co-actors (F20); an answer that ends in no token of the text is left out.
    """
    best = best_attributes(answer_rounds(events, questions, models))
    span = F.struct(F.col("text"), F.col("start").alias("qa_start_char"), F.col("end").alias("qa_end_char"))
    if docs is None:
        spans = best.select("id", "attr", F.array(span).alias("spans"))
    else:
        of = best.join(events.select("id", "orig_id"), "id").join(docs.select("orig_id", "tokens"), "orig_id", "left")
        spans = of.select("id", "attr", F.when(F.col("tokens").isNull(), F.array(span)).otherwise(split_actors("tokens", "text", "start", "end")).alias("spans"))
    held = spans.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "spans")))).alias("attributes"))
    empty = F.expr(f"cast(map() as {held.schema['attributes'].dataType.simpleString()})")
    return events.join(held, "id", "left").withColumn("attributes", F.coalesce("attributes", empty))


def question_round_counts(answers: DataFrame) -> DataFrame:
    """Answers and distinct questions of each round and attribute."""
    return answers.groupBy("round", "attr").agg(F.count("*").alias("n_answers"), F.count_distinct("id", "question").alias("n_questions"))


def latest_answers(answers: DataFrame) -> DataFrame:
    """The last round's answer to each question of an event."""
    w = W.partitionBy("id", "attr", "question").orderBy(F.col("round").desc(), "text")
    return answers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
