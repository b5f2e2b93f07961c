"""Model interfaces of the engine, each with a deterministic default that needs no weights, and what is trained here.

``Models`` holds plain functions over lists, which operators call once for an Arrow batch; replace any of
them by one that loads a network (once a worker, under ``lru_cache``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
#: Rows of an agents table that may travel with a query, at 1 kB each; a table beyond it is refused.
MOST_AGENTS = 50_000
_WORD = r"[A-Z](?:[\w'’-]|\.(?=\w))*"
_NAME = re.compile(rf"{_WORD}(?: (?:(?:of|the|de|al|bin|and) )?{_WORD})*")
_WHEN = re.compile(r"(?i)\b(?:(?:last|on|next) )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\b(?:today|yesterday|tomorrow)\b|\b\d+ (?:day|week|month|year)s? ago\b|\blast (?:week|month|year)\b|\b\d{4}-\d\d-\d\d\b")
_WHERE = re.compile(r"\b(?:in|at|near|outside|across) ([A-Z][\w'’-]*(?: [A-Z][\w'’-]*)*)")


@lru_cache(maxsize=100_000)
def _counts(text: str) -> bytes:
    v = np.zeros(DIMENSIONS, np.float32)
    t = f" {text.lower()} "
    for i in range(len(t) - 2):
        v[zlib.crc32(t[i : i + 3].encode()) % DIMENSIONS] += 1
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tobytes()


def trigram_embedding(texts: list[str]) -> np.ndarray:
    """Default encoder: counts of hashed letter trigrams, of unit length; equal texts have cosine 1."""
    return np.frombuffer(b"".join(map(_counts, texts)), np.float32).reshape(-1, DIMENSIONS)


def span_answer(questions: list[str], contexts: list[str]) -> list[tuple[str, float, int, int]]:
    """Default reader: (text, score, start, end). Who: a name that is no place, no time and not in the question, the first or, for targets, the last; where and when by their words."""
    out = []
    for q, c in zip(questions, contexts, strict=True):
        low = q.lower()
        if low.startswith("when"):
            found = [(m.group(), m.start()) for m in _WHEN.finditer(c)]
        elif low.startswith("where"):
            found = [(m.group(1), m.start(1)) for m in _WHERE.finditer(c)]
        else:
            places = {m.group(1) for m in _WHERE.finditer(c)}
            times = {w for m in _WHEN.finditer(c) for w in m.group().lower().split()}
            found = [(m.group(), m.start()) for m in _NAME.finditer(c) if m.group() not in q and m.group() not in places and m.group().lower() not in times]
            found = [(t[4:], s + 4) if t.startswith("The ") else (t, s) for t, s in found]
            if "target" in low or "whom" in low:
                found = found[::-1]
        if not found:
            out.append(("", 0.0, 0, 0))
        else:
            t, s = found[0]
            out.append((t, round(1 / (1 + len(found)), 6), s, s + len(t)))
    return out


def generated_answer(generate: Callable[[list[str], list[str]], list[tuple[str, float]]]) -> Callable:
    """M6: a reader from a text generator of (answer, mean log probability): an answer that the context lacks is no answer; its score is exp of the mean."""

    def read(questions: list[str], contexts: list[str]) -> list[tuple[str, float, int, int]]:
        out = []
        for (t, logp), c in zip(generate(questions, contexts), contexts, strict=True):
            at = c.lower().find(t.lower()) if t else -1
            out.append((c[at : at + len(t)], float(np.exp(logp)), at, at + len(t)) if at >= 0 else ("", 0.0, 0, 0))
        return out

    return read


def capital_entities(texts: list[str]) -> list[list[tuple[str, int]]]:
    """Default annotator of entities: runs of capitalised words, with their offsets."""
    return [[(m.group(), m.start()) for m in _NAME.finditer(t)] for t in texts]


@dataclass(frozen=True)
class Models:
    embed: Callable[[list[str]], np.ndarray] = trigram_embedding
    answer: Callable[[list[str], list[str]], list[tuple[str, float, int, int]]] = span_answer
    entities: Callable[[list[str]], list[list[tuple[str, int]]]] = capital_entities
    #: A second encoder, for alternative names of pages.
    embed_names: Callable[[list[str]], np.ndarray] = trigram_embedding


@dataclass
class Agents:
    """Agents (pattern, code_1, code_2) with their vectors; the nearest by cosine, the first of equals."""

    patterns: list[str]
    code_1: list[str]
    code_2: list[str]
    vectors: np.ndarray = field(repr=False)

    def match(self, texts: list[str], least: float, embed: Callable) -> list[tuple[int, float] | None]:
        if not texts or not self.patterns:
            return [None] * len(texts)
        x = np.asarray(embed(texts), np.float64)
        n = np.linalg.norm(x, axis=1)
        sim = (x / np.where(n > 0, n, 1)[:, None]) @ self.vectors.T
        best = sim.argmax(axis=1)
        conf = sim[np.arange(len(best)), best]
        return [(int(i), float(c)) if t and c >= least else None for t, i, c in zip(texts, best, conf, strict=True)]


def load_agents(agents: DataFrame, embed: Callable = trigram_embedding) -> Agents:
    """A bounded dimension: more than MOST_AGENTS rows are an error, not a broadcast."""
    rows = agents.select("pattern", "code_1", "code_2").take(MOST_AGENTS + 1)
    if len(rows) > MOST_AGENTS:
        raise ValueError("the table of agents has too many rows to travel with a query")
    v = np.asarray(embed([r.pattern for r in rows]), np.float64) if rows else np.zeros((0, DIMENSIONS))
    n = np.linalg.norm(v, axis=1)
    return Agents([r.pattern for r in rows], [r.code_1 for r in rows], [r.code_2 or "" for r in rows], v / np.where(n > 0, n, 1)[:, None])


def embedded(rows: DataFrame, column: str, to: str = "embedding", embed: Callable = trigram_embedding) -> DataFrame:
    """Append the vector of a text; null text has the vector of the empty one."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embed([t or "" for t in texts]), np.float32)))

    return rows.withColumn(to, vectors(F.col(column)))


def cached_embeddings(texts: DataFrame, column: str, folder: str, name: str, embed: Callable = trigram_embedding) -> DataFrame:
    """(sha, text, embedding) of distinct texts, kept under ``folder/name``; only texts not yet there are embedded, then added."""
    spark, path = texts.sparkSession, f"{folder}/{name}"
    wanted = texts.select(F.col(column).alias("text")).where("text is not null").distinct().withColumn("sha", F.sha2("text", 256))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema("text string, sha string, embedding array<float>").parquet(path)
        wanted = wanted.join(held.select("sha"), "sha", "left_anti").select("text", "sha")
    embedded(wanted, "text", embed=embed).select("text", "sha", "embedding").write.mode("append").parquet(path)
    return spark.read.schema("text string, sha string, embedding array<float>").parquet(path)


def classify(rows: DataFrame, weights: dict[str, tuple[list[float], float]], threshold: float = 0.6, vector: str = "embedding", to: str = "event_type") -> DataFrame:
    """M1, M2, M3: append the labels whose logistic model gives more than ``threshold``, in the order of ``weights`` (label -> vector, intercept).

    Event types, modes such as ``SANCTION-withdraw`` and contexts are all labels. Expressions alone: a batch never leaves the JVM.
    """
    z = lambda w: F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, w)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)
    hits = [F.when(F.lit(1.0) / (F.lit(1.0) + F.exp(-(z(w) + F.lit(float(b))))) > threshold, F.lit(label)) for label, (w, b) in weights.items()]
    return rows.withColumn(to, F.array_compact(F.array(*hits)))


def balanced_examples(rows: DataFrame, label: str, most: int = 3, seed: int = 7) -> DataFrame:
    """1 for rows whose ``labels`` hold ``label``; 0 for others with a pseudo-score below 0.05 (null: taken), at most ``most`` for each positive.

    Negatives are chosen by a hash of their id, so reruns agree.
    """
    has = F.array_contains("labels", label)
    good = rows.where(has).withColumn("y", F.lit(1.0))
    n = good.count()
    other = rows.where(~F.coalesce(has, F.lit(False)) & (F.coalesce("pseudo", F.lit(0.0)) < 0.05)).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most * n).withColumn("y", F.lit(0.0))
    return good.unionByName(other)


def train_classifiers(rows: DataFrame, vector: str = "embedding", most: int = 3) -> dict[str, tuple[list[float], float]]:
    """A logistic model for each label of ``rows`` (id, labels, embedding), classes weighted equally -> label -> (vector, intercept).

    A first round over all rows gives pseudo-scores; the second takes as negatives only rows that the first is sure of.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = [r[0] for r in rows.select(F.explode("labels").alias("l")).distinct().orderBy("l").collect()]  # A11
    out = {}

    def fitted(part: DataFrame):
        n = part.agg(F.avg("y")).first()[0] or 0.0
        w = F.when(F.col("y") == 1, F.lit(0.5 / max(n, 1e-9))).otherwise(F.lit(0.5 / max(1 - n, 1e-9)))
        data = part.select("y", w.alias("w"), array_to_vector(F.col(vector)).alias("x"))
        return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, maxIter=50).fit(data)

    for label in names:
        every = rows.withColumn("y", F.coalesce(F.array_contains("labels", label).cast("double"), F.lit(0.0)))
        first = fitted(every)
        scored = first.transform(rows.withColumn("x", array_to_vector(F.col(vector)))).withColumn("pseudo", vector_to_array("probability")[1]).select(*rows.columns, "pseudo")
        second = fitted(balanced_examples(scored, label, most))
        out[label] = ([float(v) for v in second.coefficients.toArray()], float(second.intercept))
    return out


def save_classifiers(spark, weights: dict[str, tuple[list[float], float]], path: str) -> None:
    """K7: a row a label, in order; what was there before goes."""
    rows = [(k, label, [float(v) for v in w], float(b)) for k, (label, (w, b)) in enumerate(weights.items())]
    spark.createDataFrame(rows, "n int, label string, weights array<double>, intercept double").coalesce(1).write.mode("overwrite").parquet(path)


def load_classifiers(spark, path: str) -> dict[str, tuple[list[float], float]]:
    """What :func:`save_classifiers` wrote."""
    return {r.label: (list(r.weights), r.intercept) for r in spark.read.parquet(path).orderBy("n").collect()}


@dataclass(frozen=True)
class Ranker:
    """M7: scores of up to 50 options of seven features, and of "none" (the last): three filters over an option, then three dense layers."""

    filters: np.ndarray  # 3 x 7
    filter_bias: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]  # 150 -> 64 -> 32 -> 51
    options: int = 50

    def scores(self, features: np.ndarray) -> np.ndarray:
        """rows x options x 7 -> rows x (options + 1)."""
        x = np.maximum(features @ self.filters.T + self.filter_bias, 0).transpose(0, 2, 1).reshape(len(features), -1)
        for k, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if k < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x


def rank_options(rows: DataFrame, ranker: Ranker, features: str = "features", to: str = "choice") -> DataFrame:
    """Append the number of the best option of an array of seven-feature arrays, null for "none" or an option past the last; W7: rows of nulls pad it."""

    @F.pandas_udf("int")
    def choose(lists: pd.Series) -> pd.Series:
        x = np.zeros((len(lists), ranker.options, 7))
        n = np.zeros(len(lists), int)
        for i, own in enumerate(lists):
            own = [] if own is None else list(own)[: ranker.options]
            n[i] = len(own)
            for k, f in enumerate(own):
                x[i, k] = f
        best = ranker.scores(x).argmax(axis=1)
        return pd.Series([int(b) if b < m else None for b, m in zip(best, n, strict=True)], dtype="Int32")

    return rows.withColumn(to, choose(F.col(features)))


def geoparse(docs: DataFrame, places: DataFrame, text: str = "event_text", key: str = "id", entities: Callable = capital_entities) -> DataFrame:
    """M4: append geolocated_ents: names in the text that a gazetteer (name, country_code3, feature_code, lat, lon, population) knows, with offsets.

    A name's score is its place's share of the population of all places of that name; the largest is taken, ties by country and position.
    Documents without a name keep an empty array. An equi-join on names; the gazetteer may be of any size.
    """

    @F.pandas_udf("array<struct<name:string,start_char:int,end_char:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        found = entities([t or "" for t in texts])
        return pd.Series([[{"name": n, "start_char": s, "end_char": s + len(n)} for n, s in own] for own in found])

    total = places.groupBy("name").agg(
        F.sum(F.coalesce("population", F.lit(0))).alias("all_people"),
        F.max_by(F.struct("country_code3", "feature_code", "lat", "lon", "population"), F.struct(F.coalesce("population", F.lit(0)).alias("p"), "country_code3", "lat", "lon")).alias("p"),
    )
    named = docs.select(F.col(key).alias("_key"), F.explode(spans(F.col(text))).alias("s")).select("_key", "s.*")
    score = F.coalesce(F.try_divide(F.col("p.population").cast("double"), F.col("all_people")), F.lit(1.0))
    ent = F.struct("start_char", "end_char", F.col("name").alias("search_name"), "name", F.col("p.country_code3").alias("country_code3"), F.col("p.feature_code").alias("feature_code"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), score.alias("score"))
    found = named.join(total, "name").groupBy("_key").agg(F.array_sort(F.collect_set(ent)).alias("geolocated_ents"))
    return docs.join(found, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("geolocated_ents", F.coalesce("geolocated_ents", F.expr("cast(array() as " + found.schema["geolocated_ents"].dataType.simpleString() + ")")))


def story_prompts(headlines: DataFrame, sources: list[str], places: list[str], seed: int = 5) -> DataFrame:
    """A prompt for each headline (event, mode, title) with a title, source and wording; ``{city}`` and ``{country}`` are filled by hash order."""
    wordings = ["Write a news story by {source}: {title}", "{source} reports from {city}. Headline: {title}"]
    pick = lambda salt: F.element_at(F.array(*map(F.lit, places)), (F.pmod(F.xxhash64("event", "title", "source", "n", F.lit(salt)), F.lit(len(places))) + 1).cast("int"))
    x = headlines.where("trim(coalesce(title, '')) <> ''").select("event", "mode", "title", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    x = x.select("*", F.posexplode(F.array(*map(F.lit, wordings))).alias("n", "wording"))
    prompt = F.replace(F.replace("wording", F.lit("{source}"), F.col("source")), F.lit("{title}"), F.col("title"))
    return x.select("event", "mode", "title", "source", "n", F.replace(F.replace(prompt, F.lit("{city}"), pick(seed)), F.lit("{country}"), pick(seed + 1)).alias("prompt"))


def content_key(text: Column) -> Column:
    """A key for caches that is the same in every process."""
    return F.sha2(text, 256)


def file_key(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
