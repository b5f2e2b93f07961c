"""Readers with fixed schemas: stories, questions, agents, encyclopedia dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import title_case

#: Words that the macros of an agents file stand for.
MINISTRY = ("Minister", "Ministers", "Ministry", "Ministries")
PERSON = ("person", "man", "woman", "men", "women")
STORY = "id string, date string, event_type array<string>, event_mode array<string>, event_text string, story_id string, publisher string, headline string, pub_date string, contexts array<string>, version string"


def read_stories(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """JSON lines; ``most`` > 0 limits the stories, anything else reads all."""
    df = spark.read.schema(STORY).json(path)
    return df.limit(most) if most > 0 else df


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with multi-line cells -> key, attr, question; a row a question."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")
    attrs = F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(c).alias("cell")) for a, c in (("ACTOR", "ACTOR"), ("RECIP", "RECIP"), ("LOC", "LOCATION"), ("DATE", "TIME")))))
    q = df.select(F.concat_ws("_", "event_type", "mode").alias("key"), attrs.alias("a"))
    return q.select("key", "a.attr", F.explode(F.split("a.cell", "\n")).alias("question")).where("question <> ''")


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """Pattern file -> pattern, code_1, code_2. Comments, blank lines, macro definitions (lines with ``!``) and ``{...}`` parts are dropped.

    F30: ``!minist!`` in a pattern gives one of four forms each, with capitals; ``!person!`` one of five.
    """
    x = F.trim(F.regexp_replace(F.regexp_replace("value", r"\{.*?\}", ""), r"\s#.*$", ""))
    rows = spark.read.text(path).select(x.alias("line")).where("line <> '' and not line rlike '^[#!]'")
    code = F.regexp_replace(F.regexp_extract("line", r"\[(.*?)\]", 1), "~", "")
    pattern = F.lower(F.trim(F.replace(F.regexp_replace("line", r"\[.*?\]", ""), F.lit("_"), F.lit(" "))))
    x = rows.select(pattern.alias("pattern"), F.substring(code, 1, 3).alias("code_1"), F.substring(code, 4, 99).alias("code_2"))
    forms = lambda macro, words: F.transform(F.array(*map(F.lit, words)), lambda w: F.replace("pattern", F.lit(macro), w))
    offices = F.transform(F.array(*(title_case(F.replace("pattern", F.lit("!minist!"), F.lit(w))) for w in MINISTRY)), lambda w: w)
    every = F.when(F.contains("pattern", F.lit("!minist!")), offices).when(F.contains("pattern", F.lit("!person!")), forms("!person!", PERSON)).otherwise(F.array("pattern"))
    return x.select(F.explode(every).alias("pattern"), "code_1", "code_2")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Encyclopedia XML (.bz2 by its extension) -> title, text."""
    s = "title string, revision struct<text: struct<_VALUE: string>>"
    return spark.read.format("xml").option("rowTag", "page").schema(s).load(path).select("title", F.col("revision.text._VALUE").alias("text"))


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of the versions that :func:`stratacode.sources.sinks.write_snapshot` left (``version=<n>`` folders)."""
    versions = snapshot_versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no version under {folder}")
    return spark.read.parquet(f"{folder}/version={versions[-1]}")


def snapshot_versions(spark: SparkSession, folder: str) -> list[int]:
    """Finished versions, oldest first."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    names = [s.getPath() for s in store.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV files (with a header line) in zip archives -> their rows by name of column, as text cast to ``schema``.

    An archive is one task, as zip cannot be split; its members are read row by row and leave in batches. Missing columns are null.
    """
    import csv
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.types import StringType, StructField, StructType

    want = spark.createDataFrame([], schema).schema
    names = want.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        with z.open(member) as raw:
                            rows: list[list] = []
                            for r in csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline="")):
                                rows.append([r.get(n) for n in names])
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=names, dtype=object)
                                    rows = []
                            yield pd.DataFrame(rows, columns=names, dtype=object)

    text = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """Headline templates: CSV with event, mode, title."""
    return spark.read.schema("event string, mode string, title string").csv(path, header=True, multiLine=True, escape='"')
