"""Writers of coded events and of the encyclopedia table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import snapshot_versions


def write_events(events: DataFrame, path: str) -> None:
    """Coded events as JSON lines; what was there before goes."""
    events.write.mode("overwrite").json(path)


def write_stage(df: DataFrame, folder: str, run: str, stage: str) -> DataFrame:
    """A stage's rows under ``folder/stage/run=<run>``, read back: a restart goes on from here."""
    path = f"{folder}/{stage}/run={run}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_pages(pages: DataFrame, path: str, rejected: str) -> None:
    """K3: pages with a title and an introduction to ``path``; the others to ``rejected``, so that no row is lost.

    The plan runs once, into a staging folder beside ``path``; both tables are written from there, so they agree.
    """
    spark, staged = pages.sparkSession, f"{path}.staged"
    good = F.coalesce(F.col("title").isNotNull() & (F.trim(F.coalesce("intro_para", F.lit(""))) != ""), F.lit(False))
    pages.withColumn("is_good", good).write.mode("overwrite").partitionBy("is_good").parquet(staged)
    kind = pages.withColumn("is_good", good).schema
    for to, which in ((path, "is_good"), (rejected, "not is_good")):
        spark.read.schema(kind).parquet(staged).where(which).drop("is_good").write.mode("overwrite").parquet(to)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage where the session has a checkpoint folder (``spark.checkpoint.dir``); else the frame as it is, to be run again by each use."""
    context = df.sparkSession.sparkContext
    return df.checkpoint() if context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def write_redirects(redirects: DataFrame, path: str) -> None:
    """K4: redirects (target, sources), in order of target, so that a lookup by title reads few row groups."""
    redirects.repartitionByRange("target").sortWithinPartitions("target").write.mode("overwrite").parquet(path)


def write_snapshot(df: DataFrame, folder: str, keep: int = 2) -> int:
    """K5: a new ``version=<n>`` under ``folder``, in which a finished version is never overwritten; -> its number. Of the older ones ``keep - 1`` stay."""
    spark = df.sparkSession
    before = snapshot_versions(spark, folder)
    n = (before[-1] if before else 0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/version={n}")
    jvm = spark._jvm
    for old in [*before, n][:-keep]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/version={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def append_lines(df: DataFrame, path: str) -> None:
    """K6: rows added to a folder of JSON lines."""
    df.write.mode("append").json(path)
