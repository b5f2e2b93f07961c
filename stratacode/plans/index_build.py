"""The encyclopedia index from a dump: redirects, articles and postings, each a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import merge_redirects, parse_articles, redirect_target
from ..operators.search import postings
from ..sources.readers import read_dump
from ..sources.sinks import write_pages, write_redirects


def build_links(pages: DataFrame) -> DataFrame:
    """Redirect pages of a dump -> target, sources."""
    return merge_redirects(pages.select(F.col("title").alias("source"), redirect_target(F.col("text")).alias("target")))


def build_index(spark: SparkSession, dump: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """A dump -> (pages with page_id, postings), read back from ``folder``; its parts are redirects, pages and postings.

    page_id is a hash of title, introduction and info box; of pages equal in these, one stays. The dump is read twice, as the
    redirects must be merged before the first article can be written; what is parsed is written once.
    """
    pages = read_dump(spark, dump)
    write_redirects(build_links(pages), f"{folder}/redirects")
    articles = parse_articles(pages, spark.read.parquet(f"{folder}/redirects"))
    key = F.xxhash64("title", "intro_para", F.to_json("infobox"))
    write_pages(articles.withColumn("page_id", key).dropDuplicates(["page_id"]), f"{folder}/pages", f"{folder}/rejected")
    good = spark.read.parquet(f"{folder}/pages")
    postings(good).write.mode("overwrite").parquet(f"{folder}/postings")
    return good, spark.read.parquet(f"{folder}/postings")
