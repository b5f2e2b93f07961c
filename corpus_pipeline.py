"""From raw documents to token ids in five stages, each written as Parquet and read again.

Documents that the quality classifier rejects go; one document of each near-duplicate group
stays; byte strings that repeat across what is left are cut out; sources are mixed to their
target weights; and the mix is encoded, and decoded again as a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacode.llm import mixing, neardup, quality, sentencepiece, suffixes
from stratacode.llm.common import blobs, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.5 or more; it learns from the labelled rows of ``docs``."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents with five-word shingle similarity of 0.8 or more: that of the smallest doc_id, null last.

    Rows are named by doc_id and a hash of the text; of rows that repeat both, the one with the smallest other columns stays.
    """
    rows = neardup.near_duplicates(docs, words=5, with_hash=True)
    gone = rows.groupBy(F.col("doc_id").alias("gone_id"), F.col("h64").alias("gone_h64")).agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("gone")).where("gone > 0")
    gone = written(gone.select("gone_id", "gone_h64", "stay"), "gone")
    docs = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("doc_h64"), F.col("doc_id").cast("long").alias("own_id"))
    on = (F.col("doc_h64") == F.col("gone_h64")) & F.col("own_id").eqNullSafe(F.col("gone_id"))
    out = docs.join(gone, on, "left_anti").select("doc")
    again = gone.where("stay > 0")
    if not neardup.is_none(again):  # repeated rows, of which one stays
        out = out.unionByName(docs.join(again, on).groupBy("gone_id", "gone_h64").agg(F.min("doc").alias("doc")).select("doc"))
    return out.select("doc.*")


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes as text, without those of a cut character."""
    for b in batches:
        kept = pa.array([x.decode("utf-8", "ignore") for x in blobs(b.column("kept"))], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("cut_id"), b.column("cut_h64"), kept], ["cut_id", "cut_h64", "kept"])


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur again elsewhere; bytes of a cut character go too. Emptied rows stay."""
    cut = suffixes.remove_repeats(docs).where("kept is not null and size(spans) > 0")
    cut = written(cut.select(F.col("doc_id").alias("cut_id"), F.col("h64").alias("cut_h64"), "kept").dropDuplicates(["cut_id", "cut_h64"]).mapInArrow(_characters, "cut_id long, cut_h64 long, kept string"), "cut", compression="zstd")
    h64 = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("doc"), h64.alias("doc_h64"), F.col("doc_id").cast("long").alias("own_id"))
    out = keyed.join(cut, (F.col("doc_h64") == F.col("cut_h64")) & F.col("own_id").eqNullSafe(F.col("cut_id")), "left")
    now = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(F.when(F.col("kept").isNull(), F.col("doc")[c]).otherwise(now[c]).alias(c) if c in now else F.col("doc")[c].alias(c) for c in docs.columns))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the slots of the mix of sources read them, in the order of the slots; rows without words are in no mix."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with ids, n_ids and lossless."""
    return sentencepiece.tokenised(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated strings", repeat_stage),
    ("source mix", mix_stage),
    ("sentencepiece", token_stage),
]

#: No SQL for a classifier, a similarity join or a Viterbi search: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
