"""Shared helpers of the training-data operators: shared storage, words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: anything between ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary one in local mode (tests), where all share the machine; else an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratacode-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries written within lose their shuffle files when they end, rather than when the driver next collects garbage.

    A chain of steps then holds the disk of one step's shuffle, not of all. For queries whose frame is not run again.
    """
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with no_shuffle_left(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, by: DataFrame, key: str, count: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by``, a written frame with a row for each key and its number of rows in ``count``.

    Keys with more than a thousandth of all rows, of which there are fewer than a thousand, are dealt
    over 64 tasks each by a hash of the column ``spread``. how: inner or left.
    """
    total = by.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in by.where(F.col(count) > max(1000, total // 1000)).select(key).collect()]
    if not hot:
        return rows.join(by, key, how)
    salted = rows.withColumn("join_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(64))).otherwise(F.lit(0)))
    copies = F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    return salted.join(by.withColumn("join_salt", copies), [key, "join_salt"], how).drop("join_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def blobs(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have ``most`` bytes at most, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


class WordHash(dict):
    """Memo of 64-bit word hashes; emptied when full, so that a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def word_hashes(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher over uint64 (wraps silently)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix64(out ^ h[j : j + n]) + np.uint64(j)
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; with fewer words the whole sequence is one, and no words give none."""
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))))
