"""Token-id output: documents are packed into rows of a fixed number of ids, best fit decreasing.

Items are placed longest first, each into the fullest open row that still has room; a segment
tree over the capacities 0..length finds that row in log time. Documents longer than a row are
split into consecutive pieces, of which all but the last fill rows of their own. A pack is
formed from a window of one input partition, so nothing is shuffled and memory is bounded by
WINDOW_TOKENS; a lost task is simply run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentencepiece
from .common import sliced, table, written

LENGTH, WINDOW_TOKENS = 2048, 8_000_000
NO_DOC = -(1 << 63)
PACK_SCHEMA = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"


class Capacities:
    """Open rows by remaining capacity; a segment tree finds the smallest capacity that is large enough."""

    def __init__(self, most: int):
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for ``least``; it is taken out."""
        i = self.size + least
        if not self.count[i]:
            while i > 1 and (i % 2 or not self.count[i + 1]):  # up until a right sibling holds something
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            self.count[i] -= 1
            i //= 2
        return capacity, row


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows as lists of item numbers; every length is between 1 and ``most``."""
    rows: list[list[int]] = []
    open_ = Capacities(most)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_.take(lengths[k])
        if found is None:
            found = most, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(k)
        if capacity > lengths[k]:
            open_.add(capacity - lengths[k], row)
    return rows


def pack(items: list[tuple[int | None, bytes]], length: int, first_id: int) -> pa.RecordBatch:
    """(doc_id, int32 ids) -> packed rows as PACK_SCHEMA says."""
    pieces = [(doc, at, raw[4 * at : 4 * (at + length)]) for doc, raw in items for at in range(0, len(raw) // 4, length)]
    rows = best_fit_decreasing([len(p[2]) // 4 for p in pieces], length)
    ids, n, cu, docs, offsets = [], [], [], [], []
    for row in rows:
        own = [pieces[k] for k in row]
        raw = b"".join(p[2] for p in own)
        n.append(len(raw) // 4)
        ids.append(raw.ljust(4 * length, b"\0"))
        cu.append(np.cumsum([0, *(len(p[2]) // 4 for p in own)]).astype(np.int32))
        docs.append([p[0] for p in own])
        offsets.append([p[1] for p in own])
    i32 = pa.list_(pa.int32())
    cols = [
        pa.array(np.arange(first_id, first_id + len(rows))),
        pa.array(ids, pa.binary()),
        pa.array(n, pa.int32()),
        pa.array(cu, i32),
        pa.array([c[:-1] for c in cu], i32),
        pa.array(docs, pa.list_(pa.int64())),
        pa.array(offsets, i32),
    ]
    return pa.RecordBatch.from_arrays(cols, ["pack_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"])


def pack_documents(docs: DataFrame, length: int = LENGTH, model_path: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> packed id matrices, a row for each pack.

    ids: ``length`` little-endian int32, zero beyond ``n_tokens``. cu_seqlens: 0 and the ends of
    the segments. position_resets: where positions begin again at 0. doc_ids and doc_offsets:
    each segment's document and its first token within it, so that all documents can be put
    together again (:func:`unpack`). Texts without ids (null, empty) are in no pack. Rows that
    repeat a doc_id, or have none, are packed each. Extra columns are ignored; an empty table
    gives no packs. A pack never spans input partitions, so their number depends on the files' layout.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sentencepiece.load(model_path)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple[int | None, bytes]] = []
        tokens = 0
        for big in batches:
            for b in sliced(big, "text", sentencepiece.GROUP_BYTES):
                ids, at = m.encode_array(b.column("text"))
                raw, ends = ids.tobytes(), (4 * at).tolist()
                held += [(d, raw[x:y]) for d, x, y in zip(b.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True) if y > x]
                tokens += len(ids)
                if tokens >= WINDOW_TOKENS:
                    out = pack(held, length, next_id)
                    next_id += out.num_rows
                    held, tokens = [], 0
                    for k in range(0, out.num_rows, 1024):
                        yield out.slice(k, 1024)
        if held:
            out = pack(held, length, next_id)
            for k in range(0, out.num_rows, 1024):
                yield out.slice(k, 1024)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACK_SCHEMA)


def write_shards(packs: DataFrame, path: str) -> DataFrame:
    """Packs -> binary shards under ``path``; a row (shard, packs, length) for each.

    A shard is two files: ``.bin``, its packs' id matrix, ``length`` little-endian int32 a row; and ``.seg``, for
    each pack its pack_id (int64), its number of segments k (int64), k + 1 cumulative lengths, k documents and k
    offsets (int64 each; the smallest int64 for a null document). Position resets are the cumulative lengths but
    the last. A task that is run again writes files of another name, of which only those of finished tasks are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        name, n, length = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, 0
        streams = []
        for b in batches:
            if b.num_rows and not streams:
                streams = [store.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "seg")]
            for pack_id, ids, cu, docs, offsets in zip(*(b.column(c).to_pylist() for c in ("pack_id", "ids", "cu_seqlens", "doc_ids", "doc_offsets")), strict=True):
                streams[0].write(ids)
                streams[1].write(np.array([pack_id, len(docs), *cu, *(NO_DOC if x is None else x for x in docs), *offsets], np.int64).tobytes())
                n, length = n + 1, len(ids) // 4
        for x in streams:
            x.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64()), pa.array([length], pa.int32())], ["shard", "packs", "length"])

    return written(packs.mapInArrow(run, "shard string, packs long, length int"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """The frame that :func:`write_shards` returns -> packs again, as PACK_SCHEMA says; a shard is read a bounded piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, packs, length in zip(*(b.column(c).to_pylist() for c in ("shard", "packs", "length")), strict=True):
                store, at = fs.FileSystem.from_uri(shard) if "://" in shard or shard.startswith("file:") else (fs.LocalFileSystem(), shard)
                with store.open_input_stream(f"{at}.bin") as rows, store.open_input_stream(f"{at}.seg") as segments:
                    for i in range(0, packs, 1024):
                        cols: list[list] = [[] for _ in range(7)]
                        for _ in range(min(1024, packs - i)):
                            pack_id, k = np.frombuffer(segments.read(16), np.int64).tolist()
                            v = np.frombuffer(segments.read(8 * (3 * k + 1)), np.int64).tolist()
                            docs = [None if x == NO_DOC else x for x in v[k + 1 : 2 * k + 1]]
                            for c, x in zip(cols, (pack_id, rows.read(4 * length), v[k], v[: k + 1], v[:k], docs, v[2 * k + 1 :]), strict=True):
                                c.append(x)
                        i32 = pa.list_(pa.int32())
                        kinds = [pa.int64(), pa.binary(), pa.int32(), i32, i32, pa.list_(pa.int64()), i32]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in PACK_SCHEMA.split(", ")])

    return shards.repartition(max(1, min(10_000, shards.count()))).mapInArrow(run, PACK_SCHEMA)


def unpack(packs: DataFrame) -> DataFrame:
    """Packs -> doc_id, ids binary: every document whole again."""
    seg = packs.select("ids", F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.col("position_resets").alias("a"), F.slice("cu_seqlens", 2, 2_000_000_000).alias("b"))).alias("s"))
    part = F.struct(F.col("s.doc_offsets").alias("at"), F.substring("ids", F.col("s.a") * 4 + 1, (F.col("s.b") - F.col("s.a")) * 4).alias("raw"))
    return seg.groupBy(F.col("s.doc_ids").alias("doc_id")).agg(F.array_sort(F.collect_list(part)).alias("ps")).select("doc_id", F.aggregate("ps", F.lit(b""), lambda acc, p: F.concat(acc, p["raw"])).alias("ids"))


def op6_packed_ids(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
