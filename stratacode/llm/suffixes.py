"""Repeated byte strings by a sampled suffix array.

A byte goes if a string of ``length`` bytes covers it that starts anywhere else as well. Not
every suffix is sorted: in each window of that length the 32-byte string with the smallest hash
(the leftmost of equals) is its *anchor*, which depends on nothing but the window's bytes, so
equal windows have equal anchors at equal offsets. Suffixes start at anchors, one every 85
bytes or so, and only anchors whose 32 bytes occur again take part. Sampled splitters
range-partition them by leading bytes; a bucket sorts them by multikey quicksort (eight bytes a
digit, recursing into equal digits only), and likewise what precedes them, backwards. A window
at offset o of its anchor is then named by its class among the suffixes at depth length - o and
among the reversed prefixes at depth o; names that occur twice are repeats. An anchor that
fills more than a bucket is dealt over several, which compare what they have at their
boundaries. Windows that repeat at a small shift within their text (periodic runs) are marked
and left out beforehand, and of equal texts one takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, join_hot, mix64, table, written

GRAM = 32
#: Records that one bucket sorts; bytes that one vectorised step scans.
BUCKET, BLOCK = 40_000, 1 << 20
#: Sampled suffixes a bucket, of which the driver holds 8 bytes each to pick splitters, and the least sample.
SAMPLE_A_BUCKET, SAMPLE = 16, 20_000
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = {s: np.uint64(int(mix64(np.array([s * 77], np.uint64))[0]) | 1) for s in (1, 2, 4, 8, 16)}


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(d > 0), np.flatnonzero(d < 0)


def scan(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of the texts laid end to end in ``buf`` (at most BLOCK bytes; ``ends``: where each ends).

    -> key, anchor, first and last window of each record, and starts of windows repeated nearby.
    """
    n = len(buf) - length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    h = _BYTES[buf]
    s = 1
    while s < GRAM:
        h = h[: len(h) - s] * _STEP[s] + h[s:]
        s *= 2
    mixed = mix64(h)
    lead = buf[: len(h)].astype(np.int64) << 16 | buf[1 : len(h) + 1].astype(np.int64) << 8 | buf[2 : len(h) + 2]
    low = (mixed & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    span, s = length - GRAM + 1, 1
    m = low
    while 2 * s <= span:
        m = np.minimum(m[: len(m) - s], m[s:])
        s *= 2
    if s < span:
        m = np.minimum(m[:n], m[span - s : span - s + n])
    at = (m[:n] & np.uint64(BLOCK - 1)).astype(np.int64)
    start = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), ends - start)[:n]
    p = np.arange(n)
    ok = p + length <= ends[doc]
    # whole windows' fingerprints, for shifts between neighbouring equal anchors
    new = np.flatnonzero(ok & np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    shift = np.zeros(len(new), np.int64)
    if len(new) > 1:
        a = at[new]
        near = (doc[new[1:]] == doc[new[:-1]]) & (mixed[a[1:]] == mixed[a[:-1]])
        shift[1:] = np.where(near, a[1:] - a[:-1], 0)
    again = np.empty(0, np.int64)
    if shift.any():
        d = np.zeros(n, np.int64)
        d[new[0] :] = np.repeat(shift, np.diff(np.concatenate([new, [n]])))
        q = np.flatnonzero(ok & (d > 0) & (p - d >= start[doc]))
        offs = [*range(0, length - GRAM, GRAM), length - GRAM]

        def whole(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), np.uint64)
            for o in offs:
                out = mix64(out ^ h[x + o])
            return out

        q = q[whole(q) == whole(q - d[q])]
        again = np.unique(np.concatenate([q, q - d[q]]))
        ok[q] = False
    keep = np.flatnonzero(ok)
    if not len(keep):
        return none, none, none, none, again
    cut = np.concatenate([[True], (np.diff(keep) > 1) | (at[keep][1:] != at[keep][:-1]) | (doc[keep][1:] != doc[keep][:-1])])
    first = keep[cut]
    last = keep[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(keep) - 1]])]
    a = at[first]
    return lead[a] << 39 | (mixed[a] >> np.uint64(25)).astype(np.int64), a, first, last, again


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        for b in batches:
            texts = list(blobs(b.column("text")))
            key, pos, own, lo, hi, mine = [], [], [], [], [], []

            def flush(part: list[tuple[int, int, bytes]]) -> None:
                """part: (text number, offset of the piece in its text, piece)."""
                if not part:
                    return
                ends = np.cumsum([len(x) for _, _, x in part])
                k, a, p1, p2, again = scan(np.frombuffer(b"".join(x for _, _, x in part), np.uint8), ends, length)
                number = np.array([t for t, _, _ in part])
                base = np.array([o for _, o, _ in part]) - np.concatenate([[0], ends[:-1]])
                d = np.searchsorted(ends, p1, side="right")
                key.append(k)
                pos.append((a + base[d]) << 16 | (a - p1) << 8 | (a - p2))
                own.append(number[d])
                if len(again):
                    d = np.searchsorted(ends, again, side="right")
                    cut = np.concatenate([[True], (np.diff(again) > 1) | (d[1:] != d[:-1])])
                    end = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(again) - 1]])
                    lo.append(again[cut] + base[d[cut]])
                    hi.append(again[end] + length + base[d[end]])
                    mine.append(number[d[cut]])

            part, size = [], 0
            for t, x in enumerate(texts):
                if len(x) < length:
                    continue
                for o in range(0, len(x) - length + 1, BLOCK - length + 1):
                    piece = x[o : o + BLOCK]
                    if size + len(piece) > BLOCK:
                        flush(part)
                        part, size = [], 0
                    part.append((t, o, piece))
                    size += len(piece)
            flush(part)

            def lists(values: list[np.ndarray], of: list[np.ndarray]) -> pa.Array:
                counts = np.bincount(np.concatenate(of), minlength=len(texts)) if of else np.zeros(len(texts), np.int64)
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(values) if values else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int64)))

            cols = [
                pa.array(np.arange(row, row + len(texts))),
                b.column("doc_id"),
                b.column("h64"),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                lists(key, own),
                lists(pos, own),
                lists(lo, mine),
                lists(hi, mine),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "h64", "n_bytes", "sha", "keys", "positions", "starts", "ends"])

    return run


def _contexts(splitters: np.ndarray, length: int):
    """Rows (row, text, anchors) -> each anchor's windows as bytes, with the bucket that sorts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 128):
                b = big.slice(i, 128)
                rows, keys, poss, ctx = [], [], [], []
                for row, text, anchors in zip(b.column("row").to_pylist(), blobs(b.column("text")), b.column("anchors"), strict=True):
                    v = anchors.values
                    pos = v.field("pos").to_numpy(zero_copy_only=False)
                    first, last = (pos >> 16) - (pos >> 8 & 255), (pos >> 16) - (pos & 255)
                    ctx += [text[x:y] for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)]
                    keys.append(v.field("key").to_numpy(zero_copy_only=False))
                    poss.append(pos)
                    rows.append(np.full(len(pos), row))
                if not ctx:
                    continue
                rows, keys, poss = map(np.concatenate, (rows, keys, poss))
                lo, hi = np.searchsorted(splitters, keys, side="left"), np.searchsorted(splitters, keys, side="right")
                salt = (mix64(rows.astype(np.uint64) ^ poss.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                bucket = lo + np.where(hi > lo, salt % (hi - lo + 1), 0)  # a key that is itself a splitter is dealt over its buckets
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(hi > lo), pa.array(rows), pa.array(poss), pa.array(ctx, pa.binary())], ["bucket", "shared", "row", "pos", "ctx"])

    return run


def multikey_sort(a: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of the rows of a byte matrix whose width is a multiple of 8; digits are 8 bytes.

    Three-way partitions about a median of sampled digits: smaller and larger rows go on with the same digit,
    equal ones with the next. Parts of at most ``small`` rows are sorted digit by digit, ties alone further.
    """
    words = a.view(">u8").astype(np.uint64)
    out, todo = [np.empty(0, np.int64)], [(np.arange(len(words)), 0)]
    while todo:
        own, d = todo.pop()
        if len(own) <= small or d == words.shape[1]:
            out.append(own[_digits_sort(words[own, d:])] if len(own) > 1 and d < words.shape[1] else own)
            continue
        w = words[own, d]
        pivot = np.sort(w[:: max(1, len(w) // 63)])[min(len(w), 63) // 2]
        todo += [(own[w > pivot], d), (own[w == pivot], d + 1), (own[w < pivot], d)]
    return np.concatenate(out)


def _digits_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 8-byte digits: by the first, then each group of equals by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for d in range(1, words.shape[1]):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~tied)[at]
        own = order[at]
        by = np.lexsort((words[own, d], group))
        order[at] = own[by]
        w = words[order[at], d]
        tied[at[1:]] &= (w[1:] == w[:-1]) | (np.diff(at) > 1)
        tied[at[1:]] &= group[1:] == group[:-1]
    return order


def _common(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the row before it; -1 for the first."""
    s = a[order]
    out = np.full(len(s), -1, np.int64)
    for i in range(1, len(s), 8192):
        diff = s[i : i + 8192] != s[i - 1 : min(i + 8191, len(s) - 1)]
        out[i : i + 8192] = np.where(diff.any(axis=1), diff.argmax(axis=1), a.shape[1])
    return out


def repeats(rows: np.ndarray, pos: np.ndarray, ctx: list[bytes], length: int) -> np.ndarray:
    """A flag for each record and offset o (0 to length - GRAM): the window that starts o before the anchor is there twice."""
    n, span = len(pos), length - GRAM + 1
    d1, d2 = (pos >> 8 & 255).astype(np.int64), (pos & 255).astype(np.int64)
    wide = -(-length // 8) * 8
    right, left = np.zeros((n, wide), np.uint8), np.zeros((n, wide), np.uint8)
    at = np.cumsum([0, *map(len, ctx)])
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    own, col = np.repeat(np.arange(n), np.diff(at)), np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    col -= d1[own]
    r = col >= 0
    right[own[r], col[r]] = flat[r]
    left[own[~r], -1 - col[~r]] = flat[~r]
    ro, lo = multikey_sort(right), multikey_sort(left)
    rc, lc = _common(right, ro), _common(left, lo)
    out = np.zeros((n, span), bool)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[ro], rank_l[lo] = np.arange(n), np.arange(n)
    for o in range(span):
        act = np.flatnonzero((d2 <= o) & (o <= d1))
        if len(act) < 2:
            continue
        name = np.cumsum(rc < length - o)[rank_r[act]] * (n + 1) + np.cumsum(lc < o)[rank_l[act]]
        by = np.argsort(name, kind="stable")
        same = np.concatenate([[False], name[by][1:] == name[by][:-1], [False]])
        out[act[by[same[1:] | same[:-1]]], o] = True
    return out


def _bucket(length: int):
    kinds = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.binary()), ("own", pa.bool_())])

    def run(t: pa.Table) -> pa.Table:
        row, pos = t.column("row").to_numpy(), t.column("pos").to_numpy()
        _, pick = np.unique(np.stack([row, pos]), axis=1, return_index=True)  # repeated input rows bring the same record twice
        t, row, pos = t.take(pa.array(pick)), row[pick], pos[pick]
        ctx, shared = t.column("ctx").to_pylist(), t.column("shared").to_numpy()
        found = repeats(row, pos, ctx, length)
        # windows in text order: offset descending
        r, c = _runs(np.pad(found[:, ::-1], ((0, 0), (0, 1))).ravel())
        wide = found.shape[1] + 1
        k = r // wide
        start = (pos[k] >> 16) - (found.shape[1] - 1) + r % wide
        out = [row[k], start, start + (c - r) - 1 + length]
        names: list[tuple] = []
        said: set[bytes] = set()
        for k in np.flatnonzero(shared).tolist():  # dealt over several buckets: compare across them by whole windows
            a, d1, d2 = int(pos[k]) >> 16, int(pos[k]) >> 8 & 255, int(pos[k]) & 255
            for o in range(d2, d1 + 1):
                x = xxhash.xxh3_128_digest(ctx[k][d1 - o : d1 - o + length])
                if not found[k, o]:
                    names.append((int(row[k]), a - o, a - o + length, x, True))
                elif x not in said:
                    said.add(x)
                    names.append((int(row[k]), a - o, a - o + length, x, False))
        cols = [pa.array(np.concatenate([v, np.array([x[i] for x in names], np.int64)])) for i, v in enumerate(out)]
        n = len(out[0])
        return pa.Table.from_arrays([*cols, pa.array([None] * n + [x[3] for x in names], pa.binary()), pa.array([False] * n + [x[4] for x in names], pa.bool_())], schema=kinds)

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        if out and starts[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(ends[i]))
        else:
            out.append([int(starts[i]), int(ends[i])])
    return [(x, y) for x, y in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for text, spans in zip(blobs(b.column("text")), b.column("spans"), strict=True):
            v = spans.values
            m = merged(v.field("start").to_numpy(zero_copy_only=False), v.field("end").to_numpy(zero_copy_only=False))
            at = [0, *(x for s in m for x in s), len(text)]
            kept = b"".join(text[at[i] : at[i + 1]] for i in range(0, len(at), 2))
            rows.append(([{"start": x, "end": y} for x, y in m], kept))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())], ["row", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, sha256 (of the whole), spans (removed runs), kept (remaining bytes; null: all), h64.

    A row for each row; h64 is Spark's xxhash64 of the text, nulls as empty. Null, empty and
    short texts lose nothing. A text of ``length`` bytes or more that comes twice (with the same
    doc_id or another) goes as a whole. Extra columns are ignored. An empty table gives an empty
    result. ``length``: 40 to 280 bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h64", F.xxhash64("text"))
    longs = "array<bigint>"
    base = written(docs.mapInArrow(_anchors(length), f"row long, doc_id long, h64 long, n_bytes long, sha binary, keys {longs}, positions {longs}, starts {longs}, ends {longs}"), "anchors", compression="zstd")
    texts = written(base.groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("n_bytes").alias("n_bytes")), "texts")
    anchors = base.select("row", F.explode(F.arrays_zip("keys", "positions")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.positions").alias("pos"))
    twice = written(anchors.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "twice", compression="zstd")
    found = written(join_hot(anchors, twice, "key", "m", "row").drop("m"), "found", compression="zstd")
    cand = written(found.join(texts.select("row"), "row", "left_semi"), "candidates", compression="zstd")
    n = cand.count()
    kinds = "row long, start long, end long, name binary, own boolean"
    if n:
        buckets = -(-n // bucket)
        # in proportion to the buckets, so that they keep their size: 128 bytes for every 40,000 records
        sample = cand.sample(min(1.0, max(SAMPLE, SAMPLE_A_BUCKET * buckets) / n), seed=3).select("key").toPandas()["key"].to_numpy()
        sample.sort()
        splitters = sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else sample
        lists = cand.groupBy("row").agg(F.collect_list(F.struct("key", "pos")).alias("anchors"))
        ids = base.select("row", "h64", F.col("doc_id").alias("id")).join(lists, "row")
        joined = written(docs.join(ids, (docs.h64 == ids.h64) & docs.doc_id.eqNullSafe(ids.id)).select("row", "text", "anchors"), "joined", compression="zstd")
        contexts = joined.mapInArrow(_contexts(splitters, length), "bucket long, shared boolean, row long, pos long, ctx binary")
        marks = written(contexts.groupBy("bucket").applyInArrow(_bucket(length), kinds), "marks", compression="zstd")
        over = marks.where("name is not null")
        names = over.groupBy("name").agg(F.count("*").alias("m")).where("m > 1").select("name")
        across = over.where("own").join(names, "name").select("row", "start", "end")
        marks = marks.where("name is null").select("row", "start", "end").unionByName(across)
    else:
        marks = spark.createDataFrame([], "row long, start long, end long")
    near = base.select("row", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("row", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"))
    # copies lose everything; others what is marked
    state = base.join(texts.select(F.col("sha").alias("tsha"), "copies"), F.col("sha") == F.col("tsha")).select("row", "doc_id", "h64", "n_bytes", "sha", ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("whole"))
    state = written(state, "state")
    spans = marks.unionByName(near).join(state.where("not whole").select("row"), "row", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans", compression="zstd")
    ids = spans.join(state.select("row", "h64", F.col("doc_id").alias("id")), "row")
    need = docs.join(ids, (docs.h64 == ids.h64) & docs.doc_id.eqNullSafe(ids.id)).select("row", "text", "spans")
    cut = need.mapInArrow(_cut, "row long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    out = state.join(cut, "row", "left")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id",
        "n_bytes",
        "sha",
        F.when(F.col("whole"), all_of).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        "h64",
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    sha = F.when(F.col("kept").isNull(), F.lower(F.hex("sha"))).otherwise(F.sha2("kept", 256))
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha.alias("kept_sha256"))
