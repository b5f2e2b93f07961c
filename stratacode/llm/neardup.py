"""MinHash near-duplicates by a chosen-path set similarity join.

Texts with one shingle set are one *class*, named by a number (rep below) in order of its smallest
doc_id and its fingerprint. Every class gets 64 minwise tokens. A tree's node picks two token positions; a class goes to the child
named by its token at each of them (no position twice on one path), so that two classes of similarity J stay together below
some child with chance 1 - (1 - J)^2 or more at every level (0.96 at 0.8), and in one of
``trees`` independent trees almost surely (four trees: all but 3 in a million). Small nodes are
compared exhaustively, each by one group function that returns members and then a forest of
links, never its pairs: a dense group just below the threshold makes no more rows than it has
members. In any node, members are first compared with its smallest
class, so a group of thousands of near copies joins as a star, and only members of *different*
components are compared or branched further. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blobs, drop, join_hot, mix64, new_path, no_shuffle_left, shingles, table, word_hashes, written
from .components import components

TOKENS = 64
#: Agreement among the 64 tokens below which a pair isn't confirmed on full sets: 0.8 less 5 standard deviations.
SKETCH_AT_LEAST = 0.55
_SEEDS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix64(_SEEDS) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The 64 minwise tokens (uint32) of a shingle set."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, i : i + 4096] ^ _SEEDS[:, None]) * _ODD[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            n, fp, sig = [], [], []
            for text in blobs(b.column("text")):
                s = shingles(word_hashes(text.lower().split(), memo), words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h64"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "h64", "n_shingles", "fp", "sig"])

    return run


def _hash_lists(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            sets = [shingles(word_hashes(text.lower().split(), memo), words).view(np.int64) for text in blobs(b.column("text"))]
            right = [xxhash.xxh3_128_digest(s.tobytes()) == fp.as_py() for s, fp in zip(sets, b.column("fp"), strict=True)]
            sets = [s for s, ok in zip(sets, right, strict=True) if ok]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rep").filter(pa.array(right, pa.bool_())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["rep", "hashes"])

    return run


def _children(first: bool, trees: int):
    """Rows (node, rep, sig, n, used) -> two children a row; at the root, two for each tree.

    ``used`` has a bit for each token position that the path to the node has branched on; none is picked again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in b.column("sig")), np.uint32).reshape(-1, TOKENS)
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            rows = np.arange(len(rep))
            nodes, picks, used = [], [], np.zeros(len(rep), np.uint64)
            if first:  # distinct positions for all trees' roots
                for k in range(2 * trees):
                    nodes.append(np.full(len(rep), k + 1, np.uint64))
                    picks.append(np.full(len(rep), k % TOKENS))
            else:
                node = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                used = b.column("used").to_numpy(zero_copy_only=False).view(np.uint64)
                nodes, picks = [node, node], _unused(node, used)
            kids = [mix64(mix64(v + np.uint64(0x632BE5AB)) ^ mix64((p.astype(np.uint64) << np.uint64(32)) | sig[rows, p])) for v, p in zip(nodes, picks, strict=True)]
            k = len(kids)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kids).view(np.int64)), pa.array(np.tile(rep, k)), pa.array(np.tile(n, k)), pa.array(np.concatenate([used | np.uint64(1) << p.astype(np.uint64) for p in picks]).view(np.int64))], ["node", "rep", "n", "used"])

    return run


def _unused(node: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
    """Two positions for each node, in an order of its own, that its path has not branched on (while two are left)."""
    at = (mix64(node ^ np.uint64(0xA5A5)) % np.uint64(TOKENS)).astype(np.int64)
    step = (mix64(node ^ np.uint64(0x5A5A)) % np.uint64(TOKENS // 2)).astype(np.int64) * 2 + 1
    picks = [at, (at + step) % TOKENS]
    found = np.zeros(len(node), np.int64)
    for _ in range(TOKENS):
        free = (used >> at.astype(np.uint64) & np.uint64(1)) == 0
        for k in (0, 1):
            picks[k] = np.where(free & (found == k), at, picks[k])
        found += free
        if (found > 1).all():
            break
        at = (at + step) % TOKENS
    return picks


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose tokens agree often enough to be worth a look at the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint32).reshape(-1, TOKENS) for c in ("sa", "sb"))
                same = (x == y).mean(axis=1)
                keep = same >= SKETCH_AT_LEAST
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(same[keep])], ["a", "b", "same"])

    p = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return p.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same double")


def _likely(sig: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a node the later ones of other components that may be similar by set size and tokens."""
    columns = np.ascontiguousarray(sig.T)
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        js = np.flatnonzero((label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))) + i + 1
        if len(js):
            same = (columns[:, js] == columns[:, i, None]).sum(axis=0)
            js = js[same >= SKETCH_AT_LEAST * TOKENS]
            if len(js):
                yield i, js


def _members(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(x.as_py() for x in t.column("sig")), np.uint32).reshape(-1, TOKENS)
    return sig, t.column("n").to_numpy(), t.column("label").to_numpy()


def _survivors(percent: int):
    """A node's rows -> those that have a likely partner in it."""

    def run(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, bool)
        for i, js in _likely(*_members(t), percent):
            keep[i] = True
            keep[js] = True
        return t.filter(pa.array(keep))

    return run


def _forest(percent: int):
    """A node's rows with full sets -> links (a, b) on full sets that join all its linked components."""

    def run(t: pa.Table) -> pa.Table:
        sig, n, label = _members(t)
        rep, now, links = t.column("rep").to_numpy(), label.copy(), []
        lists = t.column("hashes").combine_chunks()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        uniq, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(uniq), np.int32)
        for i, js in _likely(sig, n, label, percent):
            js = js[now[js] != now[i]]
            if not len(js):
                continue
            own = flat[at[i] : at[i + 1]]
            mark[own] = 1
            if 4 * len(js) < len(n):
                inter = np.array([mark[flat[at[j] : at[j + 1]]].sum() for j in js])
            else:
                inter = np.add.reduceat(mark[flat], at[:-1])[js]
            mark[own] = 0
            for j in js[100 * inter >= percent * (n[js] + n[i] - inter)]:
                if now[j] != now[i]:
                    now[now == now[j]] = now[i]
                    links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 4, leaf: int = 4096, leaf_shingles: int = 4_000_000, most_levels: int = 12, with_hash: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, class_id, and h64 if asked for; a row for each row.

    words, percent: shingle length and the similarity (in percent) from which two sets are linked.
    trees: independent trees (recall). leaf, leaf_shingles: nodes with so many members and so many
    shingles in all at most are compared exhaustively, each in one task; so are, pair by pair, larger
    ones with at most 8 pairs a member across components; others branch. most_levels: nodes still
    mixed so deep are cut into blocks, and every two blocks compared exhaustively, in a task each.

    Null, empty or blank text: 0 shingles, linked with nothing. Repeated rows: linked as copies.
    Every text of a doc_id that comes with several is compared with all others; the texts of one doc_id
    are not linked for that. Rows with a null doc_id take part as well. component_id and class_id: the
    smallest doc_id in it, null if no row has one. kept: true for exactly one row of each component, the
    first by doc_id (nulls last), fingerprint and position, and for every row without shingles. h64: Spark's
    xxhash64 of the text. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h64", F.xxhash64("text"))
    base = written(docs.mapInArrow(_sets(words), "doc_id long, h64 long, n_shingles long, fp binary, sig binary"), "sets")
    # a class is read from one text of its smallest doc_id; numbers follow (doc_id, fingerprint), nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h64")).alias("first")
    found = base.where("fp is not null").groupBy("fp").agg(first, F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    found = found.select("fp", F.col("first.no_id").alias("no_id"), F.col("first.doc_id").alias("doc_id"), F.col("first.h64").alias("h64"), "n", "sig")
    order = ["no_id", "doc_id", "fp"]
    sigs = written(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id()), "sigs")
    classes = sigs.select("fp", "rep", "doc_id")

    # texts of the classes, bucketed once: later joins with some of them move no text
    spark, by_rep = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    of = sigs.select("rep", "fp", F.col("doc_id").alias("id"), F.col("h64").alias("h"))
    texts = docs.join(of, (F.col("h64") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", "text", "fp").repartition(buckets, "rep")
    kept_at = new_path(spark, "texts")
    with no_shuffle_left(spark):
        texts.write.bucketBy(buckets, "rep").option("path", kept_at).option("compression", "zstd").format("parquet").saveAsTable(by_rep)

    def sized(n: DataFrame) -> DataFrame:
        """Nodes with two members or more, with their smallest member and its set size."""
        n = written(n, "children")
        by = n.groupBy("node").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("low")).where("m > 1")
        by = written(by.select("node", "m", F.col("low.rep").alias("pivot"), F.col("low.n").alias("pivot_n")), "by")
        out = written(join_hot(n, by, "node", "m", "rep"), "nodes")
        for x in (n, by):
            drop(x)
        return out

    def blocked(members: DataFrame) -> DataFrame:
        """Members of large nodes, once for each pair of blocks of their node that their own is in, as small nodes."""
        blocks = F.ceil(F.greatest(F.col("members") / F.lit(leaf / 2), F.col("shingles") / F.lit(leaf_shingles / 2))).cast("long")
        own = members.withColumn("blocks", blocks).withColumn("own", F.expr("pmod(xxhash64(rep), blocks)"))
        pairs = own.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        return pairs.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")

    def similar_size(x: str, y: str) -> str:
        return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"

    def candidates(pairs: DataFrame) -> DataFrame:
        return written(_agreeing(pairs.distinct(), sigs), "pairs")

    def full_sets(reps: DataFrame) -> DataFrame:
        texts = spark.table(by_rep).join(reps.distinct(), "rep").select("rep", "text", "fp")
        # a repeated row gives its set once
        return written(texts.mapInArrow(_hash_lists(words), "rep long, hashes array<long>").dropDuplicates(["rep"]), "hashes")

    def exhausted(members: DataFrame) -> DataFrame:
        """Links that join the components of each small node. Only members with a likely partner meet on full sets."""
        kind = "node long, rep long, n long, label long, sig binary"
        rows = members.select("node", "rep", "n", "label").join(sigs.select("rep", "sig"), "rep").select("node", "rep", "n", "label", "sig")
        likely = written(rows.groupBy("node").applyInArrow(_survivors(percent), kind), "likely")
        sets = full_sets(likely.select("rep"))
        found = written(likely.join(sets, "rep").groupBy("node").applyInArrow(_forest(percent), "a long, b long").distinct(), "links")
        for x in (likely, sets):
            drop(x)
        return found

    def confirm(pairs: DataFrame) -> DataFrame:
        """Only links whose full sets are similar. Sets are computed for the classes involved alone."""
        sets = full_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))))
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
        inter = F.size(F.array_intersect("ha", "hb"))
        links = written(both.where(100 * inter >= percent * (F.size("ha") + F.size("hb") - inter)).select("a", "b"), "links")
        drop(sets)
        return links

    def labelled(n: DataFrame, labels: DataFrame) -> DataFrame:
        return n.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def searched() -> DataFrame:
        """The smallest class of each class that is linked with another: (node, label)."""
        nodes = sized(sigs.select(F.lit(0).cast("long").alias("node"), "rep", "n", "sig").mapInArrow(_children(True, trees), "node long, rep long, n long, used long"))
        links, labels, level = None, None, 1
        while True:
            # a star: each class with the smallest of the nodes it is in that looks most like it
            apart = nodes.where(f"rep <> pivot and {similar_size('n', 'pivot_n')}").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
            if labels is not None:  # links already found join most of them
                of = labels.select("node", "label")
                apart = apart.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
                apart = apart.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
            stars = candidates(apart)
            best = stars.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
            found = confirm(written(best, "best"))
            fresh = labels is None or not is_none(found)
            links = found if links is None else links.unionByName(found)
            if fresh:
                labels = components(links)
            # then what the stars left apart: nodes that hold several components
            seen = written(labelled(nodes, labels), "seen")
            by = seen.groupBy("node", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
            by = by.groupBy("node").agg(F.sum("s").alias("shingles"), F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("label", F.struct("c", "label")).alias("main"))
            easy = F.expr(f"members <= {leaf} and shingles <= {leaf_shingles}")
            mixed = by.where("squares < members * members").select("node", "main", "members", "shingles", easy.alias("easy"), (~easy & F.expr("(members * members - squares) / 2 <= 8 * members")).alias("few"))
            mixed = written(mixed, "mixed")
            open_ = written(join_hot(seen, mixed, "node", "members", "rep"), "open")
            last = level >= most_levels
            alone = open_.where("easy")
            found = exhausted(alone.unionByName(blocked(open_.where("not easy and not few"))) if last else alone)
            links = links.unionByName(found)
            # few pairs across components: compare them all, each member outside the largest component with all others
            small = open_.where("few")
            minor = small.where("label <> main").select("node", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"))
            every = small.select("node", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), "main")
            pairs = minor.join(every, "node").where(f"lx <> ly and (ly = main or x < y) and {similar_size('nx', 'ny')}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            if not is_none(small):
                more = confirm(candidates(pairs))
                links, found = links.unionByName(more), found.unionByName(more)
            if not is_none(found):
                labels = components(links)
            large = open_.where("not easy and not few")
            for x in (stars, nodes, seen, mixed):
                drop(x)
            if last or is_none(large):
                break
            nodes = sized(large.select("node", "rep", "n", "used").join(sigs.select("rep", "sig"), "rep").mapInArrow(_children(False, trees), "node long, rep long, n long, used long").distinct())
            level += 1
        return labels

    try:
        labels = searched()
    finally:
        drop(spark.table(by_rep))
        spark.sql(f"DROP TABLE {by_rep}")
    named = written(classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("fp", F.col("doc_id").alias("class_id"), F.coalesce("label", "rep").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = written(named.join(smallest, "label"), "components")
    rows = base.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "h64", "n_shingles", "fp").join(named, "fp", "left")
    rows = written(rows, "rows", compression="zstd")
    # one row of each component: a partial aggregate, then a join on single rows
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "row"))["row"]
    stays = rows.where("fp is not null").groupBy("label").agg(best.alias("row")).select("row", F.lit(True).alias("stays"))
    out, blank = rows.join(stays, "row", "left"), F.col("fp").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (blank | F.col("stays").isNotNull()).alias("kept"),
        F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        *(["h64"] if with_hash else []),
    )


def is_none(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles at 80 % over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
