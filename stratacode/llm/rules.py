"""Quality rules: plain text statistics with fixed limits, then an isolation forest over them.

A forest of random axis-parallel splits isolates unusual documents after few splits; its score
2^(-path / expected path) is compared with a threshold calibrated on labelled rows: the lowest
that rejects at most GOOD_LOSS of the good ones, among rows that pass the fixed limits. All
labelled rows take part, on the executors: trees draw their rows from all of them, and thresholds
and shares are counted over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHash, blobs, table, windows, word_hashes, written
from .quality import one_label

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
#: Forest size, rows that a tree draws, and the share of good rows that may be lost.
TREES, TREE_ROWS, GOOD_LOSS = 100, 256, 0.002
#: Labelled rows of a shard in which they are numbered, of a task that scores them, and bins of a round of order_statistics.
SHARD_ROWS, TASK_ROWS, BINS = 4_000, 5_000, 1024
#: Widenings of a node's range, in standard deviations, among which the labelled rows choose; a good row lost weighs as ten bad ones kept.
MARGINS, GOOD_WEIGHT = (0.5, 1.0, 2.0, 4.0), 10
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_short_words")


def statistics(text: bytes, memo: WordHash) -> tuple[int, ...]:
    """The counts named in STATS for a whole UTF-8 text."""
    words = text.split()
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    chars = len(text) - points - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = word_hashes(words, memo)
    repeated = 0
    if len(h) > 5:
        w = windows(h, 5)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(len(h) + 1, np.int32)
        hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        if len(hit):
            twice[hit] += 1
            np.subtract.at(twice, hit + 5, 1)
            repeated = int((np.cumsum(twice)[:-1] > 0).sum())
    short = sum(len(x) < 2 for x in words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), short


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])


def features(s: np.ndarray) -> np.ndarray:
    s = s.astype(float)
    n = np.maximum(s[:, 0], 1)
    # square roots spread small shares; lengths on their own say little about quality and are left out
    return np.column_stack([np.sqrt(s[:, 2] / n), np.sqrt(s[:, 3] / np.maximum(s[:, 5], 1)), np.sqrt(s[:, 4] / n), s[:, 1] / n, np.sqrt(s[:, 7] / n), np.log(s[:, 6]).clip(0) / np.log(n + 1).clip(0.7)])


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: feature (-1 at leaves), cut, left child, path length at leaves.

    Cuts are drawn from a node's own range widened by ``margin`` on either side, so that a
    value outside what the trees were grown on ends in an empty leaf after few splits, even
    where a statistic is constant among the rows they were grown on. Where there are enough rows, no two trees share one.
    """

    def __init__(self, x: np.ndarray, margin: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(rows, len(x))
        depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = []
        dealt = rng.permutation(len(x)) if len(x) >= trees * rows else None
        for tree in range(trees):
            feature, cut, left, path = [], [], [], []
            todo = [(rng.choice(len(x), self.size, replace=False) if dealt is None else dealt[tree * rows : (tree + 1) * rows], 0)]
            k = 0
            while k < len(todo):
                own, d = todo[k]
                k += 1
                part = x[own]
                lo, hi = (part.min(0) - margin, part.max(0) + margin) if len(own) > 1 else (margin, margin)
                free = np.flatnonzero(hi > lo)
                if d >= depth or not len(free):
                    feature.append(-1), cut.append(0.0), left.append(0), path.append(d + float(_expected_path(len(own))))
                    continue
                f = int(rng.choice(free))
                c = float(rng.uniform(lo[f], hi[f]))
                feature.append(f), cut.append(c), left.append(len(todo)), path.append(0.0)
                todo += [(own[part[:, f] < c], d + 1), (own[part[:, f] >= c], d + 1)]
            self.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
        self.depth = depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0.5 for an average row, towards 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, f] >= cut[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_expected_path(self.size)), 1e-9))


class Rules:
    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def judge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base_failed, kept) for rows of STATS."""
        failed = base_failed(s)
        if self.forest is None or not len(s):
            return failed, ~failed
        return failed, ~failed & (self.forest.scores(features(s)) <= self.threshold)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id and the counts of STATS of whole texts; a row for each row. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            s = np.array([statistics(t, memo) for t in blobs(b.column("text"))], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def _counts(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy() for c in STATS])


def order_statistics(values: DataFrame, at: dict[str, int]) -> dict[str, float]:
    """(name, value) -> of each name the value that has ``at`` values before it in order: exact, by counts in ever narrower bins."""
    of = lambda x: F.element_at(F.create_map(*(F.lit(y) for kv in x.items() for y in kv)), F.col("name"))
    found, left, lo, hi = {}, dict(at), {}, {}
    while left:
        if lo:
            values_in = values.where(F.col("name").isin(list(left))).where((F.col("value") >= of(lo)) & (F.col("value") <= of(hi)))
            spot = F.floor((F.col("value") - of(lo)) / (of(hi) - of(lo)) * BINS)
        else:
            values_in, spot = values.where(F.col("name").isin(list(left))), F.floor(F.col("value") * BINS)
        got = values_in.groupBy("name", spot.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).collect()
        lo, hi = {}, {}
        for name in list(left):
            for r in sorted((r for r in got if r.name == name), key=lambda r: r.bin):
                if left[name] < r.n:
                    break
                left[name] -= r.n
            if r.least == r.most:
                found[name] = r.least
                del left[name]
            else:
                lo[name], hi[name] = r.least, r.most
    return found


def _spread(rows: DataFrame) -> np.ndarray:
    """Standard deviations of the features over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = features(_counts(b))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.mean(0).tolist()]), pa.array([((x - x.mean(0)) ** 2).sum(0).tolist()])], ["n", "mean", "m2"])

    nth = rows.mapInArrow(run, "n long, mean array<double>, m2 array<double>").select("n", F.posexplode(F.arrays_zip("mean", "m2")).alias("f", "x"))
    whole = nth.groupBy("f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x.mean")).alias("s"))
    apart = nth.join(whole.select("f", (F.col("s") / F.col("n")).alias("centre")), "f").groupBy("f")
    got = apart.agg(F.sqrt(F.sum(F.col("x.m2") + F.col("n") * (F.col("x.mean") - F.col("centre")) ** 2) / F.sum("n")).alias("sd")).orderBy("f").collect()
    return np.array([float(f"{r.sd:.9g}") for r in got])  # sums of doubles differ in their last digits with the order of tasks


def _scored(rows: DataFrame, n: int, forests: list[Forest], third: list[int | None]) -> DataFrame:
    """quality, part, and s0, s1, ...: scores by each forest, null for good rows of the third that it was grown on."""
    names = [f"s{k}" for k in range(len(forests))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, part = features(_counts(b)), b.column("part").to_numpy()
            out = []
            for forest, own in zip(forests, third, strict=True):
                need = np.ones(len(x), bool) if own is None else (part < 0) | (part % 3 != own)
                s = np.full(len(x), np.nan)
                s[need] = forest.scores(x[need])
                out.append(pa.array(s, mask=~need))
            yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("part"), *out], ["quality", "part", *names])

    return written(rows.repartition(n // TASK_ROWS + 1, "h").mapInArrow(run, "quality int, part int, " + ", ".join(f"{x} double" for x in names)), "rule-scores")


def _limit(n: int) -> int:
    """The position, among n good rows in order of score, of the score that all but GOOD_LOSS of them stay below."""
    return min(n - 1, int(np.ceil(n * (1 - GOOD_LOSS))))


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    """Fit on all labelled rows: trees on one half of the good ones, their threshold on the other.

    How far cuts may lie outside a node is chosen by three-fold cross-validation: forests on a third of the good rows, thresholds
    on another, good rows judged on the last. Every tree draws its TREE_ROWS from all rows of its half or third.

    Without good and bad rows that pass the limits (in an empty table, say), the forest rejects nothing. Rows with a null label
    or doc_id don't count, nor do those of a doc_id with labels of both classes; rows that repeat a doc_id count each. Extra columns are ignored.
    """
    return fit_counts(written(counted(docs), "rule-counts"), labels)


def fit_counts(counts: DataFrame, labels: DataFrame) -> Rules:
    """:func:`fit` on what :func:`counted` returns. The driver gets counts, and the rows that trees draw."""
    own = counts.join(one_label(labels), "doc_id").where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    own = written(own.select("quality", F.xxhash64(F.lit(5), "doc_id", *STATS).alias("h"), *STATS), "rule-labelled")
    n = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if n.get(1, 0) < 8 or not n.get(0):
        return Rules(None, 1.0)
    # good rows in six equal parts: numbered within shards, by hash
    good = own.where("quality = 1").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(-(-n[1] // SHARD_ROWS))))
    nth = F.row_number().over(W.partitionBy("shard").orderBy("h", *STATS)) - 1
    good = good.withColumn("part", (nth % 6).cast("int")).drop("shard")
    rows = written(good.unionByName(own.where("quality = 0").withColumn("part", F.lit(-1))), "rule-rows")
    per = rows.groupBy("part").agg(F.count("*").alias("n")).collect()
    size = lambda of: sum(r.n for r in per if r.part >= 0 and of(r.part))

    # what trees draw from: rows by another hash, enough that no two trees of a forest share one
    at, share = F.pmod(F.xxhash64(F.lit(6), "h"), F.lit(1 << 40)), 3.6 * TREES * TREE_ROWS / n[1]
    pool = rows.where("part >= 0").withColumn("at", at).where(F.col("at") <= int(min(1.0, share) * (1 << 40))).toArrow()
    pool = pool.sort_by([(c, "ascending") for c in ("at", "h", *STATS)])
    x, part = features(_counts(pool)), pool.column("part").to_numpy()
    draw = lambda mask: x[mask][: TREES * TREE_ROWS]
    spread = _spread(rows)
    models = [(k, m) for m in range(len(MARGINS)) for k in range(3)]
    scored = _scored(rows, n[1] + n[0], [Forest(draw(part % 3 == k), MARGINS[m] * spread) for k, m in models], [k for k, _ in models])
    names = [f"s{i}" for i in range(len(models))]
    by = F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.lit((k - 1) % 3).alias("third"), F.col(s).alias("value")) for s, (k, _) in zip(names, models, strict=True)))).alias("m")
    values = scored.where("quality = 1").select("part", by).where("part % 3 = m.third").select("m.name", "m.value")
    limits = order_statistics(values, {s: _limit(size(lambda p, k=k: p % 3 == (k - 1) % 3)) for s, (k, _) in zip(names, models, strict=True)})
    lost = [F.count_if((F.col("quality") == 1) & (F.col("part") % 3 == (k - 2) % 3) & (F.col(s) > limits[s])).alias(f"good_{s}") for s, (k, _) in zip(names, models, strict=True)]
    rejected = scored.agg(*lost, *(F.count_if((F.col("quality") == 0) & (F.col(s) > limits[s])).alias(f"bad_{s}") for s in names)).first()
    worth = [0.0] * len(MARGINS)
    for s, (k, m) in zip(names, models, strict=True):
        worth[m] += rejected[f"bad_{s}"] / n[0] - GOOD_WEIGHT * rejected[f"good_{s}"] / size(lambda p, k=k: p % 3 == (k - 2) % 3)

    forest = Forest(draw(part % 2 == 0), MARGINS[worth.index(max(worth))] * spread)
    values = _scored(rows.where("part % 2 = 1"), n[1], [forest], [None]).select(F.lit("s0").alias("name"), F.col("s0").alias("value"))
    return Rules(forest, order_statistics(values, {"s0": _limit(size(lambda p: p % 2 == 1))})["s0"])


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, the counts of STATS, base_failed, kept; a row for each row, repeats and null ids included.

    Whole texts are counted, of any length; null text has no words. Extra columns are ignored and an empty table gives an empty result.
    """
    return judge_counts(counted(docs), rules)


def judge_counts(counts: DataFrame, rules: Rules) -> DataFrame:
    """:func:`judge` on what :func:`counted` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            failed, kept = rules.judge(_counts(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(kept)], [*b.schema.names, "base_failed", "kept"])

    return counts.mapInArrow(run, ", ".join(f"{c} long" for c in counts.columns) + ", base_failed boolean, kept boolean")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    counts = written(counted(table(spark, sf_dir, "documents").select("doc_id", "text")), "rule-counts")
    out = judge_counts(counts, fit_counts(counts, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
