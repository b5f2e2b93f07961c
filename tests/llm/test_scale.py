"""Hot keys, deep branching, sorting, sharding and odd rows of the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratacode.llm import common, media, mixing, neardup, packing, quality, rules, sentencepiece, suffixes, warc

from .test_operators import brute_components, brute_repeats, words


def test_join_hot_loses_nothing(spark):
    rows = spark.range(5000).select(F.col("id").alias("rep"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("node"))
    by = common.written(rows.groupBy("node").agg(F.count("*").alias("m")), "by")
    got = common.join_hot(rows, by, "node", "m", "rep")
    assert got.columns == ["node", "rep", "m"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(by, "node").collect()))


def test_a_shared_folder_is_demanded_of_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(session)


def test_no_position_is_branched_on_twice():
    rng = np.random.default_rng(3)
    node, used = rng.integers(0, 1 << 63, 500).astype(np.uint64), np.zeros(500, np.uint64)
    for _ in range(30):
        one, two = neardup._unused(node, used)
        assert (one != two).all()
        for p in (one, two):
            assert not (used >> p.astype(np.uint64) & np.uint64(1)).any()
        used |= np.uint64(1) << one.astype(np.uint64)
        node = common.mix64(node)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_dense_groups_by_level(spark, levels):
    """A group of texts just under and over the limit that branching can't split: the last level compares blocks; no link is lost."""
    rng = random.Random(levels)
    base, texts = words(rng, 60).split(), {}
    for i in range(1, 61):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([1, 3, 6])):
            w[k] = f"own{i}x{k}"
        texts[i] = " ".join(w)
    for i in range(61, 90):
        texts[i] = words(rng, 30)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, words=2, leaf=4, most_levels=levels).collect()}
    assert got == brute_components(texts, 2)


@pytest.mark.parametrize("small", [1, 8, 4096])
def test_multikey_sort(small):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (3000, 24)).astype(np.uint8)
    a[:, :14] = 1
    a[1000:2000] = a[5]
    order = suffixes.multikey_sort(a, small)
    rows = [r.tobytes() for r in a]
    assert sorted(order.tolist()) == list(range(len(a))) and [rows[i] for i in order] == sorted(rows)
    assert len(suffixes.multikey_sort(a[:0], small)) == 0


def test_repeats_with_a_very_common_passage(spark):
    rng = random.Random(6)
    common_part = words(rng, 60)
    texts = [f"{words(rng, 20)} {common_part} {words(rng, 20)}" if i % 3 else words(rng, 60) for i in range(90)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(brute_repeats([t.encode() for t in texts], 200))
    for r in suffixes.remove_repeats(d, bucket=16).collect():
        assert (texts[r.doc_id].encode() if r.kept is None else bytes(r.kept)) == want[r.doc_id]


def level_targets(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """Shares by weight, capped, the excess dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix_against_a_word_by_word_reader(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)] + [(200, "same row", "a")] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    hashes = {(r.doc_id, r.text): r.h for r in d.select("doc_id", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = level_targets(sizes)
    want = []
    for s, target in targets.items():
        own = sorted((hashes[i, t], i, len(t.split())) for i, t, x in rows if x == s)
        taken, left = [0] * len(own), int(target + 1e-6)
        while left:
            for k, (_, _, n) in enumerate(own):
                take = min(n, left)
                taken[k] += take
                left -= take
        want += [(i, n, s, sizes[s], t) for (_, i, n), t in zip(own, taken, strict=True)]
    assert Counter((r.doc_id, r.size, r.source, r.source_size, r.taken) for r in got) == Counter(want)
    assert all(r.target == pytest.approx(targets[r.source]) for r in got)


@pytest.mark.parametrize("long_slots", [mixing.LONG_SLOTS, 10])
def test_mix_interleaves_sources_slot_by_slot(spark, monkeypatch, long_slots):
    monkeypatch.setattr(mixing, "LONG_SLOTS", long_slots)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)] + [(300, "one", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = {s: int(t + 1e-6) for s, t in level_targets(sizes).items()}
    number = {s: -(-goal[s] // 8) for s in ranked}
    n, first, slots_of = sum(number.values()), 0, {}
    for s in ranked:
        slots_of[s] = sorted(p * mixing.golden_step(n) % n for p in range(first, first + number[s]))
        first += number[s]
    assert sorted(x for own in slots_of.values() for x in own) == list(range(n))
    for own in slots_of.values():  # every stretch from the start holds the source's share, within a few slots
        assert all(abs(k - x * len(own) / n) < 4 for k, x in enumerate(own))
    hashes = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    want = {}
    for s, own in slots_of.items():
        at = 0
        for _, i, k in sorted((hashes[i], i, len(t.split())) for i, t, x in rows if x == s):
            want[i] = own[at // 8] if k and at < goal[s] else None
            at += k
    got = mixing.mix(d, block=8).collect()
    assert {r.doc_id: r.first_slot for r in got} == want
    assert {s: sum(r.taken for r in got if r.source == s) for s in sizes} == goal


def test_rules_are_fitted_on_all_labelled_rows(spark, monkeypatch):
    """More than 6,000 good rows, all of which are scored: the threshold is an order statistic of half of them, not of a bounded sample."""
    rng = random.Random(13)
    rows = [(i, " ".join(("#" if rng.random() < i % 40 / 100 else "") + w for w in words(rng, 40).split())) for i in range(7000)]
    d = spark.createDataFrame([(i, t + (" %%%" * 6 if i % 50 == 0 else "")) for i, t in rows], "doc_id long, text string").repartition(5)
    y = spark.createDataFrame([(i, int(i % 50 > 0)) for i in range(7000)], "doc_id long, quality int")
    monkeypatch.setattr(rules, "SHARD_ROWS", 1000)
    monkeypatch.setattr(rules, "TASK_ROWS", 2000)
    seen = []
    scored = rules._scored
    monkeypatch.setattr(rules, "_scored", lambda *a: seen.append(scored(*a)) or seen[-1])
    counts = common.written(rules.counted(d), "counts")
    r = rules.fit_counts(counts, y)
    memo = rules.WordHash()
    stats = {i: rules.statistics(x.encode(), memo) for i, x in d.collect()}
    good = [i for i in stats if i % 50 and not rules.base_failed(np.array([stats[i]]))[0]]
    first, last = (x.count() for x in seen)
    assert len(good) > 6000 and first == 7000 - sum(rules.base_failed(np.array([s]))[0] for s in stats.values()) and abs(2 * last - len(good)) <= 14
    own = sorted(x.s0 for x in seen[-1].collect())
    assert r.threshold == own[rules._limit(len(own))]
    whole = np.sort(r.forest.scores(rules.features(np.array([stats[i] for i in good]))))
    assert (whole > r.threshold).mean() < 3 * rules.GOOD_LOSS
    x = rules.features(np.array([s for s in stats.values() if not rules.base_failed(np.array([s]))[0]]))
    kept = spark.createDataFrame([tuple(map(int, s)) for s in stats.values() if not rules.base_failed(np.array([s]))[0]], ", ".join(f"{c} long" for c in rules.STATS))
    assert np.allclose(rules._spread(kept.repartition(3)), x.std(0), rtol=1e-6, atol=1e-9)
    assert rules.fit_counts(counts.repartition(2), y).threshold == r.threshold


@pytest.mark.parametrize("bins", [2, 1024])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(rules, "BINS", bins)
    rng = random.Random(4)
    own = {"a": [rng.random() for _ in range(300)], "b": [0.5] * 40 + [0.5 + 1e-15] * 3, "c": [1.0]}
    d = spark.createDataFrame([(k, v) for k, vs in own.items() for v in vs], "name string, value double")
    at = {"a": 287, "b": 40, "c": 0}
    assert rules.order_statistics(d, at) == {k: sorted(own[k])[n] for k, n in at.items()}


def test_mix_stage_returns_the_readings_in_slot_order(spark):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)] + [(300, words(rng, 90), "d")] + [(400, "same row", "a")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = {s: int(t + 1e-6) for s, t in level_targets(sizes).items()}
    n, first = sum(-(-goal[s] // 64) for s in ranked), 0
    hashes = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    want = []
    for s in ranked:
        slots = sorted(p * mixing.golden_step(n) % n for p in range(first, first - (-goal[s] // 64)))
        first += len(slots)
        own = sorted((hashes[i], i, len(t.split()), t) for i, t, x in rows if x == s and t.split())
        at = k = 0
        while at < goal[s]:
            _, i, size, t = own[k % len(own)]
            if not at or 2 * min(size, goal[s] - at) >= size:
                want.append((slots[at // 64], at, i, t, s))
            at, k = at + size, k + 1
    got = corpus_pipeline.mix_stage(spark, d, "").collect()
    assert [(r.doc_id, r.text, r.source) for r in got] == [x[2:] for x in sorted(want, key=lambda x: x[:2])]
    assert all(abs(sum(len(r.text.split()) for r in got if r.source == s) - goal[s]) <= 30 for s in sizes if s != "d")


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(7)
    d = spark.createDataFrame([*((i, words(rng, rng.randint(1, 80))) for i in range(60)), (None, "a null id"), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    packs = packing.pack_documents(d, length=64)
    packs = common.written(packs, "packs")
    shards = packing.write_shards(packs, str(tmp_path / "shards"))
    assert shards.agg(F.sum("packs")).first()[0] == packs.count()
    key = lambda r: (r.pack_id, bytes(r.ids), r.n_tokens, r.cu_seqlens, r.position_resets, r.doc_ids, r.doc_offsets)
    back = packing.read_shards(shards)
    assert sorted(map(str, map(key, back.collect()))) == sorted(map(str, map(key, packs.collect())))
    for r in back.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
    assert packing.read_shards(packing.write_shards(packs.limit(0), str(tmp_path / "none"))).count() == 0


def test_broken_archives_give_a_row(spark, tmp_path):
    p = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    name = warc.write_warc(warc.mark_revisits(p), str(tmp_path / "w")).first().archive
    raw = open(name, "rb").read()
    for k, bad in enumerate((raw[:-40], b"no archive", raw[: len(raw) // 2] + b"\0" * 50)):
        at = tmp_path / f"bad{k}.warc.gz"
        at.write_bytes(bad)
        got = warc.records(warc.read_warc(spark.createDataFrame([(str(at),), (name,)], "archive string"))).collect()
        assert sum(r.error is not None for r in got) == 1
        assert all(r.payload_digest is None for r in got if r.error)
        assert sum(bool(r.digest_ok) for r in got) >= 4
    plain = tmp_path / "forged.warc"
    plain.write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    r = warc.records(warc.read_warc(spark.createDataFrame([(str(plain),)], "archive string"))).first()
    assert (r.digest_ok, r.payload_bytes, r.error) == (False, 3, None)


def test_a_giant_text_and_conflicting_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 200_000)
    rng = random.Random(2)
    rows = [(i, words(rng, 60) if i % 2 else " ".join(w + "%%%" for w in words(rng, 50).split())) for i in range(400)]
    y = [(i, i % 2) for i in range(300)] + [(8, 1), (9, 0)]
    labels = spark.createDataFrame(y, "doc_id long, quality int")
    scores = []
    for order in ([(1000, "x " * 200_000), *rows], [*rows, (1000, "x " * 200_000)]):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        for alone in (False, True):
            got = {r.doc_id: r for r in quality.score(d, quality.train(d, labels.unionByName(spark.createDataFrame([(1000, 0)], "doc_id long, quality int")), alone)).collect()}
            assert np.mean([got[i].predicted == i % 2 for i in range(300, 400)]) > 0.8
            scores.append([got[i].score for i in range(300, 400)])
    assert scores[0] == scores[2] and scores[1] == scores[3]
    sample = quality.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 500)
    assert not {rows[8][1].encode(), rows[9][1].encode()} & {*sample[0], *sample[1]}


ODD = [(1, None), (1, None), (None, ""), (2, "a  b\n\n\x0b"), (2, "a  b\n\n\x0b"), (3, "word " * 120_000), (None, "tie"), (4, "tie"), (5, "� \U0001f600 " * 40)]


def test_odd_rows_of_the_text_operators(spark):
    """Nulls, empty and very long texts, ties, repeats and clashing extra columns: a row for each row, whole texts back."""
    names = ["kept", "mix_hash", "mix_copies", "doc", "ids", "sig", "node", "score", "row", "spans", "label"]
    d = spark.createDataFrame([(*r, *["x"] * len(names)) for r in ODD], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).withColumn("source", F.lit("s"))
    y = spark.createDataFrame([(2, 1), (3, 0), (4, None)], "doc_id long, quality int")
    t = sentencepiece.tokenised(d).collect()
    assert len(t) == len(ODD) and all(r.lossless for r in t)
    assert Counter(r.n_bytes for r in media.add_media(d).collect()) == Counter(len((x or "").encode()) for _, x in ODD)
    assert quality.score(d, quality.train(d, y)).count() == rules.judge(d, rules.fit(d, y)).count() == len(ODD)
    assert mixing.mix(d).count() == neardup.near_duplicates(d).count() == suffixes.remove_repeats(d).count() == len(ODD)
    m = sentencepiece.load()
    assert sum(r.n_tokens for r in packing.pack_documents(d, length=128).collect()) == sum(len(m.encode_bytes(x or "")) // 4 for _, x in ODD)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    y = spark.createDataFrame([], "doc_id long, quality int")
    for out in (sentencepiece.tokenised(d), packing.pack_documents(d), quality.score(d, quality.train(d, y)), rules.judge(d, rules.fit(d, y)), mixing.mix(d), mixing.mixed(d), neardup.near_duplicates(d), suffixes.remove_repeats(d)):
        assert out.count() == 0
    p = spark.createDataFrame([], "page_id long, url string, html string")
    marked = warc.mark_revisits(p)
    assert marked.count() == 0


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    shared = words(rng, 60)
    names = ["kept", "mix_hash", "mix_copies", "mix_copy", "doc", "doc_h64", "cut_id", "gone_id", "stay", "own_id", "col"]
    rows = [(i, f"{words(rng, 40)} {shared}", "a", 7, *[f"{n}{i}" for n in names]) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, str(tmp_path))
        assert got.schema.fieldNames() == d.schema.fieldNames(), name
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], name
            if name == "repeated strings":
                assert shared[:150] not in r.text and r.n_chars == len(r.text)
