"""The training-data operators against brute force, round trips and held-out rows, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stratacode.llm import chat, media, mixing, neardup, packing, quality, rules, sentencepiece, suffixes, warc

DOCS = "doc_id long, text string, source string, node string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    out = [None, "", "  \n", "one", "one", base[0], base[0], base[0] + " tail", "ab " * 300, words(rng, 4000), "é" * 300 + base[3]]
    for b in base:
        w = b.split()
        for k in range(4):
            w2 = list(w)
            w2[rng.randrange(len(w))] = f"new{k}"
            out.append(" ".join(w2))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i + 1, t, [None, "b", "a"][i % 3], "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a null id", "a", "x", "y")], DOCS)


def brute_components(texts, k, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("leaf", [256, 2])
def test_near_duplicates(spark, docs, texts, leaf):
    want = brute_components({i + 1: t for i, t in enumerate(texts)}, 2)
    got = neardup.near_duplicates(docs, words=2, leaf=leaf).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_several_texts_of_one_id(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(7, a), (7, b), (3, a + " tail"), (5, b + " tail"), (6, c), (None, c + " tail"), (None, c + " tail end"), (None, words(rng, 60))]
    ids = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())
    assert ids == {(7, 3): 1, (7, 5): 1, (3, 3): 1, (5, 5): 1, (6, 6): 1, (None, 6): 2, (None, None): 1}


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(9)
    t, u, v, w = (words(rng, 80) for _ in range(4))
    rows = [(7, t, "b"), (7, t, "a"), (None, t, "a"), (None, u, "a"), (None, u, "b"), (8, v, "a"), (9, v + " tail", "a"), (None, v, "a"), (8, w, "a"), (1, "", "a"), (1, "", "a"), (None, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, d, "")
    assert Counter(map(tuple, got.collect())) == Counter([(7, t, "a"), (None, u, "a"), (8, v, "a"), (8, w, "a"), (1, "", "a"), (1, "", "a"), (None, None, "a")])
    flags = neardup.near_duplicates(d, words=5).where("n_shingles > 0 and kept")
    assert Counter(r.doc_id for r in flags.collect()) == Counter([7, None, 8, 8])
    whole = corpus_pipeline.repeat_stage(spark, got, "").where("length(trim(text)) > 0")
    assert {r.text for r in whole.collect()} == {t, u, v, w}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a </s> \\ <|sep|> [[INST]"), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 300, "assistant", "x\ny"), (None, 0, None, "<<SYS>>"), (2, 5, "assistant", "<|end|>\n<|start|>user")]
    t = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chat(t).withColumn("turns", chat.read_turns(chat.F.col("formatted"))).collect()}
    for c in (1, None, 2):
        assert [(x.role, x.text) for x in got[c].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
    assert got[1].formatted.count("<|start|>") == 2
    assert chat.format_chat(t.limit(0)).count() == 0


def test_sentencepiece():
    m = sentencepiece.load()

    def best(s):
        b, top = s.encode(), [0.0] + [-1e300] * len(s.encode())
        ids = {m.pieces[i].encode(): m.scores[i] for i in range(len(m.pieces)) if m.trie and m.surface[i] and not re.fullmatch("<0x..>", m.pieces[i])}
        ends = [len(s[:i].encode()) for i in range(len(s) + 1)]
        for j in ends[1:]:
            for i in ends:
                if i < j:
                    v = ids.get(b[i:j], m.unknown if len(b[i:j].decode()) == 1 else None)
                    if v is not None:
                        top[j] = max(top[j], top[i] + v)
        return top[-1]

    for s in ["", "a", "hello world", "  two  spaces \n x", "日本 🎉 zz", "a▁b", "the " * 50, "x" * 200]:
        ids = m.encode(s)
        assert m.decode(ids) == s.replace("▁", " ")
        if s and "🎉" not in s:
            assert sum(m.scores[i] for i in ids if i not in m.byte_ids.values()) == pytest.approx(best(" ".join(["", *s.split(" ")]).replace(" ", "▁")) - m.unknown * sum(1 for c in s if c == "\n"), abs=1e-6)


def test_sentencepiece_columns(spark, docs, texts):
    got = sentencepiece.tokenised(docs.withColumn("ids", chat.F.lit(1))).collect()
    assert len(got) == len(texts) + 1 and all(r.lossless for r in got)


def test_op3_returns_ids_and_text(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    m, want = sentencepiece.load(), {i + 1: t or "" for i, t in enumerate(texts)} | {None: "a null id"}
    got = {r.doc_id: r for r in sentencepiece.op3_sentencepiece(spark, str(tmp_path)).collect()}
    both = {r.doc_id: r for r in sentencepiece.decode_column(sentencepiece.encode_column(docs)).collect()}
    assert set(got) == set(both) == set(want)
    for i, t in want.items():
        r, raw = got[i], m.encode_bytes(t)
        assert (r.ids, r.decoded, r.n_ids, r.lossless) == (m.encode(t), t, len(raw) // 4, True)
        assert (r.ids_sha256, r.decoded_sha256) == tuple(hashlib.sha256(x).hexdigest() for x in (raw, t.encode()))
        assert (both[i].ids, both[i].decoded) == (r.ids, t)


def test_media():
    rng = np.random.default_rng(0)
    for n in (1, 5, 6, 7, 30):
        p = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        d = media.Decoder(media.store_payload(p))
        assert media.read_payload(d) == p
        fast = [c.copy() for c in d.coef]
        slow = type("Slow", (media.Decoder,), {"bulk": lambda *a: False})(media.store_payload(p))
        assert all((a == b).all() for a, b in zip(fast, slow.coef, strict=True))
        assert d.rgb().shape == (d.height, d.width, 3)
    c = np.zeros((8, 8))
    c[2, 3] = 40
    direct = np.array([[sum((np.sqrt(0.125) if u == 0 else 0.5) * (np.sqrt(0.125) if v == 0 else 0.5) * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    assert np.allclose(media.BASIS.T @ c @ media.BASIS, direct, atol=1e-4)


def test_mix(spark, docs):
    got = mixing.mix(docs, block=4).collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    assert len(got) == docs.count()
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.05 * rs[0].target + 12
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block=4).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": [20], "b": [10], None: [30]}, {"a": [40], "b": [7, 0, 6], "c": [65, 65], None: [1] * 5}, {"a": [3000], "b": [2], "c": [1]}])
def test_mix_fills_small_sources(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix(d).collect():
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for s, rs in by.items():
        assert rs[0].target > 0 and -1e-3 <= rs[0].target - sum(r.taken for r in rs) < 1
    assert {s for s, rs in by.items() if rs[0].target >= rs[0].source_size} <= {r.source for r in mixing.mixed(d).collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on copies, near copies, null and repeated ids, U+FFFD, a cut character and small sources; no labels, so no text is rejected."""
    rng = random.Random(12)
    t, u, v = (words(rng, 80) for _ in range(3))
    shared = "é" + words(rng, 60) + "é"
    texts = [(7, t, "a"), (7, t, "a"), (None, t, "b"), (8, t + " tail", "a"), (None, u, None), (9, v, "b"), (10, v, "b"), (1, None, "a"), (2, " ", "a")]
    texts += [(11, words(rng, 90) + " \ufffd " + shared + "x", "a"), (12, words(rng, 90) + " ê" + shared[1:] + "y", "a"), (13, "only two", "c")]
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    of = brute_components({i: x[1] for i, x in enumerate(sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)))}, 5)
    rows = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    left = [rows[i] for i in of if of[i][1] == i]
    assert len(left) == 8
    cut = [x.decode("utf-8", "ignore") for x in brute_repeats([(x[1] or "").encode() for x in left], 200)]
    stages = dict(corpus_pipeline.STAGES)
    after = d
    for name in ("near duplicates", "repeated strings"):
        after = stages[name](spark, after, str(tmp_path))
    want = Counter((x[0], x[2], c) for x, c in zip(left, cut, strict=True))
    assert Counter((r.doc_id, r.source, r.text or "") for r in after.collect()) == want
    assert any("\ufffd" in c and len(c) < len(x[1]) for x, c in zip(left, cut, strict=True))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    m, times = sentencepiece.load(), Counter((r.doc_id, r.source, r.text) for r in got)
    assert set(times) <= set(want) and max(times.values()) <= 2 and {r.source for r in got} == {"a", "b", "c", None}
    assert all(r.lossless and r.ids == m.encode(r.text) and r.n_ids == len(r.ids) for r in got)


def test_packing(spark, docs, texts):
    rng = random.Random(1)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    rows = packing.best_fit_decreasing(lengths, 64)
    left: list[int] = []  # plain best fit
    for n in sorted(lengths, reverse=True):
        fit = [k for k in range(len(left)) if left[k] >= n]
        k = min(fit, key=lambda k: left[k]) if fit else len(left)
        left[k:] = left[k:] or [64]
        left[k] -= n
    assert len(rows) == len(left) and sorted(k for r in rows for k in r) == list(range(400))
    packs = packing.pack_documents(docs.where("doc_id is not null"), length=64)
    back = {r.doc_id: bytes(r.ids) for r in packing.unpack(packs).collect()}
    m = sentencepiece.load()
    assert back == {i + 1: m.encode_bytes(t) for i, t in enumerate(texts) if t}


def brute_repeats(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        yield bytes(x for x, y in zip(t, m, strict=True) if not y)


@pytest.mark.parametrize("bucket", [40_000, 7])
def test_repeats(spark, docs, texts, bucket):
    own = [(t or "").encode() for t in [*texts, "a null id"]]
    want = dict(zip([*range(1, len(texts) + 1), None], brute_repeats(own, 200), strict=True))
    for r in suffixes.remove_repeats(docs, bucket=bucket).collect():
        whole = own[r.doc_id - 1 if r.doc_id else -1]
        assert (whole if r.kept is None else bytes(r.kept)) == want[r.doc_id]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_classifiers(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 80) if i % 2 else " ".join(w + "%%%" for w in words(rng, 60).split())) for i in range(400)]
    d = spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(d, quality.train(d, y)).collect()}
    assert np.mean([got[i].predicted == i % 2 for i in range(300, 400)]) > 0.95 and 0 <= got[9999].score <= 1
    assert {r.score for r in quality.score(d, quality.train(d, y.limit(0))).collect()} == {0.5}
    got = {r.doc_id: r for r in rules.judge(d, rules.fit(d, y)).collect()}
    assert np.mean([got[i].kept == bool(i % 2) for i in range(300, 400)]) > 0.95
    assert got[9999].base_failed and not got[9999].kept


def test_sample_bound_skips_only_rows_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    rows = [(0, "x" * 5000), (1, "é" * 600), *[(i, "ab" * 20) for i in range(2, 122)]]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    y = spark.createDataFrame([(i, i % 2) for i in range(122)], "doc_id long, quality int")
    got = quality.labelled_sample(d, y, 200)
    assert {k: (len(v), set(map(len, v))) for k, v in got.items()} == {0: (25, {40}), 1: (25, {40})}
    order = [r.doc_id for r in y.where("doc_id > 1 and quality = 0").orderBy(quality.F.xxhash64(quality.F.lit(5), "doc_id")).collect()]
    d = d.where("doc_id < 2").unionByName(d.where("doc_id > 1").withColumn("text", quality.F.format_string("%040d", "doc_id")))
    assert {int(t) for t in quality.labelled_sample(d, y, 200)[0]} == set(order[:25])


def test_rule_counts(texts):
    memo = rules.WordHash()
    for t in [*texts, "a b c d e f a b c d e\na b c d e # |\n\nx\nx"]:
        w = WORD.findall(t or "")
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert rules.statistics((t or "").encode(), memo)[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    big = "<p>\r\n\r\nWARC/1.1</p>" * 400
    rows = [(1, "http://a/\n", big), (2, None, big), (3, "http://c", None), (4, "http://d", "short"), (5, "http://e", "short"), (None, "http://f", big)]
    p = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, archive string")
    chunked = warc.read_warc(warc.write_warc(warc.mark_revisits(p), str(tmp_path / "w")))
    got = {r.page_id: r for r in warc.records(chunked).collect()}
    for i, _, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert [got[i].record_type for i in (1, 2, 3, 4, 5)] == ["response", "revisit", "response", "response", "response"]
    assert got[2].refers_to == 1
    data = b"".join(bytes(r.data) for r in chunked.where("page_id = 1").orderBy("chunk_no").collect())
    assert data == big.encode()
