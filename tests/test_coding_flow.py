"""The coding flow on a small world of its own: countries, agents, an encyclopedia, a gazetteer and stories."""

import datetime
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratacode import models as M
from stratacode import pipeline
from stratacode.config import EngineConfig
from stratacode.functions import letters, tokens
from stratacode.operators import actors as A
from stratacode.operators import attributes as Q
from stratacode.operators import countries as C
from stratacode.operators import events as E
from stratacode.operators import pairs, search
from stratacode.plans import index_build
from stratacode.sources import readers, sinks

COUNTRIES = [("XX", "United Kingdom", "GBR", "British,Britain,Great Britain,UK,U.K."), ("FR", "France", "FRA", "French"), ("TW", "Taiwan", "TWN", "Taiwanese,Republic of China"), ("CN", "China", "CHN", "Chinese,People's Republic of China"), ("SA", "Saudi Arabia", "SAU", "Saudi Arabian,Saudi"), ("US", "United States", "USA", "American,US,U.S."), ("NA", "Namibia", "NA", "Namibian"), ("XX", "Abkhazia", "GEOPRE", "Abkhazian"), ("BR", "Brazil", "BRA", "Brazilian")]
AGENTS = [("minister", "GOV", ""), ("president", "GOV", ""), ("soldier", "MIL", ""), ("destroyer", "MIL", ""), ("rebel group", "REB", ""), ("newspaper", "JRN", ""), ("opposition party", "PTY", "OPP"), ("mayor", "GOV", "LOC"), ("bank", "BUS", "")]
LONG = " She has been known for her work in public life for a very long time."
PAGES = [
    (1, "Jane Doe", ["J. Doe"], ["Janey Doe"], "French minister", "Jane Doe is a French politician." + LONG, "officeholder", {"name": "Jane Doe", "office": "Minister", "term_start": "May 1, 2010", "term_end": "May 1, 2014", "office2": "French president", "term_start2": "2 June 2014"}, ["Women of France"]),
    (2, "Old Hand", [], [], None, "Old Hand is a politician." + LONG, "officeholder", {"name": "Old Hand", "office1": "British minister", "termstart1": "1990", "termend1": "1995"}, ["People of Britain"]),
    (3, "Daily Planet", ["The Planet"], [], "American newspaper", "Daily Planet is a newspaper of the city." + LONG, None, None, []),
    (4, "Mercury (disambiguation)", [], ["Mercury"], None, "Mercury may refer to:" + LONG, None, None, []),
    (5, "Quiet Place", ["Silence"], [], None, "Quiet Place (a village) is in Brazil.\n It is quiet." + LONG, None, None, None),
    (6, "Jane Doe", [], [], "Brazilian mayor", "Another Jane Doe, who is a mayor in a town." + LONG, None, {}, []),
]
PAGE = "page_id long, title string, redirects array<string>, alternative_names array<string>, short_desc string, intro_para string, box_type string, infobox map<string,string>, categories array<string>"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame(COUNTRIES, "CCA2 string, Name string, CCA3 string, Nationality string")


@pytest.fixture(scope="module")
def agents(spark):
    return spark.createDataFrame(AGENTS, "pattern string, code_1 string, code_2 string")


@pytest.fixture(scope="module")
def lookup(countries, agents):
    return A.Lookup(C.load(countries), M.load_agents(agents))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE)


def test_country_words(spark, lookup, countries):
    want = {"Great Britain": ("GBR", ""), "Republic of China": ("TWN", ""), "People's Republic of China": ("CHN", ""), "Saudi Arabia": ("SAU", ""), "an American destroyer": ("USA", "destroyer"), "a US destroyer": ("USA", "destroyer"), "nobody": (None, "nobody"), "Françe café": (None, "Françe café".replace("ç", "c").replace("é", "e")), "USS Cole": ("USA", "Cole"), "Frenchman": (None, "Frenchman"), "": (None, "")}
    want["Françe café"] = ("FRA", "cafe")
    for text, found in want.items():
        assert lookup.countries.find(text) == found, text
    assert lookup.countries.find("Chinese and French soldier", "first")[0] == "CHN"
    assert lookup.countries.find("Women of Saudi Arabia", "longest", True)[0] == "SAU"
    assert lookup.countries.find("French-speaking countries", "longest", True)[0] is None
    assert C.load(countries, strict=True).find("XUS Cole") == (None, "XUS Cole")
    rows = spark.createDataFrame([*want.items(), (None, (None, None))], "text string, want struct<c:string,r:string>")
    for r in C.find_country(rows, lookup.countries).collect():
        assert (r.country, r.remainder) == tuple(r.want)
    assert C.find_country(rows.limit(0), lookup.countries).count() == 0
    named = C.country_names(spark.createDataFrame([("FRA",), ("IGO",), ("",), ("ZZZ",), (None,)], "country string"), countries)
    assert {r.country: r.country_name for r in named.collect()} == {"FRA": "France", "IGO": "Intergovernmental Organization", "": "", "ZZZ": "", None: ""}


def test_hundreds_of_patterns_plan_quickly(spark, countries):
    import time

    many = spark.range(400).select(F.lit("X").alias("CCA2"), F.concat(F.lit("Country"), "id").alias("Name"), F.concat(F.lit("C"), F.col("id") + 100).alias("CCA3"), F.concat(F.lit("Demonym"), "id", F.lit("ish,Folk of "), "id").alias("Nationality"))
    look = C.load(many)
    texts = spark.range(50).select(F.concat(F.lit("the Demonym"), "id", F.lit("ish soldier")).alias("text"))
    began = time.perf_counter()
    got = C.find_country(texts, look)
    got.explain("formatted")
    assert time.perf_counter() - began < 2
    assert {(r.text, r.country, r.remainder) for r in got.collect()} == {(f"the Demonym{i}ish soldier", f"C{i + 100}", "soldier") for i in range(50)}


def test_short_texts(spark, lookup):
    t = spark.createDataFrame([("French ministers",), ("soldier",), ("xyzzy",), (None,), ("",)], "text string")
    got = {r.text: r.agent for r in A.short_text_to_agent(t, lookup).collect()}
    assert (got["French ministers"].country, got["French ministers"].code_1, got["French ministers"].pattern) == ("FRA", "GOV", "minister")
    assert (got["soldier"].country, got["soldier"].conf) == (None, 1.0)
    assert got["xyzzy"] is None and got[None] is None and got[""] is None


def test_offices():
    box = {"office": "Chair", "term_start": "1 May 2001", "office2": "Mayor", "termstart2": "June 3, 1999", "termend2": "2000-01-01", "office_note": "x", "office3": "Clerk"}
    got = A.parse_offices(box)
    d = datetime.date
    assert got == [{"office": "Chair", "office_num": 0, "start": d(2001, 5, 1), "end": None}, {"office": "Mayor", "office_num": 2, "start": d(1999, 6, 3), "end": d(2000, 1, 1)}, {"office": "Clerk", "office_num": 3, "start": None, "end": None}]
    assert [o["office"] for o in A.active_offices(got, d(1999, 12, 1))] == ["Mayor"]
    assert [o["office"] for o in A.active_offices(got, d(2010, 1, 1))] == ["Chair"]
    assert A.parsed_date("in about 1987, or so") == d(1987, 1, 1) and A.parsed_date("no date") is None and A.parsed_date(None) is None


def test_page_to_codes(spark, lookup, pages):
    on = [(1, "2012-01-01"), (1, "2020-01-01"), (2, "2012-01-01"), (3, "2012-01-01"), (5, "2012-01-01"), (6, "2012-01-01")]
    asked = spark.createDataFrame([(f"{p}@{d[:4]}", p, d) for p, d in on], "key string, page_id long, on string").join(pages, "page_id")
    got = {}
    for r in A.page_to_codes(asked, lookup).orderBy("key", "ord").collect():
        got.setdefault(r.key, []).append((r.source, r.code_1, r.country, r.office_num))
    assert got["1@2012"] == [("Infobox", "GOV", "FRA", 0), ("Wiki short description", "GOV", "FRA", None)]
    assert got["1@2020"][0] == ("Infobox", "GOV", "FRA", 2)
    assert got["2@2012"] == [("Infobox", "ELI", "GBR", None)]
    assert got["3@2012"] == [("Wiki short description", "JRN", "USA", None)]
    assert got["5@2012"] == [("Wiki", "", "BRA", None)]
    assert got["6@2012"] == [("Wiki short description", "GOV", "BRA", None)]


def test_search_and_pages(spark, pages):
    index = search.postings(pages)
    q = spark.createDataFrame([("a", "the Jane Doe", None), ("b", "The Planet", ""), ("c", "Mercury", None), ("d", "Janey Doe", None), ("e", "Doe Planet", None), ("f", "", None), ("g", "Jane Doe", "Brazilian xx"), ("h", "Silence", None)], "key string, query string, limit_term string")
    hits = search.search(q, index)
    found = {}
    for r in hits.orderBy("key", "ord").collect():
        found.setdefault(r.key, []).append(r.page_id)
    assert set(found["a"]) == {1, 6} and found["b"] == [3] and found["c"] == [4] and found["d"] == [1]
    assert "e" not in found and "f" not in found and "g" not in found and found["h"] == [5]
    tiers = {r.key: (r.page_id, r.tier) for r in search.query_pages(q.drop("limit_term"), pages, index).collect()}
    assert tiers["a"][1] == "title" and tiers["b"] == (3, "redirect") and tiers["d"] == (1, "alternative") and tiers["h"] == (5, "redirect") and "c" not in tiers
    sim = spark.createDataFrame([("a", 6, 0.9, 1.0), ("a", 1, 0.1, 1.0)], "key string, page_id long, sim double, title_sim double")
    assert {r.key: r.page_id for r in search.query_pages(q.drop("limit_term"), pages, index, sim).collect()}["a"] == 6
    options = search.search_to_options(search.candidates(q.drop("limit_term"), pages, index)).orderBy("key", "nth").collect()
    assert [(r.title, r.reason, r.nth) for r in options if r.key == "a"] == [("Jane Doe", "title", 0)]
    assert search.search(q.limit(0), index).count() == 0
    with pytest.raises(ValueError, match="redirects"):
        search.checked_pages(pages.drop("redirects"))
    assert spark.range(1).select(search.padded(F.array(F.lit(1), F.lit(2)), 4).alias("p")).first().p == [1, 2, None, None]


def test_agent_to_code(spark, lookup, pages):
    rows = [("a", "French", None), ("b", "the French soldier", None), ("c", "Jane Doe", "2012-01-01"), ("d", "Old Hand", "2012-01-01"), ("e", "Nobody Known", None), ("f", "Abkhazian rebel groups", None), ("g", "French Daily Planet", None), ("h", "", None), ("i", None, None)]
    got = {r.key: r for r in A.agent_to_code(spark.createDataFrame(rows, "key string, text string, on string").withColumn("on", F.col("on").cast("date")), lookup, pages, search.postings(pages)).collect()}
    say = lambda k: (got[k].country, got[k].code_1, got[k].reason, got[k].wiki)
    assert say("a") == ("FRA", "", "country only", "") and say("b") == ("FRA", "MIL", "sure agent", "")
    assert say("c")[:2] == ("FRA", "GOV") and got["c"].wiki == "Jane Doe" and got["c"].all_code1s == ["GOV"]
    assert say("d") == ("GBR", "ELI", "only code", "Old Hand")
    assert say("f") == ("GEO", "PRE", "sure agent", "")
    assert got["g"].wiki == "Daily Planet" and got["g"].code_1 == "JRN"
    assert not {"e", "h", "i"} & set(got)


QUESTIONS = [("PROTEST_demo", "ACTOR", "Who marched against {recip_text}?"), ("PROTEST_demo", "RECIP", "Who was the target of the march by {actor_text}?"), ("PROTEST_demo", "LOC", "Where was the march?"), ("PROTEST_demo", "DATE", "When was the march?")]
STORIES = [("s1", ["PROTEST", "ASSAULT"], ["PROTEST-demo"], "The French soldiers marched in Springfield on Monday against Jane Doe.", "2012-06-20"), ("s2", ["ASSAULT"], None, "nothing is named here", "2012-06-20"), ("s3", [], [], "Old Hand spoke.", "2012-06-20"), ("s4", ["ASSAULT"], [], None, None)]
PLACES = [("Springfield", "USA", "PPL", 1.0, 2.0, 90), ("Springfield", "GBR", "PPL", 3.0, 4.0, 10)]


def tables(spark, countries, agents, pages):
    return {"questions": spark.createDataFrame(QUESTIONS, "key string, attr string, question string"), "agents": agents, "countries": countries, "pages": pages, "places": spark.createDataFrame(PLACES, "name string, country_code3 string, feature_code string, lat double, lon double, population long")}


def test_answer_rounds(spark, countries, agents, pages):
    stories = spark.createDataFrame(STORIES, "id string, event_type array<string>, event_mode array<string>, event_text string, pub_date string")
    events = E.stories_to_events(stories)
    calls = []

    def reader(questions, contexts):
        return M.span_answer(questions, contexts)

    answers = Q.answer_rounds(events, tables(spark, countries, agents, pages)["questions"], M.Models(answer=reader)).collect()
    of = {(r.id, r.attr, r.round): (r.question, r.text) for r in answers}
    assert of["s1_PROTEST_demo", "ACTOR", 1] == ("Who marched against someone?", "French")
    assert of["s1_PROTEST_demo", "RECIP", 2] == ("Who was the target of the march by French?", "Jane Doe")
    assert of["s1_PROTEST_demo", "ACTOR", 3][0] == "Who marched against Jane Doe?"
    assert of["s1_PROTEST_demo", "LOC", 1][1] == "Springfield" and of["s1_PROTEST_demo", "DATE", 1][1] == "on Monday"
    assert of["s1_ASSAULT_", "ACTOR", 1][0] == "Who did the assault to someone?"
    assert of["s2_ASSAULT_", "ACTOR", 1][1] == "" and not calls
    for r in answers:
        text = next(s[3] for s in STORIES if r.id.startswith(s[0] + "_")) or ""
        assert text[r.start : r.end] == r.text
    grouped = Q.grouped_answers(spark.createDataFrame(answers)).collect()
    assert sum(len(r.answers) for r in grouped) == len(answers)


def test_generated_answers_must_stand_in_the_text():
    read = M.generated_answer(lambda q, c: [("jane doe", -0.5), ("nobody", -0.1), ("", 0.0)])
    got = read(["q"] * 3, ["by Jane Doe", "text", "text"])
    assert got[0][0] == "Jane Doe" and got[0][2:] == (3, 11) and got[1] == got[2] == ("", 0.0, 0, 0)


def test_code_stories(spark, countries, agents, pages, tmp_path):
    stories = spark.createDataFrame(STORIES, "id string, event_type array<string>, event_mode array<string>, event_text string, pub_date string")
    t = tables(spark, countries, agents, pages)
    got = {r.id: r for r in pipeline.code_stories(stories, config=EngineConfig(stages=str(tmp_path / "stages")), **t).collect()}
    assert set(got) == {"s1_PROTEST_demo", "s1_ASSAULT_", "s2_ASSAULT_", "s4_ASSAULT_"}
    e = got["s1_PROTEST_demo"]
    assert [(s.text, s.country, s.country_name) for s in e.actors["ACTOR"]] == [("French", "FRA", "France")]
    assert [(s.text, s.code_1, s.country, s.wiki) for s in e.actors["RECIP"]] == [("Jane Doe", "GOV", "FRA", "Jane Doe")]
    assert (e.event_geolocation.reason, e.event_geolocation.geo.resolved_placename, e.event_geolocation.geo.country_name) == ("matched", "Springfield", "United States")
    assert (e.date_resolved, e.date_raw) == ("2012-06-18", "on Monday")
    assert got["s2_ASSAULT_"].actors == {} and got["s2_ASSAULT_"].date_resolved == "2012-06-20"
    assert got["s4_ASSAULT_"].date_resolved is None and got["s4_ASSAULT_"].geolocated_ents == []
    lazy = pipeline.code_stories(stories, **t)
    assert {r.id for r in lazy.select("id").collect()} == set(got)
    table = pipeline.display_table(lazy).where("id = 's1_PROTEST_demo'").orderBy("n").collect()
    assert len(table) == 12 and table[0].value == "French" and table[1].value == "FRA " and table[11].value == "2012-06-18"
    one = pipeline.code_text(spark, STORIES[0][3], "2012-06-20", ["PROTEST"], ["PROTEST-demo"], **t).first()
    assert one.id == "form_PROTEST_demo" and one.date_resolved == "2012-06-18"


def test_classifiers_learn_and_persist(spark, tmp_path):
    rows = [(i, ["WAR"] if i % 3 == 0 else ["TRADE"] if i % 3 == 1 else [], ["soldiers attacked the town", "ministers sign a trade deal", "the weather was fine"][i % 3] + f" {i}") for i in range(60)]
    d = M.embedded(spark.createDataFrame(rows, "id long, labels array<string>, text string"), "text")
    w = M.train_classifiers(d)
    assert list(w) == ["TRADE", "WAR"]
    M.save_classifiers(spark, w, str(tmp_path / "m"))
    assert M.load_classifiers(spark, str(tmp_path / "m")) == w
    got = M.classify(d, w, 0.5).collect()
    assert sum(r.event_type == r.labels for r in got) >= 57
    n = M.balanced_examples(d.withColumn("pseudo", F.lit(0.0)), "WAR", 1).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in n} == {1.0: 20, 0.0: 20}
    one = M.cached_embeddings(d, "text", str(tmp_path), "cache").count()
    assert M.cached_embeddings(d, "text", str(tmp_path), "cache").count() == one == 60


def test_option_ranker(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    layers = ((rng.normal(size=(64, 150)), np.zeros(64)), (rng.normal(size=(32, 64)), np.zeros(32)), (rng.normal(size=(51, 32)), np.zeros(51)))
    ranker = M.Ranker(rng.normal(size=(3, 7)), np.zeros(3), layers)
    f = rng.normal(size=(5, 7)).tolist()
    got = [r.choice for r in M.rank_options(spark.createDataFrame([(f,), ([],), (None,)], "features array<array<double>>"), ranker).collect()]
    x = np.zeros((1, 50, 7))
    x[0, :5] = f
    best = int(ranker.scores(x).argmax())
    assert got[0] == (best if best < 5 else None) and got[1] is None and got[2] is None


def test_letters(spark):
    d = spark.createDataFrame([("Łódź Nguyễn Øst straße", "日本")], "a string, b string").select(letters.transliterate("a").alias("a"), letters.transliterate("b").alias("b"), letters.without_marks("a").alias("c")).first()
    assert (d.a, d.b, d.c) == ("Lodz Nguyen Ost strasse", "日本", "Łodz Nguyen Øst straße")
    x = spark.range(1).select(
        letters.first_line_outside_parentheses(F.lit("A (b\nc) d\ne")).alias("first"),
        letters.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("soft"),
        letters.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("arg"),
        letters.clean_entries(F.array(F.lit("A (disambiguation)"), F.lit("a#b"), F.lit("A"))).alias("clean"),
        letters.ranker_text(F.lit("one\ntwo"), (F.array(F.lit("x"), F.lit("y")),), F.lit(None).cast("string")).alias("ranker"),
        letters.page_entries(F.lit("T"), F.array(F.lit("R")), F.lit(None).cast("array<string>"), F.create_map(F.lit("name"), F.lit("N"), F.lit("rank"), F.lit("Gen."))).alias("entries"),
        letters.format_fields(F.lit("{a} and {b}"), a=F.lit("x"), b=F.lit(None)).alias("form"),
        letters.lcs_shares(F.array(F.lit(2), F.lit(4)), F.lit("abcd")).alias("lcs"),
        letters.option_features(F.lit(""), F.lit("d"), F.array(F.lit("c")), F.lit(0.4), F.lit(0.3), F.lit("alt")).alias("f"),
    ).first()
    assert x.first == "A  d" and x.soft == [0.5, 0.5] and x.arg == 1 and x.clean == ["A"] and x.ranker == "onex, y"
    assert x.entries == ["Gen. N", "N", "R", "T"] and x.form == "x and " and (x.lcs.best, x.lcs.mean) == (1.0, 0.75)
    assert (x.f.intro_sim, x.f.desc_sim, x.f.alt_match, x.f.title_match, x.f.cat_len) == (-0.5, 0.3, 1, 0, 1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0] + [0] * len(b) if False else [0, *(0 for _ in b)] if False else _next(row, c, b)
        return row[-1]

    def _next(row, c, b):
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        return new

    for a, b in [("", "x"), ("abcbdab", "bdcaba"), ("aaaa", "aa"), ("xyz", "abc"), ("Jane Doe", "Janey D.")]:
        assert letters.common_subsequence(a, b) == slow(a, b)


def tok(words):
    """(text, dep, head[, pos]) -> tokens, a space behind each."""
    out, at = [], 0
    for i, w in enumerate(words):
        out.append({"i": i, "idx": at, "text": w[0], "ws": " ", "dep": w[1], "head": w[2], "pos": w[3] if len(w) > 3 else "NOUN", "ent_type": ""})
        at += len(w[0]) + 1
    return out


def test_tokens(spark):
    t = tok([("Prime", "compound", 1), ("Minister", "compound", 2), ("Smith", "nsubj", 6), (",", "punct", 2, "PUNCT"), ("old", "amod", 5), ("friend", "appos", 2), ("spoke", "ROOT", 6)])
    assert [x["text"] for x in tokens.expand_tokens(t, 2)] == ["Prime", "Minister", "Smith"]
    assert tokens.expand_actor(t, 15, 20) == "Prime Minister"
    assert tokens.expand_actor(t, 23, 33) == "Prime Minister Smith"
    assert tokens.co_actors(t, "Smith", 15, 23) == [{"text": "Smith", "qa_start_char": 15, "qa_end_char": 23}]  # three past the token's end
    assert tokens.co_actors(t, "Smith", 100, 120) == []
    kind = "array<struct<i:int,idx:int,text:string,ws:string,dep:string,head:int,pos:string,ent_type:string>>"
    d = spark.createDataFrame([([*t[:3], {**t[4], "pos": "ADJ"}, t[5]],)], f"tokens {kind}")
    x = d.select(letters.noun_phrases(F.col("tokens")).alias("np"), letters.strip_ents(F.transform("tokens", lambda v: v.withField("ent_type", F.when(v["text"] == "Smith", "PERSON").otherwise("")))).alias("s")).first()
    assert x.np == ["Prime Minister Smith old friend"] and x.s == "Prime Minister old friend"
    e = spark.createDataFrame([([("A", "PERSON", 1), ("B", "GPE", 2), ("C", "ORG", 30), ("A", "PERSON", 3)], [(0, 10, "first"), (10, 40, "second")])], "ents array<struct<text:string,label:string,start:int>>, sents array<struct<start:int,end:int,text:string>>")
    x = e.select(letters.roll_up(F.col("ents"), "PERSON").alias("p"), letters.entity_sentences(F.lit(1), F.col("sents"), F.col("ents")).alias("s")).first()
    assert x.p == ["A"] and [(r.text, r.sentence) for r in x.s] == [("A", "first"), ("C", "second"), ("A", "first")]


def test_pairs(spark):
    g = spark.createDataFrame([(f"k{i}", [f"n{i}{j}" for j in range(i + 1)]) for i in range(12)] + [("none", [])], "key string, names array<string>")
    pos = pairs.positive_pairs(g, 6, 10).collect()
    by = Counter(r.key for r in pos)
    assert by["k1"] == 1 and by["k3"] == 6 and by["k11"] == 10 and "k0" not in by and all(r.a < r.b for r in pos)
    assert sorted(map(str, pos)) == sorted(map(str, pairs.positive_pairs(g, 6, 10).collect()))
    neg = pairs.negative_pairs(g, 3).collect()
    assert len(neg) == 36 and all(r.key != r.other for r in neg) and len({(r.key, r.other) for r in neg}) == 36
    assert all(r.a.startswith("n" + r.key[1:]) and r.b.startswith("n" + r.other[1:]) for r in neg)
    assert pairs.negative_pairs(g.limit(0)).count() == 0
    p = g.select(F.substring("key", 2, 9).try_cast("long").alias("page_id"), "names").where("page_id is not null")
    close = spark.createDataFrame([(5, 2), (5, 5), (2, 0)], "page_id long, other_id long")
    hard = pairs.hard_negatives(p, close, 2).collect()
    assert Counter((r.page_id, r.other_id) for r in hard) == {(5, 2): 6, (2, 0): 2}
    both = pairs.labelled_pairs(spark.createDataFrame(pos), spark.createDataFrame(hard)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in both} == {1: len(pos), 0: len(hard)}
    near = pairs.nearest_titles(spark.createDataFrame([("Jane Doe",)], "query string"), spark.createDataFrame([("Jane D. Doe",), ("John Doe",), ("Other",)], "title string"), 1).collect()
    assert [(r.title, r.lcs) for r in near] == [("Jane D. Doe", 8)]
    prompts = M.story_prompts(spark.createDataFrame([("WAR", None, "War begins"), ("WAR", None, " ")], "event string, mode string, title string"), ["AP", "AFP"], ["Rome", "Oslo"]).collect()
    assert len(prompts) == 4 and all("{" not in r.prompt and "War begins" in r.prompt for r in prompts)


def test_files(spark, tmp_path):
    (tmp_path / "agents.txt").write_text("# comment\n!minist! = x\nthe_!minist! [GOV]\nkind !person! of_peace [CVL~REL]\nSOLDIER {x} [MIL] # note\n")
    got = [(r.pattern, r.code_1, r.code_2) for r in readers.read_agents(spark, str(tmp_path / "agents.txt")).collect()]
    assert ("The Ministries", "GOV", "") in got and ("kind women of peace", "CVL", "REL") in got and ("soldier", "MIL", "") in got and len(got) == 10
    (tmp_path / "c.csv").write_text('CCA2,Name,CCA3,Nationality\nNA,Namibia,NA,Namibian\nFR,France,FRA,"French,Frenchman"\n')
    assert [tuple(r) for r in C.read_countries(spark, str(tmp_path / "c.csv")).collect()] == [("NA", "Namibia", "NA", "Namibian"), ("FR", "France", "FRA", "French,Frenchman")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", 'n,t\n1,"x\ny"\n2,é\n')
        z.writestr("b.csv", "t,other\nz,1\n")
    got = readers.read_zipped_csv(spark, str(tmp_path / "z.zip"), "n int, t string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "x\ny"), (2, "é"), (None, "z")]))
    d = spark.range(3)
    for k in (1, 2, 3):
        assert sinks.write_snapshot(d.withColumn("v", F.lit(k)), str(tmp_path / "snap")) == k
    assert readers.snapshot_versions(spark, str(tmp_path / "snap")) == [2, 3] and readers.read_snapshot(spark, str(tmp_path / "snap")).first().v == 3
    sinks.append_lines(d, str(tmp_path / "lines"))
    sinks.append_lines(d, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 6
    with pytest.raises(FileNotFoundError):
        readers.read_snapshot(spark, str(tmp_path / "nowhere"))


def test_index_build(spark, tmp_path):
    page = "<page><title>{}</title><revision><text>{}</text></revision></page>"
    intro = "'''Jane Doe''' is a French minister who has held several offices over a long career." + LONG
    (tmp_path / "dump.xml").write_text("<m>" + page.format("Jane Doe", intro) + page.format("J Doe", "#REDIRECT [[Jane Doe]]") + page.format("List of x", intro) + "</m>")
    pages, index = index_build.build_index(spark, str(tmp_path / "dump.xml"), str(tmp_path / "index"))
    assert [(r.title, r.redirects) for r in pages.collect()] == [("Jane Doe", ["J Doe"])]
    q = spark.createDataFrame([("a", "J Doe")], "key string, query string")
    assert search.query_pages(q, pages, index).first().tier == "redirect"
