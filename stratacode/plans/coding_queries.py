"""The coding flow as queries: texts are made from the shared tables, dimensions are rows of our own; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models as M
from .. import pipeline
from ..functions import letters as L
from ..functions import pages as P
from ..functions.tokens import split_actors
from ..operators import actors as A
from ..operators import attributes as Q
from ..operators import countries as C
from ..operators import events as E
from ..operators import pairs, search
from .index_build import build_links

#: (name, code, demonyms); the SQL below knows demonyms by their place in DEMONYMS.
COUNTRIES = [("Ruritania", "RUR", "Ruritanian,Ruritans"), ("Freedonia", "FRD", "Freedonian,Great Freedonian"), ("Sylvania", "SYL", "Sylvanian"), ("Borduria", "BORPRE", "Bordurian"), ("Osterlich", "OST", "Osterlich's,Ost.")]
DEMONYMS = [("Ruritanian", "RUR"), ("Great Freedonian", "FRD"), ("Sylvanian", "SYL"), ("Bordurian", "BORPRE"), ("Freedonian", "FRD")]
AGENTS = [("minister", "GOV", ""), ("soldiers", "MIL", ""), ("rebel group", "REB", ""), ("newspaper", "JRN", "PUB"), ("trade union", "LAB", ""), ("world body", "IGO", ""), ("gang", "JNK", "")]
PLACES = [("Zenda", "RUR", "PPL", 1.0, 2.0, 90), ("Zenda", "SYL", "PPL", 3.0, 4.0, 10), ("Klow", "BOR", "PPL", 5.0, 6.0, 50)]
PAGE = "page_id long, title string, redirects array<string>, alternative_names array<string>, short_desc string, intro_para string, box_type string, infobox map<string,string>, categories array<string>"


def _read(spark, d, name, *columns):
    return spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*columns)


def _countries(spark):
    return spark.createDataFrame([("XX", *r) for r in COUNTRIES], "CCA2 string, Name string, CCA3 string, Nationality string")


def _agents(spark):
    return spark.createDataFrame(AGENTS, "pattern string, code_1 string, code_2 string")


def _lookup(spark):
    return A.Lookup(C.load(_countries(spark)), M.load_agents(_agents(spark)))


def _nth(values, by):
    """SQL of either engine: the element of a list by a remainder."""
    return "CASE " + by + f" % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_DEMONYM, _AGENT = _nth([d for d, _ in DEMONYMS], "c_custkey"), _nth([a for a, _, _ in AGENTS], "(c_custkey + c_nationkey)")
_CODE3 = _nth([c for _, c in DEMONYMS], "c_custkey")
_ROLE1, _ROLE2 = _nth([k for _, k, _ in AGENTS], "(c_custkey + c_nationkey)"), _nth([k for _, _, k in AGENTS], "(c_custkey + c_nationkey)")
_FINAL = f"""x AS (SELECT c_custkey, c_nationkey, {_CODE3} AS c, {_ROLE1} AS k, {_ROLE2} AS k2 FROM customer),
y AS (SELECT c_custkey, c_nationkey, k2, CASE WHEN k = 'JNK' THEN '' WHEN k = 'IGO' THEN 'IGO' ELSE c END AS c, CASE WHEN k = 'IGO' THEN '' ELSE k END AS k FROM x),
z AS (SELECT c_custkey, c_nationkey, k2, CASE WHEN length(c) = 6 THEN substr(c, 1, 3) ELSE c END AS country, CASE WHEN length(c) = 6 THEN substr(c, 4, 3) ELSE k END AS code_1 FROM y)"""


def country_table(spark, d):
    """Country words of a table of countries in texts, and what they leave."""
    t = _read(spark, d, "customer", "c_custkey", f"concat('the ', {_DEMONYM}, ' ', lower(c_mktsegment), ' 21st') AS text")
    return C.find_country(t, C.load(_countries(spark))).select("c_custkey", "country", "remainder")


def country_names(spark, d):
    """J17, P9."""
    t = _read(spark, d, "customer", "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'RUR' WHEN 1 THEN 'IGO' WHEN 2 THEN 'ZZZ' END AS country")
    return C.country_names(t, _countries(spark)).select("c_custkey", "country_name")


def short_text_agents(spark, d):
    """Country words and agents of short texts."""
    t = _read(spark, d, "customer", "c_custkey", f"concat({_DEMONYM}, ' ', {_AGENT}) AS text")
    return A.short_text_to_agent(t, _lookup(spark)).select("c_custkey", "agent.country", "agent.code_1", "agent.code_2", "agent.pattern")


def _no_pages(spark):
    rows = [(1, "Quiet Page", ["Silent Page"], [], None, "Quiet Page is about nothing in particular, and says so at some length.", None, {}, [])]
    return spark.createDataFrame(rows, PAGE)


def actor_codes(spark, d):
    """Actors to codes, where agents alone decide, or countries alone."""
    t = _read(spark, d, "customer", "cast(c_custkey as string) AS key", f"CASE WHEN c_nationkey % 5 = 0 THEN {_DEMONYM} ELSE concat('the ', {_DEMONYM}, ' ', {_AGENT}) END AS text", "date'2012-01-01' AS on")
    pages = _no_pages(spark)
    got = A.agent_to_code(t, _lookup(spark), pages, search.postings(pages))
    return got.select(F.col("key").cast("long").alias("c_custkey"), "country", "code_1", "code_2", "reason")


_S_DEM, _S_CODE = _nth([x for x, _ in DEMONYMS], "s_suppkey"), _nth([c for _, c in DEMONYMS], "s_suppkey")
_S_AGENT, _S_ROLE = _nth([a for a, _, _ in AGENTS], "s_nationkey"), _nth([k for _, k, _ in AGENTS], "s_nationkey")


def page_codes(spark, d):
    """Pages to candidate codes by short description, by offices then held or over, and by country alone."""
    kind = "s_suppkey % 4"
    s = _read(
        spark, d, "supplier", "cast(s_suppkey as string) AS key", "concat('Page ', s_suppkey) AS title", "date'2012-01-01' AS on", "cast(null as string) AS box_type",
        f"CASE {kind} WHEN 0 THEN concat({_S_DEM}, ' ', {_S_AGENT}) END AS short_desc",
        f"CASE {kind} WHEN 3 THEN concat('It (the page) is ', {_S_DEM}, ' at heart.') ELSE 'It is a page.' END AS intro_para",
        f"CASE {kind} WHEN 1 THEN map('name', 'x', 'office1', concat({_S_DEM}, ' ', {_S_AGENT}), 'term_start1', 'May 1, 2010') WHEN 2 THEN map('office', concat({_S_DEM}, ' minister'), 'termstart', '1990', 'termend', '1995') END AS infobox",
        "cast(array() as array<string>) AS categories",
    )
    return A.page_to_codes(s, _lookup(spark)).select(F.col("key").cast("long").alias("s_suppkey"), "source", "code_1", "country", "office_num")


def _part_pages(spark, d):
    return _read(spark, d, "part", "p_partkey AS page_id", "p_name AS title", "array(p_brand) AS redirects", "array(p_type) AS alternative_names", "cast(null as string) AS short_desc", "concat(p_name, ' is a part of brand ', p_brand, ' and of size ', p_size, ', made of whatever was at hand.') AS intro_para", "cast(null as string) AS box_type", "cast(null as map<string,string>) AS infobox", "array(p_type) AS categories")


def page_search(spark, d):
    """Whole part types and brands searched for in all parts; the best 20 of each."""
    q = _read(spark, d, "part", "p_type AS key", "p_type AS query").unionByName(_read(spark, d, "part", "p_brand AS key", "p_brand AS query")).distinct()
    return search.search(q, search.postings(_part_pages(spark, d)), 20).select("key", "page_id", F.round("score", 4).alias("score"))


def search_options(spark, d):
    """Options of a brand search by how they bear its name, the titles each once."""
    q = _read(spark, d, "part", "p_brand AS key", "p_brand AS query").distinct()
    pages = _part_pages(spark, d)
    got = search.search_to_options(search.candidates(q, pages, search.postings(pages), 1_000_000), 1_000_000)
    return got.groupBy("key", "reason").agg(F.count("*").alias("n"), F.max("nth").alias("last"))


_TEXT = f"concat('The ', {_DEMONYM}, ' crowd met the ', {_nth([x for x, _ in DEMONYMS], '(c_custkey + 1)')}, ' guards in Zenda on Monday')"


def _stories(spark, d):
    return _read(spark, d, "customer", "cast(c_custkey as string) AS id", "array('PROTEST') AS event_type", "cast(array() as array<string>) AS event_mode", "'2012-06-20' AS pub_date", f"{_TEXT} AS event_text")


def _questions(spark):
    return spark.createDataFrame([("OTHER_", "ACTOR", "x")], "key string, attr string, question string")


def question_rounds(spark, d):
    """Three rounds of questions and their answers."""
    a = Q.answer_rounds(E.stories_to_events(_stories(spark, d)), _questions(spark), M.Models())
    return a.select("id", "attr", "round", "question", "text", "start", "end")


def event_attributes(spark, d):
    """Attributes of events, each with a text of its own."""
    best = Q.best_attributes(Q.answer_rounds(E.stories_to_events(_stories(spark, d)), _questions(spark), M.Models()))
    return best.select("id", "attr", "text")


def coded_stories(spark, d):
    """Stories to coded events, as one plan."""
    t = {"questions": _questions(spark), "agents": _agents(spark), "countries": _countries(spark), "pages": _no_pages(spark), "places": spark.createDataFrame(PLACES, "name string, country_code3 string, feature_code string, lat double, lon double, population long")}
    c = pipeline.code_stories(_stories(spark, d), **t)
    actor = lambda k, f: F.get(F.transform(F.element_at("actors", k), lambda s: s[f]), F.lit(0)).alias(f"{k.lower()}_{f}")
    geo = F.col("event_geolocation.geo")
    return c.select("id", actor("ACTOR", "country"), actor("ACTOR", "country_name"), actor("RECIP", "country"), F.col("event_geolocation.reason").alias("reason"), geo["resolved_placename"].alias("place"), geo["country_name"].alias("place_country"), "date_resolved", "date_raw")


def classify_vectors(spark, d):
    """Labels of vectors by logistic models."""
    return M.classify(_read(spark, d, "embeddings", "vec_id", "embedding"), WEIGHTS, 0.6).select("vec_id", F.array_join("event_type", ",").alias("labels"))


WEIGHTS = {name: ([((i * 7 + k * 3) % 5 - 2) / 2 for i in range(64)], k / 4 - 0.25) for k, name in enumerate(("PROTEST", "ASSAULT", "COERCE"))}


def plain_letters(spark, d):
    """letters without marks."""
    t = _read(spark, d, "customer", "c_custkey", "concat('Ñandú Nguyễn ', c_name, ' Łódź') AS x")
    return t.select("c_custkey", L.without_marks("x").alias("unmarked"), L.transliterate("x").alias("plain"))


def text_features(spark, d):
    """F8, F11, F16, F29, F31."""
    t = _read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "cast(p_size as double) / 50 AS s")
    soft = L.softmax(F.array(F.col("s"), F.lit(0.5), -F.col("s")))
    return t.select(
        "p_partkey",
        L.first_line_outside_parentheses(F.concat(F.col("p_name"), F.lit(" (also\n called) "), F.col("p_brand"), F.lit("\nmore"))).alias("first_line"),
        L.format_fields(F.lit("{name} by {maker}, {none}"), name=F.col("p_name"), maker=F.col("p_brand"), none=F.lit(None)).alias("sentence"),
        F.round(soft[0], 6).alias("soft"),
        L.argmax(soft).cast("int").alias("best"),
        L.ranker_text(F.col("p_name"), (F.array("p_brand", "p_type"),)).alias("ranker"),
        F.array_join(L.clean_entries(F.array(F.concat("p_type", F.lit(" (disambiguation)")), F.col("p_type"), F.concat("p_name", F.lit("#1")))), ";").alias("entries"),
    )


def answer_lists(spark, d):
    """A1: answers of an event and attribute as a list in order."""
    a = _read(spark, d, "lineitem", "cast(l_orderkey as string) AS id", "concat('A', l_linenumber % 3) AS attr", "l_linenumber AS round", "cast(l_partkey as string) AS question", "cast(l_suppkey as string) AS text", "l_discount AS score", "0 AS start", "1 AS end")
    return Q.grouped_answers(a).select("id", "attr", F.array_join(F.transform("answers", lambda x: x["text"]), ";").alias("texts"))


def entity_roll_ups(spark, d):
    """People and places of a story, distinct."""
    e = _read(spark, d, "lineitem", "l_orderkey AS id", "struct(concat('e', l_suppkey % 9) AS text, CASE l_linenumber % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'FAC' ELSE 'ORG' END AS label) AS e")
    docs = e.groupBy("id").agg(F.collect_list("e").alias("ents"))
    j = E.join_docs(_read(spark, d, "orders", "o_orderkey AS id"), docs)
    return j.select("id", *(F.array_join(c, ",").alias(c) for c in ("story_people", "story_organizations", "story_places")))


def missing_docs(spark, d):
    """Stories without a document."""
    return E.without_doc(_read(spark, d, "customer", "c_custkey AS id"), _read(spark, d, "orders", "o_custkey AS id", "o_orderpriority").where("o_orderpriority = '1-URGENT'"))


def joined_actors(spark, d):
    """an answer split at its conjunction."""
    name = lambda p: f"concat('{p}', s_suppkey)"
    token = lambda i, idx, text, dep, head: f"struct({i} AS i, cast({idx} as int) AS idx, {text} AS text, ' ' AS ws, '{dep}' AS dep, {head} AS head)"
    one, two = name("Foo"), name("Bar")
    t = _read(spark, d, "supplier", "s_suppkey", f"concat({one}, ' and big ', {two}) AS text", f"array({token(0, '0', one, 'nsubj', 0)}, {token(1, f'length({one}) + 1', chr(39) + 'and' + chr(39), 'cc', 0)}, {token(2, f'length({one}) + 5', chr(39) + 'big' + chr(39), 'amod', 3)}, {token(3, f'length({one}) + 9', two, 'conj', 0)}) AS tokens")
    spans = t.select("s_suppkey", F.posexplode(split_actors("tokens", "text", F.lit(0), F.length("text"))).alias("n", "s"))
    return spans.select("s_suppkey", "n", "s.text", "s.qa_start_char", "s.qa_end_char")


def articles(spark, d):
    """Wiki pages to the encyclopedia table, with their redirects."""
    text = """replace(concat('{{Short description|about ', page_id, '}}\n{{Infobox person\n| name = Nom ', page_id, '\n| leaders = A', page_id, ', B\n| map = x\n}}\n@@T', page_id, '@@  (born once) is one of [[many|several]] pages.\n== More ==\n[[Category:Pages of ', page_id % 3, ']]\n'), '@@', "'''")"""
    p = _read(spark, d, "pages", "CASE page_id % 10 WHEN 0 THEN concat('List of ', page_id) ELSE concat('T', page_id) END AS title", f"CASE page_id % 10 WHEN 1 THEN concat('#REDIRECT [[T', page_id + 1, ']]') ELSE {text} END AS text")
    a = P.parse_articles(p, build_links(p))
    join = lambda c: F.array_join(F.array_sort(c), ";").alias(c)
    return a.select("title", "short_desc", "intro_para", join("alternative_names"), join("redirects"), join("affiliated_people"), "box_type", F.array_join(F.array_sort(F.map_keys("infobox")), ";").alias("keys"), join("categories"))


def negative_pairs(spark, d):
    """How many other groups each group is paired with."""
    g = _read(spark, d, "customer", "concat('n', c_nationkey) AS key", "c_name").groupBy("key").agg(F.collect_set("c_name").alias("names"))
    return pairs.negative_pairs(g, 10).groupBy("key").agg(F.count_distinct("other").alias("n_others"), F.bool_and(F.col("key") != F.col("other")).alias("apart"))


def story_prompts(spark, d):
    """Prompts of all titles that aren't blank."""
    h = _read(spark, d, "part", "p_brand AS event", "p_type AS mode", "CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS title").distinct()
    return M.story_prompts(h, ["AP", "AFP"], ["Zenda"]).select("event", "mode", "title", "prompt")


QUERIES = {f.__name__: f for f in (country_table, country_names, short_text_agents, actor_codes, page_codes, page_search, search_options, question_rounds, event_attributes, coded_stories, classify_vectors, plain_letters, text_features, answer_lists, entity_roll_ups, missing_docs, joined_actors, articles, negative_pairs, story_prompts)}

_EV = f"SELECT c_custkey, c_custkey || '_PROTEST_' AS id, {_DEMONYM} AS a, {_nth([x for x, _ in DEMONYMS], '(c_custkey + 1)')} AS r, {_CODE3} AS ac, {_nth([c for _, c in DEMONYMS], '(c_custkey + 1)')} AS rc, {_TEXT} AS t FROM customer"
_BM25 = r"""p AS (SELECT p_partkey AS page_id, p_name, p_brand, p_type FROM part),
f AS (SELECT page_id, 'title' AS field, 50.0 AS boost, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM p
  UNION ALL SELECT page_id, 'redirects', 50.0, list_filter(regexp_split_to_array(lower(p_brand), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') FROM p
  UNION ALL SELECT page_id, 'alternative_names', 1.0, list_filter(regexp_split_to_array(lower(p_type), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') FROM p),
t AS (SELECT page_id, field, boost, len(w) AS l, unnest(w) AS term FROM f), tf AS (SELECT page_id, field, boost, l, term, count(*) AS tf FROM t GROUP BY ALL),
ln AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM f WHERE len(w) > 0 GROUP BY field), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT k AS key FROM (SELECT p_type AS k FROM part UNION ALL SELECT p_brand FROM part)),
w AS (SELECT DISTINCT key, unnest(list_filter(regexp_split_to_array(lower(key), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')) AS term FROM q), n AS (SELECT key, count(*) AS n FROM w GROUP BY key),
s AS (SELECT key, page_id, field, count(*) AS c, sum(boost * ln(1 + (ln.n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)))) AS score FROM w JOIN tf USING (term) JOIN df USING (term, field) JOIN ln USING (field) GROUP BY ALL),
h AS (SELECT s.key, page_id, round(max(score), 6) AS score FROM s JOIN n USING (key) WHERE c = n.n GROUP BY ALL)"""

SQL = {
    "country_table": f"SELECT c_custkey, {_CODE3} AS country, lower(c_mktsegment) || ' 21' AS remainder FROM customer",
    "country_names": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ruritania' WHEN 1 THEN 'Intergovernmental Organization' ELSE '' END AS country_name FROM customer",
    "short_text_agents": f"SELECT c_custkey, {_CODE3} AS country, {_ROLE1} AS code_1, {_ROLE2} AS code_2, {_AGENT} AS pattern FROM customer",
    "actor_codes": f"""WITH {_FINAL}, x2 AS (SELECT c_custkey, {_CODE3} AS c FROM customer)
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN CASE WHEN length(c) = 6 THEN substr(c, 1, 3) ELSE c END ELSE country END AS country, CASE WHEN c_nationkey % 5 = 0 THEN CASE WHEN length(c) = 6 THEN substr(c, 4, 3) ELSE '' END ELSE code_1 END AS code_1,
  CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE k2 END AS code_2, CASE WHEN c_nationkey % 5 = 0 THEN 'country only' ELSE 'sure agent' END AS reason FROM z JOIN x2 USING (c_custkey)""",
    "page_codes": f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Wiki short description' WHEN 3 THEN 'Wiki' ELSE 'Infobox' END AS source, CASE s_suppkey % 4 WHEN 2 THEN 'ELI' WHEN 3 THEN '' ELSE {_S_ROLE} END AS code_1,
  {_S_CODE} AS country, CASE s_suppkey % 4 WHEN 1 THEN 1 END AS office_num FROM supplier""",
    "page_search": f"WITH {_BM25} SELECT key, page_id, round(score, 4) AS score FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, page_id) <= 20",
    "search_options": """WITH o AS (SELECT DISTINCT p_brand AS key, p_name FROM part) SELECT key, 'redirect' AS reason, count(*) AS n, count(*) - 1 AS last FROM o GROUP BY key""",
    "question_rounds": f"""WITH e AS ({_EV}), w(attr, round, question) AS (VALUES ('ACTOR', 1, 'Who did the protest to someone?'), ('LOC', 1, 'Where did the protest take place?'), ('DATE', 1, 'When did the protest take place?'), ('RECIP', 1, 'Who was the target of the protest?'),
  ('RECIP', 2, 'Who was the target of the protest?'), ('ACTOR', 3, 'Who did the protest to someone?')),
x AS (SELECT id, attr, round, question, t, CASE attr WHEN 'ACTOR' THEN a WHEN 'RECIP' THEN r WHEN 'LOC' THEN 'Zenda' ELSE 'on Monday' END AS text, CASE attr WHEN 'ACTOR' THEN 4 WHEN 'RECIP' THEN length(a) + 19 WHEN 'LOC' THEN length(t) - 15 ELSE length(t) - 9 END AS s FROM e, w)
SELECT id, attr, round, question, text, CAST(s AS INT) AS start, CAST(s + length(text) AS INT) AS "end" FROM x""",
    "event_attributes": f"WITH e AS ({_EV}) SELECT id, unnest(['ACTOR', 'RECIP', 'LOC', 'DATE']) AS attr, unnest([a, r, 'Zenda', 'on Monday']) AS text FROM e",
    "coded_stories": f"""WITH e AS ({_EV}) SELECT id, left(ac, 3) AS actor_country, CASE left(ac, 3) WHEN 'RUR' THEN 'Ruritania' WHEN 'FRD' THEN 'Freedonia' WHEN 'SYL' THEN 'Sylvania' ELSE '' END AS actor_country_name, left(rc, 3) AS recip_country,
  'matched' AS reason, 'Zenda' AS place, 'Ruritania' AS place_country, '2012-06-18' AS date_resolved, 'on Monday' AS date_raw FROM e""",
    "classify_vectors": "SELECT vec_id, concat_ws(',', " + ", ".join(f"CASE WHEN 1 / (1 + exp(-(list_inner_product(CAST(embedding AS DOUBLE[]), {w}::DOUBLE[]) + {b}))) > 0.6 THEN '{name}' END" for name, (w, b) in WEIGHTS.items()) + ") AS labels FROM embeddings",
    "plain_letters": "SELECT c_custkey, 'Nandu Nguyen ' || c_name || ' Łodz' AS unmarked, 'Nandu Nguyen ' || c_name || ' Lodz' AS plain FROM customer",
    "text_features": """WITH t AS (SELECT *, CAST(p_size AS DOUBLE) / 50 AS s FROM part)
SELECT p_partkey, p_name || '  ' || p_brand AS first_line, p_name || ' by ' || p_brand || ', ' AS sentence, round(exp(s) / (exp(s) + exp(0.5) + exp(-s)), 6) AS soft, CASE WHEN s >= 0.5 THEN 0 ELSE 1 END AS best, p_name || p_brand || ', ' || p_type AS ranker, p_type AS entries FROM t""",
    "answer_lists": "SELECT CAST(l_orderkey AS VARCHAR) AS id, 'A' || (l_linenumber % 3) AS attr, string_agg(CAST(l_suppkey AS VARCHAR), ';' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_discount) AS texts FROM lineitem GROUP BY ALL",
    "entity_roll_ups": """WITH e AS (SELECT l_orderkey AS id, 'e' || (l_suppkey % 9) AS t, l_linenumber % 4 AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT id, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (k = 0), '') AS story_people, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (k = 3), '') AS story_organizations, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (k IN (1, 2)), '') AS story_places FROM e GROUP BY id""",
    "missing_docs": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "joined_actors": """WITH s AS (SELECT s_suppkey, length('Foo' || s_suppkey) AS l FROM supplier)
SELECT s_suppkey, 0 AS n, 'Foo' || s_suppkey || ' ' || 'Bar' || s_suppkey AS text, 0 AS qa_start_char, CAST(2 * l + 9 AS INT) AS qa_end_char FROM s
UNION ALL SELECT s_suppkey, 1, 'big Bar' || s_suppkey, CAST(l + 5 AS INT), CAST(2 * l + 9 AS INT) FROM s""",
    "articles": """WITH p AS (SELECT page_id FROM pages WHERE page_id % 10 NOT IN (0, 1))
SELECT 'T' || page_id AS title, 'about ' || page_id AS short_desc, 'T' || page_id || '   is one of several pages.' AS intro_para, 'Nom ' || page_id || ';T' || page_id AS alternative_names, CASE WHEN page_id % 10 = 2 AND page_id - 1 IN (SELECT page_id FROM pages) THEN 'T' || (page_id - 1) ELSE '' END AS redirects,
  'A' || page_id || ';B' AS affiliated_people, 'person' AS box_type, 'leaders;name' AS keys, 'Pages of ' || (page_id % 3) AS categories FROM p""",
    "negative_pairs": "WITH g AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT 'n' || k AS key, least(10, (SELECT count(*) FROM g) - 1) AS n_others, true AS apart FROM g",
    "story_prompts": """WITH h AS (SELECT DISTINCT p_brand AS event, p_type AS mode, p_name AS title FROM part WHERE p_size % 5 <> 0), s(source) AS (VALUES ('AP'), ('AFP'))
SELECT event, mode, title, 'Write a news story by ' || source || ': ' || title AS prompt FROM h, s UNION ALL SELECT event, mode, title, source || ' reports from Zenda. Headline: ' || title FROM h, s""",
}
