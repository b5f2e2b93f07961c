"""The event-coding operators as queries over the shared tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..operators import events as E
from ..operators import match as M
from ..operators.pairs import positive_pairs
from . import coding_queries as coding
from . import resolver_queries as resolver

PATTERNS = [("NATION_10", "TEN"), ("NATION_20", "TWENTY"), ("NATION_1", "ONE"), ("NATION_2", "TWO")]
WORDING = [("click_k1", "ACTOR", "Who clicked on {recip_text}?"), ("click_k1", "RECIP", "Whom did {actor_text} click?"), ("view_", "ACTOR", ""), ("view_", "LOC", "Where was {recip_text} seen?")]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stories(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    s = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("event_type"), F.array_sort(F.collect_set(F.when(F.col("k") % 2 == 1, F.concat("event_type", F.lit("-k"), (F.col("k") % 3).cast("string"))))).alias("event_mode"))
    return s.withColumn("id", F.concat_ws(":", "user_id", "day"))


STORIES = """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
t AS (SELECT DISTINCT user_id, day, event_type FROM e),
m AS (SELECT DISTINCT user_id, day, event_type, 'k' || (k % 3) AS mode FROM e WHERE k % 2 = 1),
x AS (SELECT t.user_id || ':' || t.day AS orig_id, t.event_type, coalesce(m.mode, '') AS event_mode
      FROM t LEFT JOIN m ON t.user_id = m.user_id AND t.day = m.day AND t.event_type = m.event_type)
"""


def explode_events(spark, d):
    return E.stories_to_events(_stories(spark, d)).select("id", "orig_id", "event_type", "event_mode")


def question_fill(spark, d):
    return E.fill_questions(E.stories_to_events(_stories(spark, d)), spark.createDataFrame(WORDING, "key string, attr string, question string"))


def type_without_question(spark, d):
    types = read(spark, d, "events").select("event_type").distinct()
    asked = spark.createDataFrame([(k.split("_")[0],) for k, _, _ in WORDING], "event_type string")
    return types.join(asked, "event_type", "left_anti")


def country_grep(spark, d):
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.select("c_custkey", F.concat(F.lit("the "), "n_name", F.lit(" soldier")).alias("text"))
    return M.grep_country(rows, PATTERNS)


def flagship(spark, d):
    """Stories -> events -> country of the actor -> final codes -> counts by type and country."""
    users = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.concat(F.lit("the "), "n_name", F.lit(" soldier")).alias("text"))
    coded = M.grep_country(users, PATTERNS)
    country, code = T.clean_best(F.col("country"), F.lit("MIL"))
    e = E.stories_to_events(_stories(spark, d)).withColumn("nation", F.split("orig_id", ":")[0].cast("long") % 25)
    e = e.join(F.broadcast(coded), "nation").select("event_type", country.alias("country"), code.alias("code_1"))
    return e.groupBy("event_type", "country", "code_1").agg(F.count("*").alias("n_events"))


def clean_query(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.element_at(F.array(F.lit("the "), F.lit("12th "), F.lit("A "), F.lit("an  "), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name", F.when(F.col("p_partkey") % 3 == 0, "'s").otherwise("")).alias("text"))
    return p.select("p_partkey", T.clean_query(F.col("text")).alias("cleaned"))


def _vectors(spark, d):
    """Vectors in whole thousandths: sums of whole doubles are exact in any order, so both engines get equal cosines."""
    return read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("embedding"))


def _agents(spark, d):
    e = _vectors(spark, d).select("label", F.posexplode("embedding"))
    c = e.groupBy("label", "pos").agg(F.round(F.avg("col")).alias("v"))
    return c.groupBy(F.col("label").alias("agent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("agent_vector"))


AGENTS = """
WITH u AS (SELECT vec_id, label, round(unnest(embedding)::DOUBLE * 1000) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS agent, pos, round(avg(x)) AS v FROM u GROUP BY ALL),
s AS (SELECT vec_id, agent, round(sum(x::DOUBLE * v) / (sqrt(sum(x::DOUBLE * x::DOUBLE)) * sqrt(sum(v * v))), 6) AS sim FROM u JOIN c USING (pos) GROUP BY ALL)
"""


def nearest_agent(spark, d):
    out = M.nearest(_vectors(spark, d).select("vec_id", "embedding"), _agents(spark, d), 0.1)
    return out.select("vec_id", "agent", "sim")


def threshold_labels(spark, d):
    out = M.labels_above(_vectors(spark, d).select("vec_id", "embedding"), _agents(spark, d), 0.1)
    return out.select("vec_id", F.array_join("labels", ",").alias("labels"))


def span_overlap(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("s"), F.col("l_quantity").cast("long").alias("n"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("s2"), (F.col("o_custkey") % 50 + 20).alias("e2"))
    j = F.round(T.span_jaccard(F.col("s"), F.col("s") + F.col("n"), F.col("s2"), F.col("e2")), 6)
    x = li.join(o, "l_orderkey").withColumn("j", j).where("j >= 0.5")
    return x.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("j", -F.col("l_linenumber"))).alias("line"), F.max("j").alias("overlap"))


def _answers(spark, d, attrs=3):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), (F.col("l_linenumber") % attrs).cast("int").alias("attr"), (F.col("l_suppkey") % 7).alias("text"), F.col("l_discount").alias("score"))


def answer_sum(spark, d):
    return E.sum_answers(_answers(spark, d))


def pivot_scores(spark, d):
    return E.pivot_scores(E.sum_answers(_answers(spark, d)), [0, 1, 2])


def assign_best(spark, d):
    answers = _answers(spark, d, 4)
    return E.assign_best(E.sum_answers(answers), [0, 1, 2, 3])


def keep_last_whole_question(spark, d):
    """The last turn of each whole question text of a conversation."""
    c = read(spark, d, "conversations").withColumnRenamed("text", "question")
    return E.keep_last(c, ["conv_id", "question"], ["turn"]).select("conv_id", "question", "turn")


def most_common_first_seen(spark, d):
    return M.most_common_first(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey")


def code_priority(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_partkey", F.element_at(F.array(*map(F.lit, ["GOV", "MIL", "CVL", "ZZZ", "JRN"])), (F.col("p_size") % 5 + 1).cast("int")).alias("code"))
    w = W.partitionBy("p_brand").orderBy(T.code_priority(F.col("code")).desc(), "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").select("p_brand", "code", "p_partkey")


def clean_best(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.element_at(F.array(F.lit("GEOPRE"), F.lit("USA"), F.lit(None).cast("string")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("country"), F.element_at(F.array(*map(F.lit, ["IGO", "JNK", "GOV", "NGO", "MNC"])), (F.col("c_custkey") % 5 + 1).cast("int")).alias("code"))
    country, code = T.clean_best(F.col("country"), F.col("code"))
    return c.select("c_custkey", country.alias("country"), code.alias("code_1"))


def active_office(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderdate").alias("start"))
    o = o.withColumn("end", F.lead("start").over(W.partitionBy("key").orderBy("start", "o_orderkey")))
    at = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.expr("TIMESTAMP_NTZ '1995-06-17 00:00:00'").alias("at"))
    return M.active_terms(o, at, "key").select("key", "o_orderkey")


def fulltext_all_terms(spark, d):
    """Documents that hold every distinct term of the whole item text, the best 200."""
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    q = read(spark, d, "benchmark").where("item_id is not null").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return M.search_whole_items(q, read(spark, d, "documents").select("doc_id", "text"), 200)


def canonical_page(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"[#?].*$", ""), r"^https?://", ""), r"^(www|m|blog)\.", "").alias("canonical"))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_redirects"))


def page_filters(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"))
    return p.where(~F.col("title").rlike(r"\.(jpg|png)$|-stub|^User|^List |^Portal ") & (F.length("title") > 10)).select("page_id", "title")


def page_predicates(spark, d):
    """P11, P12 and P13 as wholes, on the title and the first paragraph of each page."""
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1)).alias("intro"))
    t, i = F.col("title"), F.col("intro")
    return p.select("page_id", P.dump_title(t).alias("dump_title"), P.dump_intro(i).alias("dump_intro"), P.candidate_page(t, i).alias("candidate"))


def sentence_context(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.get(F.split("text", " "), F.lit(2)).alias("actor")).where("actor is not null")
    return M.first_sentence_with(docs, F.col("actor")).select("doc_id", "sentence")


def relative_date(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("pub"), F.element_at(F.array(*map(F.lit, ["today", "yesterday", "3 days ago", "2 weeks ago", "last month", "2012-06-20", "last sunday", "next friday"])), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("phrase"))
    return o.select("o_orderkey", T.resolve_date(F.col("phrase"), F.col("pub")).alias("resolved"))


def wide_table(spark, d):
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    g = n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("actors"), F.count("*").cast("string").alias("n"))
    return g.unpivot(["r_name"], ["actors", "n"], "attribute", "value")


def pair_combinations(spark, d):
    groups = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_set("n_name").alias("names"))
    return positive_pairs(groups).select("a", "b")


QUERIES = {f.__name__: f for f in (flagship, explode_events, question_fill, type_without_question, country_grep, clean_query, nearest_agent, threshold_labels, span_overlap, answer_sum, pivot_scores, assign_best, keep_last_whole_question, most_common_first_seen, code_priority, clean_best, active_office, fulltext_all_terms, canonical_page, page_filters, page_predicates, sentence_context, relative_date, wide_table, pair_combinations)}

_CODE = "CASE WHEN n_name LIKE 'NATION_10%' THEN 'TEN' WHEN n_name LIKE 'NATION_20%' THEN 'TWENTY' WHEN n_name LIKE 'NATION_1%' THEN 'ONE' WHEN n_name LIKE 'NATION_2%' THEN 'TWO' END"
_REST = "CASE WHEN n_name LIKE 'NATION_10%' THEN substr(n_name, 10) WHEN n_name LIKE 'NATION_20%' THEN substr(n_name, 10) WHEN n_name LIKE 'NATION_1%' THEN substr(n_name, 9) WHEN n_name LIKE 'NATION_2%' THEN substr(n_name, 9) END"
_SUMS = "SELECT l_orderkey AS event, CAST(l_linenumber % 3 AS INT) AS attr, l_suppkey % 7 AS text, round(sum(l_discount), 6) AS score FROM lineitem GROUP BY ALL"

SQL = {
    "flagship": STORIES
    + f"""SELECT event_type, coalesce({_CODE}, '') AS country, 'MIL' AS code_1, count(*) AS n_events
FROM x JOIN nation ON CAST(split_part(orig_id, ':', 1) AS BIGINT) % 25 = n_nationkey GROUP BY ALL""".replace(_CODE, f"CASE WHEN length({_CODE}) = 6 THEN left({_CODE}, 3) ELSE {_CODE} END").replace("'MIL' AS code_1", f"CASE WHEN length({_CODE}) = 6 THEN substr({_CODE}, 4, 3) ELSE 'MIL' END AS code_1"),
    "explode_events": STORIES + "SELECT orig_id || '_' || event_type || '_' || event_mode AS id, orig_id, event_type, event_mode FROM x",
    "question_fill": STORIES
    + """, a(attr, wording) AS (VALUES ('ACTOR', 'Who did the {type} to someone?'), ('LOC', 'Where did the {type} take place?'), ('DATE', 'When did the {type} take place?'), ('RECIP', 'Who was the target of the {type}?')),
q(key, attr, question) AS (VALUES ('click_k1', 'ACTOR', 'Who clicked on someone?'), ('click_k1', 'RECIP', 'Whom did someone click?'), ('view_', 'ACTOR', ''), ('view_', 'LOC', 'Where was someone seen?'))
SELECT orig_id || '_' || event_type || '_' || event_mode AS id, a.attr,
  CASE WHEN event_type || '_' || event_mode IN ('click_k1', 'view_') THEN q.question ELSE replace(wording, '{type}', lower(event_type)) END AS question
FROM x CROSS JOIN a LEFT JOIN q ON q.key = event_type || '_' || event_mode AND q.attr = a.attr
WHERE (CASE WHEN event_type || '_' || event_mode IN ('click_k1', 'view_') THEN q.question ELSE 'x' END) <> ''""",
    "type_without_question": "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')",
    "country_grep": f"""SELECT c_custkey, 'the ' || n_name || ' soldier' AS text, {_CODE} AS country,
CASE WHEN {_CODE} IS NULL THEN 'the ' || n_name || ' soldier' ELSE trim(regexp_replace(regexp_replace(trim(regexp_replace('the ' || {_REST} || ' soldier', ' +', ' ', 'g')), '^the ', ''), '^\\d+? ', '')) END AS remainder
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "clean_query": r"""WITH p AS (SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 'the ' WHEN 1 THEN '12th ' WHEN 2 THEN 'A ' WHEN 3 THEN 'an  ' ELSE '' END) || p_name || (CASE WHEN p_partkey % 3 = 0 THEN '''s' ELSE '' END) AS t FROM part),
a AS (SELECT p_partkey, regexp_replace(trim(t), ' +', ' ', 'g') AS t FROM p),
b AS (SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(t, '^the ', '')), '^[Aa]n ', '')), '^[Aa] ', '')), ' of$', '')) AS t FROM a),
c AS (SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '(\d\d)(st|nd|rd|th)\b', '\1', 'g'), '(\d)(st|nd|rd|th)\b', '\1', 'g'), '^\d+? ', '')), '''s$', '')) AS t FROM b)
SELECT p_partkey, CASE WHEN length(t) < 2 THEN '' ELSE t END AS cleaned FROM c""",
    "nearest_agent": AGENTS + "SELECT vec_id, CASE WHEN max(sim) >= 0.1 THEN arg_max(agent, (sim, -agent)) END AS agent, max(sim) AS sim FROM s GROUP BY vec_id",
    "threshold_labels": AGENTS + "SELECT vec_id, coalesce(string_agg(agent::VARCHAR, ',' ORDER BY agent) FILTER (sim > 0.1), '') AS labels FROM s GROUP BY vec_id",
    "span_overlap": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS s, l_partkey % 50 + CAST(l_quantity AS BIGINT) AS e, o_custkey % 50 AS s2, o_custkey % 50 + 20 AS e2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT l_orderkey, l_linenumber, greatest(0, least(e, e2) - greatest(s, s2)) AS i, e - s + e2 - s2 AS u FROM x), z AS (SELECT l_orderkey, l_linenumber, round(i / (u - i), 6) AS j FROM y)
SELECT l_orderkey, arg_max(l_linenumber, (j, -l_linenumber)) AS line, max(j) AS overlap FROM z WHERE j >= 0.5 GROUP BY l_orderkey""",
    "answer_sum": _SUMS,
    "pivot_scores": f"""SELECT event, text, round(coalesce(sum(score) FILTER (attr = 0), 0), 6) AS attr_0, round(coalesce(sum(score) FILTER (attr = 1), 0), 6) AS attr_1, round(coalesce(sum(score) FILTER (attr = 2), 0), 6) AS attr_2
FROM ({_SUMS}) GROUP BY event, text""",
    "assign_best": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY event, attr ORDER BY score DESC, text) AS r FROM ({_SUMS.replace("% 3", "% 4")}) WHERE score > 0), e AS (SELECT DISTINCT event FROM s),
o AS (SELECT event, attr, text, score, r FROM s UNION ALL SELECT event, a, NULL, 0, 100 FROM e CROSS JOIN (VALUES (0), (1), (2), (3)) v(a)),
c AS (SELECT w.event, w.score + x.score + y.score + z.score AS total, w.r AS r0, x.r AS r1, y.r AS r2, z.r AS r3, [w.text, x.text, y.text, z.text] AS ts, [w.score, x.score, y.score, z.score] AS ss
  FROM o w JOIN o x ON w.event = x.event JOIN o y ON w.event = y.event JOIN o z ON w.event = z.event WHERE w.attr = 0 AND x.attr = 1 AND y.attr = 2 AND z.attr = 3
  AND w.text IS DISTINCT FROM coalesce(x.text, -1) AND w.text IS DISTINCT FROM coalesce(y.text, -1) AND w.text IS DISTINCT FROM coalesce(z.text, -1)
  AND x.text IS DISTINCT FROM coalesce(y.text, -1) AND x.text IS DISTINCT FROM coalesce(z.text, -1) AND y.text IS DISTINCT FROM coalesce(z.text, -1)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event ORDER BY total DESC, r0, r1, r2, r3) = 1),
u AS (SELECT event, unnest([0, 1, 2, 3]) AS attr, unnest(ts) AS text, unnest(ss) AS score FROM b)
SELECT event, attr, CAST(text AS VARCHAR) AS text, CAST(score AS DOUBLE) AS score FROM u WHERE text IS NOT NULL""",
    "keep_last_whole_question": "SELECT conv_id, text AS question, max(turn) AS turn FROM conversations GROUP BY ALL",
    "most_common_first_seen": "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_custkey, arg_max(o_orderpriority, (n, -f)) AS o_orderpriority, max(n) AS n FROM c GROUP BY o_custkey",
    "code_priority": """WITH p AS (SELECT p_brand, p_partkey, ['GOV', 'MIL', 'CVL', 'ZZZ', 'JRN'][p_size % 5 + 1] AS code, [100, 80, 10, 0, 40][p_size % 5 + 1] AS r FROM part)
SELECT p_brand, code, p_partkey FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r DESC, p_partkey) = 1""",
    "clean_best": """WITH c AS (SELECT c_custkey, ['GEOPRE', 'USA', NULL][c_custkey % 3 + 1] AS y, ['IGO', 'JNK', 'GOV', 'NGO', 'MNC'][c_custkey % 5 + 1] AS k FROM customer),
b AS (SELECT c_custkey, CASE WHEN k = 'JNK' THEN '' WHEN k IN ('IGO', 'NGO', 'MNC') THEN k ELSE coalesce(y, '') END AS y, CASE WHEN k IN ('IGO', 'NGO', 'MNC') THEN '' ELSE k END AS k FROM c)
SELECT c_custkey, CASE WHEN length(y) = 6 THEN left(y, 3) ELSE y END AS country, CASE WHEN length(y) = 6 THEN substr(y, 4, 3) ELSE k END AS code_1 FROM b""",
    "active_office": """WITH o AS (SELECT o_custkey AS key, o_orderkey, o_orderdate AS s, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders)
SELECT key, o_orderkey FROM o JOIN customer ON c_custkey = key WHERE s < TIMESTAMP '1995-06-17' AND (e IS NULL OR e > TIMESTAMP '1995-06-17')""",
    "fulltext_all_terms": r"""WITH q AS (SELECT item_id AS query_id, regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(w) AS term FROM q) WHERE term <> ''), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM t) GROUP BY ALL),
h AS (SELECT query_id, doc_id, count(*) AS c, CAST(sum(tf) AS BIGINT) AS score FROM tf JOIN t USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h JOIN n USING (query_id) WHERE c = n QUALIFY rank <= 200""",
    "canonical_page": r"SELECT regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '^https?://', ''), '^(www|m|blog)\.', '') AS canonical, min(page_id) AS page_id, count(*) AS n_redirects FROM pages GROUP BY ALL",
    "page_filters": r"WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages) SELECT page_id, title FROM p WHERE NOT regexp_matches(title, '\.(jpg|png)$|-stub|^User|^List |^Portal ') AND length(title) > 10",
    "page_predicates": r"""WITH p AS (SELECT page_id, coalesce(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS t, html IS NULL AS no_page, trim(coalesce(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '')) AS i FROM pages)
SELECT page_id, NOT (t LIKE '%.jpg' OR t LIKE '%.png' OR contains(t, '-stub') OR t LIKE 'User%' OR t LIKE 'Selected anniversaries%' OR contains(t, '(disambiguation)') OR contains(t, '(Disambiguation)')
  OR contains(t, 'Articles for deletion') OR t LIKE 'List %' OR t LIKE 'Portal %' OR contains(t, 'Today''s featured article') OR contains(t, 'Featured article candidates') OR t LIKE 'Peer review/%'
  OR t LIKE 'Requests for adminship/%' OR t LIKE 'Featured list candidates/%' OR t LIKE 'Sockpuppet investigations/%' OR t LIKE 'Categories for%') AS dump_title,
 no_page OR NOT (i = '' OR ltrim(i, '#') LIKE 'redirect%' AND i NOT LIKE '##%' OR ltrim(i, '#') LIKE 'REDIRECT%' AND i NOT LIKE '##%' OR ltrim(i, '#') LIKE 'Redirect%' AND i NOT LIKE '##%' OR contains(i, 'Category:') OR i LIKE '<noinclude>%'
  OR contains(left(i, 100), 'may refer to') OR contains(left(i, 100), 'most often refers') OR contains(left(i, 100), 'most commonly refers') OR contains(left(i, 100), 'portal:') OR contains(left(i, 100), 'Portal:')) AS dump_intro,
 NOT (contains(t, 'stub') OR contains(t, 'User') OR contains(t, 'Wikipedia:') OR contains(t, 'disambiguation') OR contains(left(i, 50), 'Category:') OR contains(left(i, 50), 'is the name of') OR contains(left(i, 50), 'may refer to')
  OR contains(left(i, 50), 'can refer to') OR contains(left(i, 50), 'most commonly refers to') OR contains(left(i, 50), 'is a surname') OR contains(left(i, 80), 'usually refers to')) AND length(i) > 50 AND regexp_matches(i, '\S') AS candidate FROM p""",
    "sentence_context": r"""WITH d AS (SELECT doc_id, text, string_split(text, ' ')[3] AS actor FROM documents)
SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '\. |\n'), lambda s: contains(s, actor))[1], '') AS sentence FROM d WHERE actor IS NOT NULL""",
    "relative_date": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 0 THEN p WHEN 1 THEN p - 1 WHEN 2 THEN p - 3 WHEN 3 THEN p - 14 WHEN 4 THEN p - INTERVAL 1 MONTH WHEN 5 THEN DATE '2012-06-20'
  WHEN 6 THEN p - CAST((CASE WHEN isodow(p) = 7 THEN 7 ELSE isodow(p) END) AS INT) ELSE p + CAST(((5 - isodow(p) + 6) % 7 + 1) AS INT) END AS DATE) AS resolved FROM o""",
    "wide_table": """WITH g AS (SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS actors, CAST(count(*) AS VARCHAR) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT r_name, 'actors' AS attribute, actors AS value FROM g UNION ALL SELECT r_name, 'n', n FROM g""",
    "pair_combinations": "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name",
}

QUERIES |= resolver.QUERIES | coding.QUERIES
SQL |= resolver.SQL | coding.SQL
