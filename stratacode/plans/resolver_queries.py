"""The resolver ladders as queries over the shared tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..operators import resolve as R


def _at(values: list[str], index: str) -> str:
    """SQL for the value at ``index``, counted from 0."""
    return "CASE " + index + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Both engines read these columns from the same text.
_CODES = f"""l_orderkey AS key, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS ord, l_suppkey % 3 AS office_num,
{_at(["Infobox", "Infobox Type", "Wiki short description", "BERT matching on non-entity text", "Wiki", "Wiki", "Wiki"], "l_partkey % 7")} AS source,
CASE WHEN l_suppkey % 3 = 0 THEN 'settlement' ELSE 'person' END AS query, {_at(["GOV", "MIL", "IGO", "", "BUS", "NON", "GOV"], "l_suppkey % 7")} AS code_1,
{_at(["", "USA", "GBR"], "(l_partkey + l_suppkey) % 3")} AS country, CASE WHEN l_partkey % 5 > 0 THEN l_discount END AS conf,
CASE WHEN l_partkey % 4 = 0 THEN 'Page' ELSE '' END AS wiki, CASE WHEN l_orderkey % 4 = 0 THEN 'FRA' ELSE '' END AS given"""
_HITS = """l_orderkey AS key, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS ord, concat('item ', CAST(l_orderkey % 3 AS STRING)) AS query, 'USA' AS country, concat(CASE WHEN l_suppkey % 2 = 0 THEN 'Item ' ELSE 'ITÉM ' END, CAST(l_partkey % 9 AS STRING)) AS title,
concat('Item ', CAST(l_suppkey % 5 AS STRING)) AS other, concat('item ', CAST(l_partkey % 4 AS STRING)) AS alias, repeat('x', CAST(l_quantity AS INT)) AS intro, l_discount AS sim, 0.85 + l_tax AS title_sim"""
_LINKS = """concat('s', CAST(o_orderkey % 7 AS STRING)) AS source, concat(CASE o_custkey % 3 WHEN 0 THEN 'page ' WHEN 1 THEN 'Page ' ELSE 'Other ' END, CAST(o_custkey % 50 AS STRING)) AS target"""


def _read(spark, d, name, columns):
    return spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*([columns] if isinstance(columns, str) else columns))


def _columns(spark, d, name, text):
    return spark.sql(f"SELECT {text} FROM {{rows}}", rows=spark.read.parquet(f"{d}/{name}.parquet"))


def choose_code(spark, d):
    return R.choose_code(_columns(spark, d, "lineitem", _CODES)).drop("ord")


def choose_page(spark, d):
    hits = _columns(spark, d, "lineitem", _HITS).withColumns({"redirects": F.array("other"), "alternative_names": F.array("alias"), "infobox_name": F.lit(None).cast("string")})
    return R.choose_page(R.page_matches(hits))


def event_location(spark, d):
    o = _read(spark, d, "orders", ["o_orderkey", "cast(o_custkey % 50 as int) as s"])
    e = _read(spark, d, "lineitem", ["l_orderkey as o_orderkey", "struct(l_linenumber as n, cast(l_partkey % 50 as int) as start_char, cast(l_partkey % 50 + l_quantity as int) as end_char, case when l_suppkey % 5 > 0 then l_discount * 10 end as score) as e"])
    e = e.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("e")).alias("ents"))
    x = o.join(e, "o_orderkey", "left").select("o_orderkey", R.event_location(F.when(F.col("s") > 4, F.col("s")), F.col("s") + 20, F.col("ents")).alias("g"))
    return x.select("o_orderkey", "g.reason", F.col("g.geo.n").alias("n"))


def title_case(spark, d):
    return _read(spark, d, "part", ["p_partkey", "concat(p_name, '-PARTY of o''brien 3rd') as x"]).select("p_partkey", P.title_case(F.col("x")).alias("titled"))


def merge_redirects(spark, d):
    return P.merge_redirects(_columns(spark, d, "orders", _LINKS)).select("target", F.array_join("sources", ",").alias("sources"))


def clean_names(spark, d):
    names = F.array(F.concat(F.lit("[["), "c_name", F.lit("|x]]")), F.concat("c_name", F.lit(":")), F.concat(F.lit("[Ñandú "), "c_mktsegment", F.lit("]")))
    return _read(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", F.array_join(P.clean_names(names), ";").alias("names"))


QUERIES = {f.__name__: f for f in (choose_code, choose_page, event_location, title_case, merge_redirects, clean_names)}

_TITLED = "concat(upper(substr(r, 1, 1)), substr(r, 2))"
SQL = {
    "choose_code": f"""WITH c AS (SELECT {_CODES} FROM lineitem),
x AS (SELECT *, struct_pack(code_1 := code_1, country := country, source := source, query := query) AS r,
  CASE code_1 WHEN 'IGO' THEN 200 WHEN 'GOV' THEN 100 WHEN 'MIL' THEN 80 WHEN 'BUS' THEN 60 WHEN 'NON' THEN 60 ELSE 0 END AS p FROM c),
pc AS (SELECT key, country, count(*) AS n, min(ord) AS f FROM c WHERE country <> '' GROUP BY ALL),
common AS (SELECT key, arg_max(country, (n, -f)) AS common FROM pc GROUP BY key),
per AS (SELECT key, code_1, p, min(ord) AS f, coalesce(arg_min(r, ord) FILTER (wiki <> ''), arg_min(r, ord)) AS best FROM x GROUP BY ALL),
ranked AS (SELECT key, arg_max(best, (p, -f)) AS ranked FROM per GROUP BY key),
a AS (SELECT key, count(*) AS n, max(given) AS given, arg_min(r, ord) AS only_one, arg_min(r, ord) FILTER (source = 'Infobox Type') AS box,
  arg_min(r, (office_num, ord)) FILTER (source = 'Infobox') AS info, count(DISTINCT code_1) FILTER (code_1 <> '') AS codes,
  count(*) FILTER (code_1 <> '' AND (wiki <> '' OR conf IS NULL)) AS unsure, arg_min(r, (-conf, ord)) FILTER (code_1 <> '') AS confident,
  arg_min(r, ord) FILTER (source = 'Wiki short description') AS short,
  count(DISTINCT country || ',' || code_1) FILTER (source LIKE 'BERT%' AND country <> '' AND code_1 <> '') AS lookups,
  arg_min(r, ord) FILTER (source LIKE 'BERT%' AND country <> '' AND code_1 <> '') AS lookup FROM x GROUP BY key),
b AS (SELECT a.*, ranked.ranked, CASE WHEN given <> '' THEN given ELSE coalesce(common, '') END AS best FROM a JOIN ranked USING (key) LEFT JOIN common USING (key)),
t AS (SELECT *, CASE WHEN n = 1 THEN 'only code' WHEN box.query = 'settlement' THEN 'settlement' WHEN info IS NOT NULL THEN 'info box' WHEN codes = 1 AND unsure = 0 THEN 'one distinct code'
  WHEN short IS NOT NULL THEN 'short description' WHEN lookups = 1 THEN 'lookups agree' ELSE 'priority' END AS tier FROM b),
w AS (SELECT *, CASE tier WHEN 'only code' THEN only_one WHEN 'settlement' THEN box WHEN 'info box' THEN info WHEN 'one distinct code' THEN confident WHEN 'short description' THEN short WHEN 'lookups agree' THEN lookup ELSE ranked END AS r FROM t)
SELECT key, tier, r.source AS source, CASE WHEN tier = 'settlement' THEN '' ELSE r.code_1 END AS code_1,
  CASE WHEN tier IN ('info box', 'short description') AND r.code_1 = 'IGO' THEN 'IGO' WHEN tier = 'only code' THEN CASE WHEN r.country <> '' THEN r.country ELSE given END
  WHEN tier IN ('settlement', 'one distinct code') AND r.country <> '' THEN r.country ELSE best END AS country FROM w""",
    "choose_page": f"""WITH h AS (SELECT {_HITS} FROM lineitem),
m AS (SELECT *, 'Item ' || query[6:] AS titled, replace(title, 'É', 'E') AS bare FROM h),
f AS (SELECT *, title IN (query, titled, upper(query)) OR bare = query AS t, other = titled AS r, alias = query AS a FROM m),
z AS (SELECT *, row_number() OVER (PARTITION BY key, a ORDER BY ord) AS nth FROM f),
g AS (SELECT key, arg_max(title, (sim, -ord)) FILTER (t) AS bt, count(*) FILTER (r) AS nr, arg_min(title, ord) FILTER (r AND length(intro) > 40) AS lr, arg_max(title, (sim, -ord)) FILTER (r) AS br,
  count(*) FILTER (a) AS na, arg_min(title, ord) FILTER (a) AS fa, arg_max(title, (title_sim, -ord)) FILTER (a AND nth <= 10 AND title_sim > 0.9) AS ba FROM z GROUP BY key),
y AS (SELECT key, bt, CASE WHEN nr = 2 AND lr IS NOT NULL THEN lr ELSE br END AS rd, CASE WHEN na = 1 THEN fa ELSE ba END AS al FROM g)
SELECT key, coalesce(bt, rd, al) AS title, CASE WHEN bt IS NOT NULL THEN 'title' WHEN rd IS NOT NULL THEN 'redirect' ELSE 'alternative' END AS tier FROM y WHERE coalesce(bt, rd, al) IS NOT NULL""",
    "event_location": """WITH o AS (SELECT o_orderkey, o_custkey % 50 AS s FROM orders),
e AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS n, l_partkey % 50 AS s2, CAST(trunc(l_partkey % 50 + l_quantity) AS BIGINT) AS e2, CASE WHEN l_suppkey % 5 > 0 THEN l_discount * 10 END AS score FROM lineitem),
j AS (SELECT o.o_orderkey, o.s, n, score, s2, e2, greatest(0, least(s + 20, e2) - greatest(s, s2)) AS i, e2 - s2 AS len FROM o LEFT JOIN e USING (o_orderkey)),
k AS (SELECT *, i::DOUBLE / (20 + len - i) AS v, row_number() OVER (PARTITION BY o_orderkey ORDER BY i::DOUBLE / (20 + len - i) DESC, n, s2, e2, score NULLS FIRST) AS r FROM j),
t AS (SELECT *, CASE WHEN s <= 4 THEN 'no location' WHEN n IS NULL THEN 'no entities' WHEN v < 0.5 THEN 'overlap too small' WHEN score IS NULL THEN 'unscored' WHEN score > 0.85 THEN 'matched' ELSE 'score too low' END AS reason FROM k WHERE r = 1)
SELECT o_orderkey, reason, CASE WHEN reason IN ('unscored', 'matched') THEN n END AS n FROM t""",
    "title_case": f"SELECT p_partkey, array_to_string([{_TITLED} FOR r IN regexp_extract_all(lower(p_name || '-PARTY of o''brien 3rd'), '[a-z]+|[^a-z]+')], '') AS titled FROM part",
    "merge_redirects": f"""WITH l AS (SELECT {_LINKS} FROM orders), d AS (SELECT DISTINCT source, target FROM l),
big AS (SELECT DISTINCT target, lower(target) AS low FROM d WHERE target <> lower(target)),
u AS (SELECT * FROM d WHERE target <> lower(target) OR target NOT IN (SELECT low FROM big) UNION SELECT d.source, big.target FROM d JOIN big ON d.target = big.low)
SELECT target, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY target""",
    "clean_names": """SELECT c_custkey, concat_ws(';', c_name, 'Nandu ' || c_mktsegment, 'Ñandú ' || c_mktsegment) AS names FROM customer""",
}
