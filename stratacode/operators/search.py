"""Full-text search over an encyclopedia table, from query text to one page.

The table (title, redirects, alternative_names, short_desc, intro_para, categories, box_type, infobox) is turned
into postings once; a query is an equi-join on terms. Scores are those of BM25 in each field, by its boost, the best
field counting; all terms must be in that one field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pages import candidate_page
from ..functions.text import clean_query
from .resolve import choose_page, page_matches

BOOSTS = {"title": 50.0, "redirects": 50.0, "alternative_names": 1.0}
LIMIT_BOOSTS = {"title": 100.0, "redirects": 100.0, "alternative_names": 1.0, "intro_para": 1.0, "categories": 1.0, "infobox": 1.0}
K1, B = 1.2, 0.75


def terms_of(text: Column) -> Column:
    """Words of a text in small letters: letters, marks and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def checked_pages(pages: DataFrame) -> DataFrame:
    """The table with the columns that a search reads; a table without ``redirects`` is no such index."""
    missing = {"title", "redirects", "alternative_names", "intro_para"} - set(pages.columns)
    if missing:
        raise ValueError(f"not an encyclopedia table: no {', '.join(sorted(missing))}")
    return pages


def postings(pages: DataFrame, fields: tuple[str, ...] = tuple(LIMIT_BOOSTS)) -> DataFrame:
    """Pages (page_id, ...) -> term, page_id, field, tf, len: a row for each term of each field. Write it once and search it often."""
    kinds = dict(pages.dtypes)

    def text(f: str) -> Column:
        kind = kinds.get(f, "")
        if kind.startswith("array"):
            return F.array_join(f, " \n ")
        if kind.startswith("map"):
            return F.array_join(F.map_values(f), " \n ")
        return F.coalesce(F.col(f).cast("string"), F.lit("")) if kind else F.lit("")

    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms_of(F.coalesce(text(f), F.lit(""))).alias("terms")) for f in fields)))
    x = checked_pages(pages).select("page_id", rows.alias("r")).select("page_id", "r.field", F.size("r.terms").alias("len"), F.explode("r.terms").alias("term"))
    return x.groupBy("term", "page_id", "field").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def _scored(wanted: DataFrame, index: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """Rows (key, term) joined with postings: key, page_id, field, term, and the boosted BM25 score of the term."""
    own = index.where(F.col("field").isin(*boosts))
    lens = own.select("page_id", "field", "len").distinct().groupBy("field").agg(F.count("*").alias("pages"), F.avg("len").alias("mean"))
    df = own.groupBy("term", "field").agg(F.count("*").alias("df"))
    hit = wanted.join(own, "term").join(df, ["term", "field"]).join(F.broadcast(lens), "field")  # a row for each field
    boost = F.element_at(F.create_map(*(F.lit(v) for kv in boosts.items() for v in kv)), F.col("field"))
    idf = F.log(1 + (F.col("pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hit.select("key", "page_id", "field", "term", (boost * idf * gain).alias("score"))


def search(queries: DataFrame, index: DataFrame, k: int = 200, boosts: dict[str, float] | None = None) -> DataFrame:
    """Queries (key, query[, limit_term]) -> key, page_id, score, ord: the k best pages, ord from 0; ties by page_id.

    A page must have all terms of the cleaned query in one field. Where limit_term isn't blank, it must also have one
    of that text's terms in some of six fields, whose scores add up. A query without terms finds nothing. Candidates are
    the pages with the query's rarest term, so that a common term's postings meet few pages.
    """
    q = queries.select("key", F.array_distinct(terms_of(clean_query(F.col("query")))).alias("terms"), *(["limit_term"] if "limit_term" in queries.columns else []))
    wanted = q.select("key", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    hits = _scored(wanted.select("key", "term"), index, boosts or BOOSTS)
    n = wanted.groupBy("key").agg(F.max("n").alias("n"))
    whole = hits.groupBy("key", "page_id", "field").agg(F.count("*").alias("found"), F.sum("score").alias("score")).join(n, "key").where("found = n")
    best = whole.groupBy("key", "page_id").agg(F.max("score").alias("score"))
    if "limit_term" in queries.columns:
        limit = q.where("trim(coalesce(limit_term, '')) <> ''").select("key", F.explode(F.array_distinct(terms_of(F.col("limit_term")))).alias("term"))
        more = _scored(limit, index, LIMIT_BOOSTS).groupBy("key", "page_id").agg(F.sum("score").alias("more"))
        asked = limit.select("key").distinct().withColumn("asked", F.lit(True))
        best = best.join(more, ["key", "page_id"], "left").join(asked, "key", "left").where("asked is null or more is not null")
        best = best.select("key", "page_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    best = best.withColumn("score", F.round("score", 6))
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.col("score").desc(), "page_id"))
    return best.withColumn("ord", nth - 1).where(F.col("ord") < k)


def candidates(queries: DataFrame, pages: DataFrame, index: DataFrame, k: int = 200) -> DataFrame:
    """Search hits that may answer a query (P11), with their page's columns and how they bear the query's name."""
    hits = search(queries, index, k).join(queries.select("key", "query", *(["country"] if "country" in queries.columns else [])), "key").join(pages, "page_id")
    if "country" not in queries.columns:
        hits = hits.withColumn("country", F.lit(""))
    hits = hits.where(candidate_page(F.col("title"), F.col("intro_para"))).withColumn("infobox_name", F.element_at("infobox", "name"))
    return page_matches(hits.withColumn("query", clean_query(F.col("query"))))


def search_to_options(found: DataFrame, most: int = 50) -> DataFrame:
    """Candidates -> key, page_id, title, reason, nth: title matches, then redirects, then alternative names, then other hits.

    Of pages with one title the first in that order stays; at most ``most`` a key, numbered from 0.
    """
    rank = F.when(F.col("is_title"), 0).when(F.col("is_redirect"), 1).when(F.col("is_alt"), 2).otherwise(3)
    reason = F.element_at(F.array(*map(F.lit, ("title", "redirect", "alt", "search"))), F.col("rank") + 1)
    x = found.withColumn("rank", rank).withColumn("reason", reason)
    first = x.groupBy("key", "title").agg(F.min(F.struct("rank", "ord", "page_id", "reason")).alias("m")).select("key", "title", "m.*")
    nth = F.row_number().over(W.partitionBy("key").orderBy("rank", "ord")) - 1
    return first.withColumn("nth", nth).where(F.col("nth") < most).select("key", "page_id", "title", "reason", "nth")


def padded(lists: Column, length: int = 51) -> Column:
    """An array cut or filled with nulls to a length."""
    return F.concat(F.slice(lists, 1, length), F.array_repeat(F.lit(None), F.greatest(F.lit(0), F.lit(length) - F.size(lists))))


def query_pages(queries: DataFrame, pages: DataFrame, index: DataFrame, similarity: DataFrame | None = None, k: int = 200) -> DataFrame:
    """Queries (key, query[, country, limit_term]) -> key, page_id, title, tier: the page that the ladder of
    :func:`stratacode.operators.resolve.choose_page` picks.

    similarity: (key, page_id, sim, title_sim) of hits to the query's context and of titles to the query; without it the
    search order decides, and no alternative name is sure.
    """
    found = candidates(queries, pages, index, k)
    if similarity is not None:
        found = found.join(similarity, ["key", "page_id"], "left")
    else:
        found = found.withColumns({"sim": F.lit(0.0), "title_sim": F.lit(0.0)})
    found = found.withColumn("intro", F.col("intro_para"))
    page = found.select("page_id", F.col("title").alias("name")).distinct()
    best = choose_page(found.withColumn("title", F.col("page_id").cast("string")).select("key", "title", "ord", "sim", "title_sim", "intro", "is_title", "is_redirect", "is_alt"))
    # the ladder returns what it is given for a title: page numbers, as titles repeat
    return best.select("key", F.col("title").cast(found.schema["page_id"].dataType).alias("page_id"), "tier").join(page, "page_id").select("key", "page_id", F.col("name").alias("title"), "tier")
