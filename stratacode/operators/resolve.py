"""Ladders that choose one page for an actor, one code for a page and one place for an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pages import strip_accents, title_case
from ..functions.text import code_priority, let, span_jaccard

BY_KEY = "key"


def page_matches(hits: DataFrame) -> DataFrame:
    """Append is_title, is_redirect, is_alt: how a page (title, redirects, alternative_names, infobox_name) bears the query's name.

    A title also matches the query with its country behind it in parentheses. Null arrays hold no name.
    """
    q, named = F.col("query"), F.concat(F.col("query"), F.lit(" ("), F.coalesce("country", F.lit("")), F.lit(")"))
    forms = [f for x in (q, named) for f in (x, F.upper(x), title_case(x))]
    is_title = F.col("title").isin(*forms) | strip_accents(F.col("title")).isin(q, named)
    held = lambda names, *fs: F.arrays_overlap(F.coalesce(names, F.array().cast("array<string>")), F.array(*fs))
    return hits.select(
        "*",
        F.coalesce(is_title, F.lit(False)).alias("is_title"),
        F.coalesce(held(F.col("redirects"), q, title_case(q), F.upper(q)), F.lit(False)).alias("is_redirect"),
        F.coalesce(held(F.col("alternative_names"), q, title_case(q)) | F.coalesce(F.col("infobox_name") == q, F.lit(False)), F.lit(False)).alias("is_alt"),
    )


def choose_page(hits: DataFrame, least: float = 0.9, alternatives: int = 10) -> DataFrame:
    """Search hits with :func:`page_matches` flags -> key, title, tier; a row for each key that has a page.

    Tiers: ``title`` (of title matches, the most similar), ``redirect`` (one; of two the first with a long
    introduction; else the most similar), ``alternative`` (one; else the most similar title above ``least``
    among the first ``alternatives``). Equal similarities: the earlier hit. Hits are bounded by the
    search's top k, so one shuffle on the key serves both the rank and the aggregate.
    """
    nth = F.row_number().over(W.partitionBy(BY_KEY, "is_alt").orderBy("ord"))
    x = hits.repartition(BY_KEY).withColumn("nth", nth)
    pick = lambda kind, by: F.expr(f"max_by(title, {by}) FILTER (WHERE {kind})")
    by_sim = "named_struct('s', sim, 'o', -ord)"
    a = x.groupBy(BY_KEY).agg(
        pick("is_title", by_sim).alias("by_title"),
        F.count_if("is_redirect").alias("n_redirect"),
        pick("is_redirect and length(intro) > 40", "-ord").alias("long_redirect"),
        pick("is_redirect", by_sim).alias("by_redirect"),
        F.count_if("is_alt").alias("n_alt"),
        pick("is_alt", "-ord").alias("first_alt"),
        pick(f"is_alt and nth <= {alternatives} and title_sim > {least}", "named_struct('s', title_sim, 'o', -ord)").alias("by_alt"),
    )
    redirect = F.when((F.col("n_redirect") == 2) & F.col("long_redirect").isNotNull(), F.col("long_redirect")).otherwise(F.col("by_redirect"))
    alt = F.when(F.col("n_alt") == 1, F.col("first_alt")).otherwise(F.col("by_alt"))
    tiers = F.coalesce(*(F.when(t.isNotNull(), F.struct(t.alias("title"), F.lit(n).alias("tier"))) for n, t in (("title", F.col("by_title")), ("redirect", redirect), ("alternative", alt))))
    return a.select(BY_KEY, tiers.alias("t")).where("t is not null").select(BY_KEY, "t.title", "t.tier")


def pooled_country(codes: DataFrame) -> DataFrame:
    """(key, ord, country, given) -> key, best_country: the only one, else the given one, else the most common (ties: first seen)."""
    per = codes.groupBy(BY_KEY, F.coalesce("country", F.lit("")).alias("c")).agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"), F.max(F.coalesce("given", F.lit(""))).alias("given"))
    by = per.groupBy(BY_KEY).agg(F.max("given").alias("given"), F.expr("max_by(c, named_struct('n', n, 'f', -first_seen)) FILTER (WHERE c <> '')").alias("common"))
    return by.select(BY_KEY, F.when(F.col("given") != "", F.col("given")).otherwise(F.coalesce("common", F.lit(""))).alias("best_country"))


def choose_code(codes: DataFrame) -> DataFrame:
    """Candidate codes of a key -> key, code_1, country, source, tier, ord (of the candidate taken); exactly one row a key.

    ``codes``: key, ord (no two alike in a key), source, query, code_1, country, conf, office_num, wiki, given (the key's known
    country). Missing texts count as empty. In order: the only code; a settlement has no sector code;
    the info box with the lowest office number; one distinct code without a page, by confidence; the short
    description; agreeing lookups outside entities; the highest sector priority, codes from a page first.
    Only partial aggregates: no key's rows are gathered.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "query", "code_1", "country", "wiki", "given")]
    c = codes.select(BY_KEY, "ord", "conf", "office_num", *text)
    row = "named_struct('code_1', code_1, 'country', country, 'source', source, 'query', query, 'ord', ord)"
    first = lambda where, by="ord": F.expr(f"min_by({row}, {by}) FILTER (WHERE {where})")
    lookup = "source = 'BERT matching on non-entity text' and country <> '' and code_1 <> ''"
    a = c.groupBy(BY_KEY).agg(
        F.count("*").alias("n"),
        F.max("given").alias("given"),
        first("true").alias("only"),
        first("source = 'Infobox Type'").alias("box"),
        first("source = 'Infobox'", "named_struct('n', office_num, 'o', ord)").alias("info"),
        F.expr("min(code_1) FILTER (WHERE code_1 <> '') = max(code_1) FILTER (WHERE code_1 <> '')").alias("one"),
        F.expr("count_if(code_1 <> '' and (wiki <> '' or conf is null)) = 0").alias("sure"),
        first("code_1 <> ''", "named_struct('c', -conf, 'o', ord)").alias("confident"),
        first("source = 'Wiki short description'").alias("short"),
        F.expr(f"min(country || ',' || code_1) FILTER (WHERE {lookup}) = max(country || ',' || code_1) FILTER (WHERE {lookup})").alias("agree"),
        first(lookup).alias("lookup"),
    )
    per = c.groupBy(BY_KEY, "code_1").agg(code_priority(F.col("code_1")).alias("priority"), F.min("ord").alias("first_seen"), F.coalesce(first("wiki <> ''"), first("true")).alias("best"))
    ranked = per.groupBy(BY_KEY).agg(F.expr("max_by(best, named_struct('p', priority, 'o', -first_seen))").alias("ranked"))
    x = a.join(pooled_country(c), BY_KEY).join(ranked, BY_KEY)
    best = F.col("best_country")
    own = lambda r, other: F.when(F.col(f"{r}.country") != "", F.col(f"{r}.country")).otherwise(other)
    world = lambda r: F.when(F.col(f"{r}.code_1") == "IGO", F.lit("IGO")).otherwise(best)
    out = lambda r, country, tier, code=None: F.struct((F.col(f"{r}.code_1") if code is None else code).alias("code_1"), country.alias("country"), F.col(f"{r}.source").alias("source"), F.lit(tier).alias("tier"), F.col(f"{r}.ord").alias("ord"))
    ladder = (
        F.when(F.col("n") == 1, out("only", own("only", F.col("given")), "only code"))
        .when(F.col("box.query") == "settlement", out("box", own("box", best), "settlement", F.lit("")))
        .when(F.col("info").isNotNull(), out("info", world("info"), "info box"))
        .when(F.coalesce("one", F.lit(False)) & F.col("sure"), out("confident", own("confident", best), "one distinct code"))
        .when(F.col("short").isNotNull(), out("short", world("short"), "short description"))
        .when(F.coalesce("agree", F.lit(False)), out("lookup", best, "lookups agree"))
        .otherwise(out("ranked", best, "priority"))
    )
    return x.select(BY_KEY, ladder.alias("l")).select(BY_KEY, "l.*")


def event_location(start: Column, end: Column, entities: Column, overlap: float = 0.5, score: float = 0.85) -> Column:
    """struct<reason, geo>: of the geolocated entities (start_char, end_char, score, ...) the one that overlaps the span most.

    Reasons: ``no location``, ``no entities``, ``overlap too small``, ``unscored`` (returned all the same), ``matched``,
    ``score too low``; geo is null where nothing is returned. Equal overlaps: the first entity.
    """
    with_overlap = F.transform(entities, lambda e, i: F.struct(F.coalesce(span_jaccard(start, end, e["start_char"], e["end_char"]), F.lit(0.0)).alias("overlap"), (-i).alias("neg"), e.alias("geo")))
    best = F.aggregate(with_overlap, F.get(with_overlap, F.lit(0)), lambda a, e: F.when(e["overlap"] > a["overlap"], e).otherwise(a))

    def judged(b: Column) -> Column:
        geo = b["geo"]
        reason = (
            F.when(start.isNull() | end.isNull(), "no location")
            .when(entities.isNull() | (F.size(entities) == 0), "no entities")
            .when(b["overlap"] < overlap, "overlap too small")
            .when(geo["score"].isNull(), "unscored")
            .when(geo["score"] > score, "matched")
            .otherwise("score too low")
        )
        return let(reason, lambda r: F.struct(r.alias("reason"), F.when(r.isin("unscored", "matched"), geo).alias("geo")))

    return let(best, judged)
