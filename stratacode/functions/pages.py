"""Wiki markup: names, redirects, categories, templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

#: Info box keys that hold other names of the page, and people of an organisation.
NAME_KEYS = ("name", "native_name", "other_name", "alias", "birth_name", "nickname", "other_names")
PEOPLE_KEYS = ("leaders", "founded_by", "founder")
BOX = StructType([StructField("box_type", StringType()), StructField("infobox", MapType(StringType(), StringType()))])


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first letter and the rest small; unlike initcap, any other character ends a run."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def strip_accents(x: Column) -> Column:
    """Latin letters without their marks; inside codegen."""
    return F.translate(x, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿŠšŽžČčĆćŞşĞğİŁł", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyySsZzCcCcSsGgILl")


def redirect_target(text: Column) -> Column:
    """The first link of a page whose text begins with a redirect mark; else null."""
    return F.when(text.rlike("^#?(REDIRECT|redirect|Redirect)"), F.nullif(F.regexp_extract(text, r"\[\[(.+?)\]\]", 1), F.lit("")))


def _whole(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def dump_title(title: Column) -> Column:
    """Not an image, stub, list, portal, disambiguation or project page by its title. A null title passes."""
    anywhere = r"-stub|\([Dd]isambiguation\)|Articles for deletion|Today's featured article|Featured article candidates"
    begins = "^(User|Selected anniversaries|List |Portal |Peer review/|Requests for adminship/|Featured list candidates/|Sockpuppet investigations/|Categories for)"
    return ~_whole(title.rlike(anywhere) | title.rlike(begins) | title.endswith(".jpg") | title.endswith(".png"))


def dump_intro(intro: Column) -> Column:
    """An intro that is not empty and not that of a redirect, category, portal or disambiguation page. A null intro passes."""
    first = F.substring(intro, 1, 100)
    refers = first.rlike("may refer to|most often refers|most commonly refers|[Pp]ortal:")
    return ~_whole((intro == "") | intro.rlike("^#?(REDIRECT|redirect|Redirect)") | intro.contains("Category:") | intro.startswith("<noinclude>") | refers)


def candidate_page(title: Column, intro: Column) -> Column:
    """A page that may answer a search: a usable title and an intro of more than 50 characters that is about one thing."""
    first = F.substring(intro, 1, 50)
    bad = first.rlike("Category:|is the name of|may refer to|can refer to|most commonly refers to|is a surname") | F.substring(intro, 1, 80).contains("usually refers to")
    return _whole(~F.coalesce(title, F.lit("")).rlike("stub|User|Wikipedia:|disambiguation") & ~bad & (F.length(intro) > 50) & intro.rlike(r"\S"))


def clean_names(names: Column) -> Column:
    """Names without link markup, those ending in a colon dropped, accent-free spellings added; sorted, distinct."""
    bare = F.transform(names, lambda n: F.trim(F.regexp_replace(F.trim(F.regexp_replace(n, r"\|.+?\]\]", "")), r"\[|\]", "")))
    kept = F.filter(bare, lambda n: ~n.endswith(":"))
    return F.coalesce(F.array_sort(F.array_union(kept, F.transform(kept, strip_accents))), F.array().cast("array<string>"))


def split_names(cell: Column) -> Column:
    """Names in an info box cell: cut at line ends, then at commas; null gives none."""
    cut = F.transform(F.split(cell, "[\n,]"), lambda n: F.trim(n))
    return F.coalesce(F.filter(cut, lambda n: n != ""), F.array().cast("array<string>"))


def bold_names(intro: Column) -> Column:
    return F.regexp_extract_all(intro, F.lit("'''(.+?)'''"), F.lit(1))


def categories(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"Category:([^\n\]|]+)"), F.lit(1))


def template(text: str | None) -> dict | None:
    """The first info box of a page: its kind and its fields, links reduced to their text. None without one."""
    at = -1 if text is None else min((i for i in (text.find("{{Infobox"), text.find("{{infobox")) if i >= 0), default=-1)
    if at < 0:
        return None
    parts, depth, begun, i = [], 0, at + 2, at
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = depth - 1, i + 2
            if not depth:
                parts.append(text[begun : i - 2])
                break
        else:
            if text[i] == "|" and depth == 1:
                parts.append(text[begun:i])
                begun = i + 1
            i += 1
    else:
        parts.append(text[begun:])  # never closed: up to the end
    fields = {}
    for p in parts[1:]:
        k, eq, v = p.partition("=")
        if eq:
            fields[k.strip()] = _plain(v)
    return {"box_type": parts[0].strip()[len("Infobox") :].strip(), "infobox": fields}


def _plain(v: str) -> str:
    import re

    v = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", re.sub(r"<[^<>]*>", "", v))
    while "{{" in v and (w := re.sub(r"\{\{[^{}]*\}\}", "", v)) != v:
        v = w
    return v.replace("'''", "").replace("''", "").strip()


@F.pandas_udf(BOX)
def _box(texts: pd.Series) -> pd.DataFrame:
    found = [template(t) or {"box_type": None, "infobox": None} for t in texts]
    return pd.DataFrame(found, columns=["box_type", "infobox"])


def parse_articles(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Dump pages (title, text) and merged redirects (target, sources) -> the encyclopedia table.

    Redirect pages and those that :func:`dump_title` or :func:`dump_intro` skip are not articles. One equi-join on the title; brace matching is the only step in Python.
    """
    intro = F.split(F.col("text"), r"\n==[^=]", 2)[0]
    x = pages.where(redirect_target(F.col("text")).isNull() & dump_title(F.col("title"))).select("title", "text", intro.alias("intro"), _box("text").alias("box"))
    x = x.join(redirects.select(F.col("target").alias("title"), "sources"), "title", "left")
    cell = lambda k: split_names(F.element_at("box.infobox", k))
    names = F.concat(bold_names(F.col("intro")), *map(cell, NAME_KEYS))
    bare = F.col("intro")
    for _ in range(4):  # templates within templates
        bare = F.regexp_replace(bare, r"\{\{[^{}]*\}\}", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1")
    out = x.select(
        "title",
        F.nullif(F.regexp_extract("text", r"\{\{[Ss]hort description\|(.+?)\}\}", 1), F.lit("")).alias("short_desc"),
        F.trim(F.regexp_replace(F.regexp_replace(plain, "'{2,3}", ""), r"^(.*?)\(.+?\)", "$1")).alias("intro_para"),
        clean_names(names).alias("alternative_names"),
        clean_names(F.col("sources")).alias("redirects"),
        clean_names(F.concat(*map(cell, PEOPLE_KEYS))).alias("affiliated_people"),
        F.col("box.box_type").alias("box_type"),
        F.map_filter("box.infobox", lambda k, _: k != "map").alias("infobox"),
        categories(F.col("text")).alias("categories"),
    )
    return out.where(dump_intro(F.col("intro_para")))


def merge_redirects(links: DataFrame) -> DataFrame:
    """Links (source, target) -> target, sources. A target spelt all in small letters also joins those that differ from it in case alone.

    Such a small-letter target keeps no row of its own where another spelling takes its sources.
    """
    by = links.where("source is not null and target is not null").groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    small = by.where(F.col("target") == F.lower("target"))
    low = small.select(F.col("target").alias("low"), F.col("sources").alias("more"))
    taken = by.where(F.col("target") != F.lower("target")).select(F.lower("target").alias("target")).distinct()
    kept = small.join(taken, "target", "left_anti")
    grown = by.where(F.col("target") != F.lower("target")).join(low, F.lower("target") == F.col("low"), "left")
    grown = grown.select("target", F.array_sort(F.array_union("sources", F.coalesce("more", F.array().cast("array<string>")))).alias("sources"))
    return kept.unionByName(grown)
