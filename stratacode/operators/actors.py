"""Actor texts to country and sector codes: by their country words, the nearest agent, and the encyclopedia page they name.

Distinct (text, date, context) are resolved once and joined back. Country words and agents are found in Arrow batches by
``Lookup``, which travels with the query and is bounded by the size of both tables; pages come from an equi-join search;
all candidate codes of an actor then meet in the ladder of :func:`stratacode.operators.resolve.choose_code`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_best
from ..models import Agents, Models
from ..sources.sinks import cut
from .countries import Countries, cleaned
from .resolve import choose_code
from .search import query_pages

CODES = "key string, ord long, source string, query string, code_1 string, code_2 string, country string, conf double, office_num int, wiki string, job string, pattern string"
_CODE_NAMES = [c.split()[0] for c in CODES.split(", ")]
_DATES = ("%Y-%m-%d", "%B %d, %Y", "%d %B %Y", "%b %d, %Y", "%d %b %Y", "%B %Y", "%Y")
_YEAR = re.compile(r"\b(1[5-9]\d\d|20\d\d)\b")


def parsed_date(text: str | None) -> date | None:
    """ISO, ``Month d, yyyy``, ``d Month yyyy``, ``Month yyyy``, a year alone, or the first year in other text; else None.

    Parts that are missing count as the first day or month.
    """
    x = (text or "").strip()
    for form in _DATES:
        try:
            return datetime.strptime(x, form).date()
        except ValueError:
            pass
    m = _YEAR.search(x)
    return date(int(m[1]), 1, 1) if m else None


def parse_offices(infobox: dict[str, str]) -> list[dict]:
    """the offices of an info box, numbered by their keys (office2; the one without a number is 0), with the dates of their terms.

    ``term_start2`` may also be spelt ``termstart2``. An office without a text of its own is none.
    """
    out = []
    for k in (k for k in infobox if "office" in k):
        digits = re.findall(r"\d+", k)
        n = digits[0] if digits else ""
        if f"office{n}" not in infobox:
            continue
        term = {end: parsed_date(infobox.get(f"term_{end}{n}", infobox.get(f"term{end}{n}"))) for end in ("start", "end")}
        one = {"office": infobox[f"office{n}"], "office_num": int(n or 0), **term}
        if one not in out:
            out.append(one)
    return out


def active_offices(offices: list[dict], on: date) -> list[dict]:
    """Those with a start before the date, and an end after it or none."""
    return [o for o in offices if o["start"] and o["start"] < on and (o["end"] is None or o["end"] > on)]


@dataclass
class Lookup:
    """Countries and agents as they travel with a query, with the models that read texts."""

    countries: Countries
    agents: Agents
    models: Models = field(default_factory=Models)

    def agent(self, texts: list[str], least: float = 0.6) -> dict[str, dict]:
        """The nearest agent of each text, cleaned; texts without one are absent."""
        said = {t: cleaned(t) for t in set(texts)}
        asked = sorted({c for c in said.values() if c})
        found = dict(zip(asked, self.agents.match(asked, least, self.models.embed), strict=True))
        out = {}
        for t, c in said.items():
            if c and found[c]:
                k, conf = found[c]
                out[t] = {"pattern": self.agents.patterns[k], "code_1": self.agents.code_1[k], "code_2": self.agents.code_2[k], "conf": round(conf, 6), "query": c}
        return out

    def short_text(self, texts: list[str], least: float = 0.5) -> dict[str, dict]:
        """Country words out of a short text, and the agent that is left; the country of an agent without words is null."""
        split = {t: self.countries.find(t) for t in set(texts)}
        agents = self.agent([rest for _, rest in split.values()], least)
        return {t: agents[rest] | {"country": country} for t, (country, rest) in split.items() if rest in agents}


def short_text_to_agent(rows: DataFrame, lookup: Lookup, column: str = "text", least: float = 0.5) -> DataFrame:
    """Append agent (country, code_1, code_2, conf, pattern) of a short text; null where no agent is near enough or the text is null."""
    held = rows.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("struct<country:string,code_1:string,code_2:string,conf:double,pattern:string>")
    def coded(texts: pd.Series) -> pd.DataFrame:
        found = held.value.short_text([t for t in texts if t is not None], least)
        names = ["country", "code_1", "code_2", "conf", "pattern"]
        return pd.DataFrame([[found[t][n] for n in names] if t in found else [None] * 5 for t in texts], columns=names)

    return rows.withColumn("agent", coded(F.col(column))).withColumn("agent", F.when(F.col("agent.pattern").isNotNull(), F.col("agent")))


def first_pass(actors: DataFrame, lookup: Lookup) -> DataFrame:
    """R6, before any page: (key, text) -> key, country, remainder, names (text of its entities), done, and the agent's code.

    done: a country alone; or an agent near enough in a text without entities, or in small letters and very near. Others are searched for.
    """
    held = actors.sparkSession.sparkContext.broadcast(lookup)
    kind = "key string, text string, country string, remainder string, names string, done boolean, code_1 string, code_2 string, conf double, pattern string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = held.value
        for p in parts:
            split = [look.countries.find(t or "") for t in p["text"]]
            ents = look.models.entities([rest for _, rest in split])
            agents = look.agent([rest for _, rest in split])
            rows = []
            for key, text, (country, rest), own in zip(p["key"], p["text"], split, ents, strict=True):
                a = agents.get(rest)
                alone = bool(country) and not rest
                sure = a is not None and (not own or (a["conf"] > 0.9 and rest == rest.lower()))
                rows.append((key, text, country, rest, " ".join(n for n, _ in own), alone or sure, *((a or {}).get(c) for c in ("code_1", "code_2", "conf", "pattern"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return actors.select("key", "text").mapInPandas(run, kind)


def page_to_codes(pages: DataFrame, lookup: Lookup) -> DataFrame:
    """Pages (key, on date, title, short_desc, intro_para, box_type, infobox, categories) -> candidate codes, a row each as CODES says.

    Sources in order: the first active office of the info box that an agent is near to (or, where all offices are over and
    one was a government's, a former official), the short description, the info box's title and its ``type``. Countries that
    codes, descriptions, offices and categories name are pooled: a single one goes to all codes, of several the most common,
    the first seen of equals, to those that have the empty string. A page without codes but with a country gives a row of that
    country alone. A page of which nothing is found gives no row.
    """
    held = pages.sparkSession.sparkContext.broadcast(lookup)

    def codes(look: Lookup, p: dict, agents: dict, shorts: dict, kinds: dict) -> list[dict]:
        find, box, title = look.countries.find, p["infobox"], p["title"]
        pool: list[str | None] = []
        out: list[dict] = []
        country = first_country = find(first_sentence(p["intro_para"]), "first")[0]
        short = None
        if p["short_desc"] is not None:
            country, rest = find(p["short_desc"])
            pool.append(country)
            if rest in agents:
                short = agents[rest] | {"source": "Wiki short description", "job": p["short_desc"], "country": country}
        tail = [short]
        office_countries: list[str | None] = []
        if box is not None:
            if box.get("country") is not None:
                country = find(box["country"])[0]
                pool.append(country)
            for text, source in ((p["box_type"], "Infobox Title"), (box.get("type"), "Infobox Type")):
                tail.append(kinds[text] | {"source": source, "job": text, "country": country} if text in kinds else None)
            offices = parse_offices(box)
            now = active_offices(offices, p["on"])
            office_countries = [c for o in offices if o["start"] if (c := find(o["office"])[0])]
            if offices and not now:
                if any(agents.get(cleaned(o["office"]), {}).get("code_1") == "GOV" for o in offices):
                    held_in = {c for o in offices if (c := find(o["office"])[0])}
                    only = next(iter(held_in)) if len(held_in) == 1 else None
                    place = only if only is not None and country == "" else country
                    out.append({"source": "Infobox", "query": None, "code_1": "ELI", "code_2": "", "country": place, "conf": None, "pattern": "NA", "job": None})
            for o in now:
                said = cleaned(o["office"])
                if said in shorts:
                    out.append(shorts[said] | {"source": "Infobox", "job": said, "office_num": o["office_num"]})
                    break
        out += [c for c in tail if c]
        named = [c for x in (p["categories"] if p["categories"] is not None else []) if (c := find(x, "longest", True)[0])]
        every = [c["country"] for c in out if c["country"]] + pool + office_countries + named
        every = [c for c in (every or [first_country]) if c]
        top = max(dict.fromkeys(every), key=every.count) if every else None
        single = len(set(every)) == 1
        for c in out:
            if single or (top and c["country"] == ""):
                c["country"] = top
        if not out and top:
            out.append({"source": "Wiki", "query": None, "code_1": "", "code_2": "", "country": top, "conf": None, "pattern": "", "job": None})
        return [c | {"key": p["key"], "ord": k, "wiki": title, "office_num": c.get("office_num")} for k, c in enumerate(out)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = held.value
        for part in parts:
            rows = [{k: None if v is None or v is pd.NaT or isinstance(v, float) else v for k, v in r.items()} for r in part.to_dict("records")]
            for r in rows:
                r["infobox"] = None if r["infobox"] is None else dict(r["infobox"])
            boxes = [r["infobox"] for r in rows if r["infobox"] is not None]
            offices = [cleaned(v) for b in boxes for k, v in b.items() if "office" in k and v]
            descriptions = [look.countries.find(r["short_desc"])[1] for r in rows if r["short_desc"] is not None]
            agents = look.agent([*descriptions, *offices])
            kinds = look.agent([t for r in rows if r["infobox"] is not None for t in (r["box_type"], r["infobox"].get("type")) if t])
            shorts = look.short_text(offices)
            yield pd.DataFrame([c for r in rows for c in codes(look, r, agents, shorts, kinds)], columns=_CODE_NAMES).astype({"office_num": "Int32"})

    wanted = ("key", "title", "short_desc", "intro_para", "box_type", "infobox", "categories")
    return pages.select(*wanted, F.coalesce(F.col("on").cast("date"), F.current_date()).alias("on")).mapInPandas(run, CODES)


def first_sentence(intro: str | None) -> str:
    """F8: an introduction without its parentheses, up to its first line end."""
    return re.sub(r"\(.*?\)", "", intro or "").strip().split("\n")[0]


def agent_to_code(actors: DataFrame, lookup: Lookup, pages: DataFrame, index: DataFrame) -> DataFrame:
    """Actors (key, text, on) -> key, country, code_1, code_2, source, reason, wiki, job, conf, query, pattern, all_code1s, all_code2s.

    Keys are distinct. An actor that nothing is found for has no row. Texts that the first pass leaves open are searched
    for by what remains without their country, else by their entities alone (two queries of one plan). ``index``: the
    postings of ``pages`` (page_id, title, redirects, alternative_names, short_desc, intro_para, box_type, infobox, categories).
    """
    first = cut(first_pass(actors, lookup))  # five uses below
    kept = ("key", "text", "country", "code_1", "code_2", "conf", "pattern")
    done = first.where("done").select(*kept, F.lit("").alias("wiki"))
    country, code_1 = clean_best(F.col("country"), F.coalesce("code_1", F.lit("")))
    alone = F.col("pattern").isNull()
    none = F.array().cast("array<string>")
    early = done.select("key", country.alias("country"), code_1.alias("code_1"), F.coalesce("code_2", F.lit("")).alias("code_2"), F.when(alone, "country only").otherwise("full text").alias("source"), F.when(alone, "country only").otherwise("sure agent").alias("reason"), "wiki", F.lit("").alias("job"), "conf", F.col("text").alias("query"), "pattern", none.alias("all_code1s"), none.alias("all_code2s"))

    open_ = first.where("not done")
    tries = F.explode(F.filter(F.array(F.struct(F.lit(1).alias("n"), F.col("remainder").alias("query")), F.struct(F.lit(2).alias("n"), F.col("names").alias("query"))), lambda t: (t["query"] != "") & ((t["n"] == 1) | (t["query"] != F.col("remainder")))))
    asked = open_.select(F.col("key").alias("actor"), tries.alias("t")).select(F.struct("actor", "t.n").alias("key"), "t.query")
    hit = query_pages(asked, pages, index).groupBy(F.col("key.actor").alias("key")).agg(F.min_by("page_id", "key.n").alias("page_id"))
    own = hit.join(pages, "page_id").join(actors.select("key", "on"), "key")
    wiki = page_to_codes(own, lookup)
    full = open_.where("pattern is not null").select("key", F.lit(1 << 20).cast("long").alias("ord"), F.lit("full text").alias("source"), F.col("remainder").alias("query"), "code_1", "code_2", "country", "conf", F.lit(None).cast("int").alias("office_num"), F.lit("").alias("wiki"), F.lit("").alias("job"), "pattern")
    every = cut(wiki.unionByName(full))
    given = open_.select("key", F.col("country").alias("given"))
    codes = every.join(given, "key")
    best = choose_code(codes.select("key", "ord", "source", "query", "code_1", "country", "conf", "office_num", "wiki", "given"))
    best = best.select("key", "ord", F.col("code_1").alias("k"), F.col("country").alias("c"), F.col("tier").alias("reason"))
    sets = every.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("code_1") != "IGO", F.col("code_1")))).alias("all_code1s"), F.array_sort(F.collect_set("code_2")).alias("all_code2s"))  # A7
    country, code_1 = clean_best(F.col("c"), F.col("k"))
    late = best.join(every, ["key", "ord"]).join(sets, "key").select("key", country.alias("country"), code_1.alias("code_1"), F.coalesce("code_2", F.lit("")).alias("code_2"), "source", "reason", F.coalesce("wiki", F.lit("")).alias("wiki"), F.coalesce("job", F.lit("")).alias("job"), "conf", F.coalesce("query", F.lit("")).alias("query"), "pattern", "all_code1s", "all_code2s")
    return early.unionByName(late)


def resolved_span(span: Column, code: Column) -> Column:
    """An actor's span with the fields of its code; empty strings, and a null confidence, where it has none."""
    text = lambda n: F.coalesce(code[n], F.lit(""))
    sets = lambda n: F.coalesce(code[n], F.array().cast("array<string>")).alias(n)
    return F.struct(
        span["text"].alias("text"),
        span["qa_start_char"].alias("qa_start_char"),
        span["qa_end_char"].alias("qa_end_char"),
        text("wiki").alias("wiki"),
        text("job").alias("actor_wiki_job"),
        sets("all_code1s"),
        sets("all_code2s"),
        text("country").alias("country"),
        text("code_1").alias("code_1"),
        text("code_2").alias("code_2"),
        text("query").alias("actor_role_query"),
        text("pattern").alias("actor_resolved_pattern"),
        code["conf"].alias("actor_pattern_conf"),
        text("reason").alias("actor_resolution_reason"),
    )


def resolve_actors(events: DataFrame, lookup: Lookup, pages: DataFrame, index: DataFrame) -> DataFrame:
    """Events with attributes (map attr -> spans) and pub_date -> the same with actors, map ACTOR, RECIP -> spans with their codes.

    Each distinct (text, date) is resolved once. Places and dates stay in attributes alone; events without actors get an empty map.
    """
    spans = events.select("id", F.col("pub_date").alias("on"), F.explode(F.map_filter("attributes", lambda k, _: k.isin("ACTOR", "RECIP"))).alias("attr", "spans"))
    spans = spans.select("id", "attr", "on", F.posexplode("spans").alias("n", "span"))
    key = F.sha2(F.concat(F.col("span.text"), F.lit("_"), F.coalesce("on", F.lit(""))), 256)
    spans = spans.withColumn("key", key)
    distinct = spans.groupBy("key").agg(F.first("span.text").alias("text"), F.first("on").alias("on"))
    codes = agent_to_code(distinct.withColumn("on", F.try_to_timestamp("on").cast("date")), lookup, pages, index)
    code = F.struct(*(c for c in codes.columns if c != "key"))
    coded = spans.join(codes.select("key", code.alias("code")), "key", "left").select("id", "attr", "n", resolved_span(F.col("span"), F.col("code")).alias("span"))
    lists = coded.groupBy("id", "attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "span"))), lambda x: x["span"]).alias("spans"))
    held = lists.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "spans")))).alias("actors"))
    empty = F.expr(f"cast(map() as {held.schema['actors'].dataType.simpleString()})")
    return events.join(held, "id", "left").withColumn("actors", F.coalesce("actors", empty))
