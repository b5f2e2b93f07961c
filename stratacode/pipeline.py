"""From stories to coded events, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.text import let, resolve_date
from .models import classify, embedded, geoparse, load_agents
from .operators import countries as C
from .operators.actors import Lookup, resolve_actors
from .operators.attributes import with_attributes
from .operators.events import stories_to_events
from .operators.resolve import event_location
from .operators.search import postings
from .sources.sinks import cut, write_stage


def code_stories(stories: DataFrame, questions: DataFrame, agents: DataFrame, countries: DataFrame, pages: DataFrame, places: DataFrame, config: EngineConfig | None = None, index: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Stories (id, event_type, event_mode, event_text, pub_date, ...) -> coded events, a row for each type and mode of a story.

    Adds geolocated_ents, attributes, actors (with country_name), event_geolocation, date_resolved and date_raw. The other
    tables are those of :mod:`stratacode.sources.readers`; ``index``: postings of ``pages``, computed where not given. docs
    (orig_id, tokens): parses, for splitting joined actors. With ``config.stages``, each stage is written and read back.
    """
    c = config or EngineConfig()

    def stage(df: DataFrame, name: str) -> DataFrame:
        return cut(df) if c.stages is None else write_stage(df, c.stages, c.run, name)

    located = stage(geoparse(stories, places, entities=c.models.entities), "geolocation")
    events = stories_to_events(located)
    events = stage(with_attributes(events, questions, c.models, docs), "attributes")
    lookup = Lookup(C.load(countries, c.strict_demonyms), load_agents(agents, c.models.embed), c.models)
    events = stage(resolve_actors(events, lookup, pages, postings(pages) if index is None else index), "actors")
    return formatted(events, countries, c)


def formatted(events: DataFrame, countries: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Country names on actors and places, the event's place and its date.

    Names come from a map of the country table, whose size :func:`stratacode.operators.countries.load` bounds.
    """
    c = config or EngineConfig()
    rows = countries.where("CCA3 is not null").groupBy("CCA3").agg(F.min("Name").alias("name")).take(C.MOST_COUNTRIES + 1)
    if len(rows) > C.MOST_COUNTRIES:
        raise ValueError("the table of countries has too many rows to travel with a query")
    names = F.create_map(*(F.lit(v) for kv in ({r[0]: r[1] for r in rows} | C.EXTRA_NAMES).items() for v in kv))
    x = events.withColumn("geolocated_ents", C.name_places(F.col("geolocated_ents"), names))
    named = lambda s: s.withField("country_name", F.coalesce(F.element_at(names, s["country"]), F.lit("")))
    x = x.withColumn("actors", F.transform_values("actors", lambda _, spans: F.transform(spans, named)))
    loc, when = F.get(F.element_at("attributes", "LOC"), F.lit(0)), F.get(F.element_at("attributes", "DATE"), F.lit(0))
    x = x.withColumn("event_geolocation", event_location(loc["qa_start_char"], loc["qa_end_char"], F.col("geolocated_ents"), c.location_overlap, c.location_score))
    pub = F.try_to_timestamp("pub_date").cast("date")
    found = resolve_date(when["text"], pub)
    note = lambda f: F.when(when.isNull(), "no date detected, using publication date").when(f.isNull(), "date not understood, using publication date").otherwise(when["text"])
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    x = x.withColumn("_d", let(found, lambda f: F.struct(iso(F.coalesce(f, pub)).alias("date"), F.when(pub.isNotNull() | f.isNotNull(), note(f)).alias("raw"))))
    return x.withColumns({"date_resolved": F.col("_d.date"), "date_raw": F.col("_d.raw")}).drop("_d")


def classify_stories(stories: DataFrame, weights: dict[str, tuple[list[float], float]], config: EngineConfig | None = None) -> DataFrame:
    """M1: stories whose event_type comes from trained models over their text's vector."""
    c = config or EngineConfig()
    return classify(embedded(stories, "event_text", "_v", c.models.embed), weights, c.class_threshold, "_v").drop("_v")


def code_text(spark: SparkSession, text: str, pub_date: str, event_type: list[str], event_mode: list[str] | None = None, **tables) -> DataFrame:
    """One story from a form -> its coded events; the tables are those of :func:`code_stories`."""
    row = [("form", pub_date, pub_date, text, event_type, event_mode or [])]
    return code_stories(spark.createDataFrame(row, "id string, date string, pub_date string, event_text string, event_type array<string>, event_mode array<string>"), **tables)


def display_table(coded: DataFrame) -> DataFrame:
    """K8: id, attribute, value: twelve rows for each coded event, actors' texts and codes joined by semicolons."""
    spans = lambda k: F.coalesce(F.element_at("actors", k), F.array().cast(coded.schema["actors"].dataType.valueType))
    joined = lambda k, f: F.array_join(F.transform(spans(k), f), "; ")
    code = lambda s: F.concat(s["country"], F.lit(" "), s["code_1"])
    geo = F.col("event_geolocation.geo")
    fields = {f.name for f in coded.schema["event_geolocation"].dataType["geo"].dataType.fields}
    place = lambda n: F.coalesce(geo[n].cast("string"), F.lit("")) if n in fields else F.lit("")
    values = {
        "Raw Actors": joined("ACTOR", lambda s: s["text"]),
        "Actor Codes": joined("ACTOR", code),
        "Actor Wikis": joined("ACTOR", lambda s: s["wiki"]),
        "Event Type": F.col("event_type"),
        "Event Mode": F.col("event_mode"),
        "Raw Recipients": joined("RECIP", lambda s: s["text"]),
        "Recipient Codes": joined("RECIP", code),
        "Recipient Wikis": joined("RECIP", lambda s: s["wiki"]),
        "Resolved Placename": place("resolved_placename"),
        "Admin1": place("admin1_name"),
        "Country": place("country_name"),
        "Date": F.col("date_resolved"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("attribute"), F.coalesce(v, F.lit("")).alias("value")) for k, v in values.items()))
    return coded.select("id", F.posexplode(rows).alias("n", "r")).select("id", "n", "r.attribute", "r.value")
