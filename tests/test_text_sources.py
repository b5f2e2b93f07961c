"""Readers, writers, markup, trees and the streamed explode on small fixtures."""

import json

from pyspark.sql import functions as F

from stratacode.functions import pages as P
from stratacode.functions.tokens import co_actors, split_actors
from stratacode.sources import readers, sinks
from stratacode.streaming.stories import stream_events

STORIES = [
    {"id": "a", "event_type": ["PROTEST", "ASSAULT"], "event_mode": ["PROTEST-riot-big", "SANCTION-x"], "event_text": "One."},
    {"id": "b", "event_type": [], "event_mode": [], "event_text": "Two."},
]


def tree(text, rows):
    """(word, dep, head) -> tokens with offsets."""
    out, at = [], 0
    for i, (w, dep, head) in enumerate(rows):
        at = text.index(w, at)
        ws = " " if text[at + len(w) : at + len(w) + 1] == " " else ""
        out.append({"i": i, "idx": at, "text": w, "ws": ws, "dep": dep, "head": head})
        at += len(w)
    return out


TEXT = "Russian troops and rebel fighters attacked"
TREE = tree(TEXT, [("Russian", "amod", 1), ("troops", "nsubj", 5), ("and", "cc", 1), ("rebel", "compound", 4), ("fighters", "conj", 1), ("attacked", "ROOT", 5)])


def test_co_actors_are_split(spark):
    found = co_actors(TREE, TEXT[:33], 0, 33)
    assert [x["text"] for x in found] == ["Russian troops", "troops rebel fighters"]
    assert [(x["qa_start_char"], x["qa_end_char"]) for x in found] == [(0, 14), (8, 33)]
    assert co_actors(TREE, "attacked", 400, 408) == [] and co_actors(None, "x", 0, 1) == []
    one = co_actors(TREE[3:4], "rebel", 19, 24)
    assert one == [{"text": "rebel", "qa_start_char": 19, "qa_end_char": 24}]
    rows = [(TREE, TEXT[:33], 0, 33), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t array<struct<i int, idx int, text string, ws string, dep string, head int>>, x string, s int, e int")
    assert sorted(len(r.a) for r in df.select(split_actors("t", "x", "s", "e").alias("a")).collect()) == [0, 2]


def test_articles(spark):
    text = "{{Short description|A town}}\n{{Infobox settlement|name=[[Foo|Föö]], Bar|map={{m|x=1}}|leader = {{a|b}}Ann\n|founder=Bob}}\n'''Foo''' (say it) is a [[city|town]].\n== More ==\nx\n[[Category:Towns]]\n"
    pages = spark.createDataFrame([("Foo", text), ("Fu", "#REDIRECT [[Foo]]"), ("Open", "{{Infobox person|name=Z"), ("None", None)], "title string, text string")
    links = pages.select(F.col("title").alias("source"), P.redirect_target(F.col("text")).alias("target"))
    got = {r.title: r for r in P.parse_articles(pages, P.merge_redirects(links)).collect()}
    foo = got["Foo"]
    assert set(got) == {"Foo", "Open", "None"}
    assert (foo.short_desc, foo.box_type, foo.redirects, foo.affiliated_people, foo.categories) == ("A town", "settlement", ["Fu"], ["Bob"], ["Towns"])
    assert foo.infobox == {"name": "Föö, Bar", "leader": "Ann", "founder": "Bob"}
    assert foo.alternative_names == ["Bar", "Foo", "Föö"] and foo.intro_para == "Foo  is a town."
    assert got["Open"].infobox == {"name": "Z"} and got["None"].alternative_names == []


def test_stories_are_read_streamed_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in STORIES))
    stories = readers.read_stories(spark, str(tmp_path / "in"))
    assert stories.count() == 2 and readers.read_stories(spark, str(tmp_path / "in"), 1).count() == 1
    q = stream_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("streamed").collect()) == ["a_ASSAULT_", "a_PROTEST_riot-big"]
    sinks.write_events(spark.table("streamed"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sinks.write_stage(stories, str(tmp_path), "r1", "read").count() == 2
    sinks.write_pages(spark.createDataFrame([("x", "in"), ("y", None)], "title string, intro_para string"), str(tmp_path / "p"), str(tmp_path / "no"))
    assert (spark.read.parquet(str(tmp_path / "p")).count(), spark.read.parquet(str(tmp_path / "no")).count()) == (1, 1)


def test_dimensions_are_read(spark, tmp_path):
    (tmp_path / "q.csv").write_text('event_type,mode,ACTOR,RECIP,LOCATION,TIME,notes\nPROTEST,riot,"Who?\nWho else?",,Where?,,\n')
    got = sorted(tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.csv")).collect())
    assert got == [("PROTEST_riot", "ACTOR", "Who else?"), ("PROTEST_riot", "ACTOR", "Who?"), ("PROTEST_riot", "LOC", "Where?")]
    (tmp_path / "a.txt").write_text("# note\n!MACRO! = x\n\nRIOT_POLICE [~COPGOV] # seen\nKING {old} [~GOV]\n")
    assert sorted(tuple(r) for r in readers.read_agents(spark, str(tmp_path / "a.txt")).collect()) == [("king", "GOV", ""), ("riot police", "COP", "GOV")]
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>T</title><revision><text bytes='1'>body</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.read_dump(spark, str(tmp_path / "d.xml")).collect()] == [("T", "body")]
