"""Queries over whole texts against brute force."""

from collections import Counter

from pyspark.sql import functions as F

from stratacode.functions import pages as P
from stratacode.plans.queries import QUERIES


def test_search_demands_every_term_and_questions_are_whole(spark, tmp_path):
    items = [(1, "Red blue green a"), (2, "red Red"), (3, "  "), (4, "red absent"), (None, "red")]
    docs = [(1, "red blue"), (2, "green blue red red a"), (3, "RED  red\nred"), (4, None), (5, "a green\tblue red"), (None, "red green blue a")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, text in items:
        terms = set((text or "").lower().split())
        for d, t in docs:
            n = Counter((t or "").lower().split())
            if i and terms and all(n[x] for x in terms):
                want[i, d, sum(n[x] for x in terms)] += 1
    got = QUERIES["fulltext_all_terms"](spark, str(tmp_path)).collect()
    assert Counter((r.query_id, r.doc_id, r.score) for r in got) == want
    turns = [(1, 0, "user", "what is it"), (1, 2, "user", "what was it"), (1, 4, "user", "what is it"), (2, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["keep_last_whole_question"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "what is it", 4), (1, "what was it", 2), (2, None, 0)])


LONG = "Foo is a town in the north of the country, known for its very old harbour."
SKIPPED_TITLES = ["a.jpg", "a.png", "x-stub", "User talk", "Selected anniversaries/May", "Foo (disambiguation)", "Foo (Disambiguation)", "WP Articles for deletion/x", "List of x", "Portal x", "Today's featured article/1", "Featured article candidates/x", "Peer review/x", "Requests for adminship/x", "Featured list candidates/x", "Sockpuppet investigations/x", "Categories for x"]
SKIPPED_INTROS = ["", "#REDIRECT x", "Redirect to x", "see\n*\nCategory:Towns", "Category:Towns", "<noinclude>x", "Foo may refer to:", "Foo most often refers to", "Foo most commonly refers to", "See Portal:x", "See portal:x"]
NOT_CANDIDATES = [("x stub", LONG), ("User", LONG), ("Wikipedia:x", LONG), ("disambiguation", LONG), ("Foo", None), ("Foo", "short"), ("Foo", " " * 60), *[("Foo", f"{x} {LONG}") for x in ("Category:", "is the name of", "may refer to", "can refer to", "most commonly refers to", "is a surname", "Foo, in all of the old books on it, usually refers to")]]


def test_page_predicates(spark):
    t = spark.createDataFrame([(x,) for x in [*SKIPPED_TITLES, "Foo", "A List of x", "Users (town)"[1:], "Lists", None]], "t string")
    assert {r.t for r in t.where(P.dump_title(F.col("t"))).collect()} == {"Foo", "A List of x", "sers (town)", "Lists", None}
    late = "y" * 100 + " may refer to"
    i = spark.createDataFrame([(x,) for x in [*SKIPPED_INTROS, LONG, late, "the redirect"]], "i string")
    assert {r.i for r in i.where(P.dump_intro(F.col("i"))).collect()} == {LONG, late, "the redirect"}
    c = spark.createDataFrame([*NOT_CANDIDATES, ("Foo", LONG), (None, LONG)], "t string, i string")
    assert {r.t for r in c.where(P.candidate_page(F.col("t"), F.col("i"))).collect()} == {"Foo", None}


def test_skipped_pages_are_no_articles(spark):
    rows = [*[(x, LONG) for x in SKIPPED_TITLES], *[(f"intro {k}", x) for k, x in enumerate(SKIPPED_INTROS)], ("Foo", LONG)]
    pages = spark.createDataFrame(rows, "title string, text string")
    links = pages.select(F.col("title").alias("source"), P.redirect_target(F.col("text")).alias("target"))
    assert [r.title for r in P.parse_articles(pages, P.merge_redirects(links)).collect()] == ["Foo"]
