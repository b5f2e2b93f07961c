"""Date phrases against the days that a calendar gives."""

from datetime import date

from pyspark.sql import functions as F

from stratacode.functions.text import resolve_date

PUB = date(2015, 3, 31)  # a Tuesday
SAID = {
    "today": PUB, "Yesterday": date(2015, 3, 30), "tomorrow": date(2015, 4, 1),
    "the day before yesterday": date(2015, 3, 29), "day after tomorrow": date(2015, 4, 2),
    "3 days ago": date(2015, 3, 28), "two weeks ago": date(2015, 3, 17), "a month ago": date(2015, 2, 28),
    "1 year ago": date(2014, 3, 31), "one decade ago": date(2005, 3, 31), "5 hours ago": date(2015, 3, 30),
    "in 2 days": date(2015, 4, 2), "in 5 hours": PUB, "last week": date(2015, 3, 24), "this month": PUB,
    "next month": date(2015, 4, 30), "next  year": date(2016, 3, 31), "last month": date(2015, 2, 28),
    "tuesday": date(2015, 3, 24), "last sunday": date(2015, 3, 29), "next friday": date(2015, 4, 3),
    "March 5": date(2015, 3, 5), "5 March": date(2015, 3, 5), "Dec. 25th": date(2014, 12, 25), "the 5th": None,
    "March": PUB, "February": date(2015, 2, 28), "June": date(2014, 6, 30), "March 2012": date(2012, 3, 31),
    "Feb 2012": date(2012, 2, 29), "May 12, 2011": date(2011, 5, 12), "12 May 2011": date(2011, 5, 12),
    "12th of May, 2011": date(2011, 5, 12), "Sept 1 2010": date(2010, 9, 1), "february 30, 2012": None,
    "3 may 4": None, "marching": None, "2012": date(2012, 3, 31), "6/20/2012": date(2012, 6, 20),
    "20/6/2012": date(2012, 6, 20), "13/13/2012": None, "2012-06-20": date(2012, 6, 20), "2012-06-31": None,
    "": None, "soon": None, None: None,
}


def test_phrases_give_their_day(spark):
    df = spark.createDataFrame([(t, PUB) for t in SAID], "t string, pub date")
    got = {r.t: r.d for r in df.select("t", resolve_date(F.col("t"), F.col("pub")).alias("d")).collect()}
    assert got == SAID


def test_no_publication_date_leaves_only_whole_dates(spark):
    df = spark.createDataFrame([(t, None) for t in SAID], "t string, pub date")
    got = {r.t: r.d for r in df.select("t", resolve_date(F.col("t"), F.col("pub")).alias("d")).collect() if r.d is not None}
    assert got == {t: SAID[t] for t in ("May 12, 2011", "12 May 2011", "12th of May, 2011", "Sept 1 2010", "6/20/2012", "20/6/2012", "2012-06-20")}
