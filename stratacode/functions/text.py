"""Text and code expressions, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sector codes by rank, as the coding scheme orders them.
CODE_PRIORITY = {
    "IGO": 200, "ISM": 195, "IMG": 192, "PRE": 190, "REB": 130, "SPY": 110, "JUD": 105, "OPP": 102, "GOV": 100, "LEG": 90,
    "MIL": 80, "COP": 75, "PRM": 72, "ELI": 70, "PTY": 65, "BUS": 60, "NON": 60, "JNK": 51, "UAF": 50, "CRM": 48,
    "LAB": 47, "MED": 45, "NGO": 43, "SOC": 42, "EDU": 41, "JRN": 40, "ENV": 39, "HRI": 38, "UNK": 37, "REF": 35,
    "AGR": 30, "RAD": 20, "CVL": 10, "JEW": 5, "MUS": 5, "BUD": 5, "CHR": 5, "HIN": 5, "REL": 1, "": 0,
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as the one element of an array; used by name it would be copied for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_query(x: Column) -> Column:
    """Normalise an actor text for search; null gives the empty string."""
    x = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    alone = x.isin("The", "the", "a", "an", "")
    y = F.trim(F.regexp_replace(F.regexp_replace(x, " +", " "), "\n+", " "))
    for pattern in ("^the ", "^[Aa]n ", "^[Aa] ", " of$"):
        y = F.trim(F.regexp_replace(y, pattern, ""))
    y = F.regexp_replace(y, r"(\d\d)(st|nd|rd|th)\b", "$1")
    y = F.regexp_replace(y, r"(\d)(st|nd|rd|th)\b", "$1")
    y = F.trim(F.regexp_replace(y, r"^\d+? ", ""))
    y = F.trim(F.regexp_replace(y, "'s$", ""))
    return F.when(alone | (F.length(y) < 2), "").otherwise(y)


def clean_best(country: Column, code_1: Column) -> tuple[Column, Column]:
    """(country, code_1) in their final spelling."""
    moved = code_1.isin("IGO", "MNC", "NGO", "ISM", "EUR", "UNO")
    c = F.when(code_1.isin("JNK", "NON"), F.lit("")).when(moved, code_1).otherwise(F.coalesce(country, F.lit("")))
    k = F.when(moved, F.lit("")).otherwise(code_1)
    six = F.length(c) == 6
    return F.when(six, F.substring(c, 1, 3)).otherwise(c), F.when(six, F.substring(c, 4, 3)).otherwise(k)


def code_priority(code: Column) -> Column:
    """Rank of a sector code; unknown codes: 0."""
    table = F.create_map(*(F.lit(v) for kv in CODE_PRIORITY.items() for v in kv))
    return F.coalesce(F.element_at(table, F.coalesce(code, F.lit(""))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, in doubles, from left to right; a zero vector gives null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def span_jaccard(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared over joint characters of two half-open ranges."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return F.try_divide(inter.cast("double"), (e1 - s1) + (e2 - s2) - inter)


#: English names of months, weekdays and small numbers.
MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t|tember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def _calendar(year: Column, month: Column, day: Column, pub: Column) -> Column:
    """The day of a month, the latest that is not after ``pub`` where no year is given, and of pub's own day where no day is.

    Parts are integers or null. A month shorter than pub's day gives its last one; a day that the month lacks gives null.
    """

    def of(x: Column) -> Column:
        first = F.make_date(F.coalesce(x["y"], F.year(pub)), x["m"], F.lit(1))
        own = F.when(pub.isNotNull(), F.least(F.last_day(first), F.date_add(first, F.dayofmonth(pub) - 1)))
        named = F.when(x["d"].between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, x["d"] - 1))
        at = let(F.when(x["d"].isNull(), own).otherwise(named), lambda d: F.when(x["y"].isNull() & (d > pub), F.add_months(d, -12)).otherwise(d))
        return F.when(x["m"].between(1, 12), at)

    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), of)


def _shifted(pub: Column, n: Column, unit: Column) -> Column:
    """``pub``, taken as midnight, moved by ``n`` units; hours of an earlier day count as that day."""
    days = F.when(unit == "week", n * 7).when(unit == "hour", F.floor(n / 24).cast("int")).otherwise(n)
    months = F.when(unit == "month", n).when(unit == "year", n * 12).when(unit == "decade", n * 120)
    return F.when(months.isNull(), F.date_add(pub, days)).otherwise(F.add_months(pub, months))


def resolve_date(text: Column, pub: Column) -> Column:
    """A date phrase relative to a publication date, past preferred; phrases outside the grammar give null.

    Grammar, in any letter case: ISO dates; ``6/20/2012``; a month with or without day and year, in either order; a
    year alone; today, yesterday, tomorrow, the day before yesterday, the day after tomorrow; ``N hours|days|weeks|months|years|decades
    ago`` and ``in N ...``, N in digits or up to twelve in words; ``last|this|next week|month|year``; and a weekday, alone or
    behind last, on or next. What a phrase leaves open comes from ``pub``: its day for a month, its month and day for a year.
    """
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    units = "(hour|day|week|month|year|decade)s?"
    count = rf"(\d{{1,4}}|{'|'.join(NUMBERS)}) {units}"
    words = F.create_map(*(F.lit(v) for kv in NUMBERS.items() for v in kv))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    whole = lambda x: x.try_cast("int")
    number = lambda x: F.coalesce(whole(x), F.element_at(words, x))
    ago, ahead_by = f"^{count} ago$", f"^in {count}$"
    step = r"^(last|this|next) (week|month|year)$"
    steps = F.when(part(step, 1) == "last", -1).when(part(step, 1) == "next", 1).otherwise(0)
    day = part(r"^(?:last |on |next )?(monday|tuesday|wednesday|thursday|friday|saturday|sunday)$", 1)
    short = F.initcap(F.substring(day, 1, 3))
    ahead = F.coalesce(*[F.when(short == d, F.next_day(pub, d)) for d in WEEKDAYS])
    before = F.when(F.date_sub(ahead, 7) == pub, F.date_sub(ahead, 14)).otherwise(F.date_sub(ahead, 7))
    nth = r"(\d{1,2})(?:st|nd|rd|th)?"
    named = rf"^(?:{nth} (?:of )?)?({'|'.join(MONTHS)})\.?(?: {nth})?,?(?: ([12]\d{{3}}))?$"
    month = F.coalesce(*[F.when(part(named, 2).startswith(m[:3]), k) for k, m in enumerate(MONTHS, 1)])
    one_day = F.when((part(named, 1) != "") & (part(named, 3) != ""), 0).otherwise(F.coalesce(whole(part(named, 1)), whole(part(named, 3))))
    slashes = r"^(\d{1,2})[/-](\d{1,2})[/-]([12]\d{3})$"
    a, b = whole(part(slashes, 1)), whole(part(slashes, 2))
    return (
        F.when(t == "today", pub)
        .when(t == "yesterday", F.date_sub(pub, 1))
        .when(t == "tomorrow", F.date_add(pub, 1))
        .when(t.rlike("^(the )?day before yesterday$"), F.date_sub(pub, 2))
        .when(t.rlike("^(the )?day after tomorrow$"), F.date_add(pub, 2))
        .when(t.rlike(ago), _shifted(pub, -number(part(ago, 1)), part(ago, 2)))
        .when(t.rlike(ahead_by), _shifted(pub, number(part(ahead_by, 1)), part(ahead_by, 2)))
        .when(t.rlike(step), _shifted(pub, steps, part(step, 2)))
        .when(t.startswith("next ") & (day != ""), ahead)
        .when(day != "", before)
        .when(t.rlike(named), _calendar(whole(part(named, 4)), month, one_day, pub))
        .when(t.rlike(slashes), _calendar(whole(part(slashes, 3)), F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b), pub))
        .when(t.rlike(r"^[12]\d{3}$"), _calendar(whole(t), F.month(pub), F.lit(None).cast("int"), pub))
        .otherwise(F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))
    )
