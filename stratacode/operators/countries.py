"""Country names and demonyms in texts, and names of country codes.

The table of countries has hundreds of patterns: an Arrow batch is searched in one pass, in which
only patterns that can begin at a character of the text are tried, so planning takes no longer
for 800 patterns than for four.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import plain

#: Rows of a country table that may travel with a query; a table beyond it is refused.
MOST_COUNTRIES = 5_000
#: Names of codes that no country has.
EXTRA_NAMES = {"": "", "IGO": "Intergovernmental Organization"}
_ORDINAL = (re.compile(r"(\d\d)(st|nd|rd|th)\b"), re.compile(r"(\d)(st|nd|rd|th)\b"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """CSV with CCA2, Name, CCA3, Nationality (demonyms between commas). A code ``NA`` stays text."""
    s = "CCA2 string, Name string, CCA3 string, Nationality string"
    return spark.read.schema(s).csv(path, header=True, escape='"', nullValue="")


def cleaned(text: str) -> str:
    """The normaliser of :func:`stratacode.functions.text.clean_query` for one text."""
    x = text.strip(" ")
    if x in ("The", "the", "a", "an", ""):
        return ""
    y = re.sub(" +", " ", x)
    y = re.sub("\n+", " ", y).strip(" ")
    for pattern in ("^the ", "^[Aa]n ", "^[Aa] ", " of$"):
        y = re.sub(pattern, "", y).strip(" ")
    for pattern in _ORDINAL:
        y = pattern.sub(r"\1", y)
    y = re.sub(r"^\d+? ", "", y).strip(" ")
    y = re.sub("'s$", "", y).strip(" ")
    return "" if len(y) < 2 else y


class Countries:
    """Patterns of a table of (name, code, demonyms), in its order: each demonym, then the name.

    A demonym is not followed by a small letter; a name may be; neither needs a boundary before it. The
    patterns for category names are demonyms behind ``of`` or ``in``, and names.
    """

    def __init__(self, rows: list[tuple[str | None, str | None, str | None]], strict: bool = False):
        bound = r"\b" if strict else ""
        plain_, within = [], []
        for name, code, demonyms in rows:
            own = [d.strip() for d in (demonyms or "").split(",") if d.strip()]
            plain_ += [(f"{bound}{d}(?![a-z])", code) for d in own] + ([(bound + name, code)] if name else [])
        for word in ("of ", "in "):
            for name, code, demonyms in rows:
                own = [d.strip() for d in (demonyms or "").split(",") if d.strip()]
                within += [(word + d, code) for d in own] + ([(name, code)] if name else [])
        self.lists = [[(re.compile(p), c) for p, c in group] for group in (plain_, within)]
        self.begins: list[dict[str, list[int]]] = []
        for group in (plain_, within):
            index: dict[str, list[int]] = defaultdict(list)
            for k, (p, _) in enumerate(group):
                first = p.removeprefix(r"\b")[0]
                index[first if first.isalnum() else ""].append(k)
            self.begins.append(dict(index))
        self.find = lru_cache(200_000)(self._find)

    def __reduce__(self):
        return _rebuilt, ([[(p.pattern, c) for p, c in group] for group in self.lists], self.begins)

    def _find(self, text: str, method: str = "longest", categories: bool = False) -> tuple[str | None, str]:
        """(code, remainder) of the match that leaves the shortest remainder, or with ``first`` the earliest; ties by order. None: (None, text)."""
        text = plain(text)
        group, index = self.lists[categories], self.begins[categories]
        tried = {k: None for c in {*text, ""} for k in index.get(c, ())}
        found = []
        for k in tried:
            m = group[k][0].search(text)
            if m:
                found.append((k, m.start(), cleaned(group[k][0].sub("", text).strip())))
        if not found:
            return None, text
        k, _, rest = min(found, key=(lambda f: (len(f[2]), f[0])) if method == "longest" else (lambda f: (f[1], f[0])))
        return group[k][1], rest


def _rebuilt(lists, begins) -> Countries:
    c = Countries([])
    c.lists, c.begins = [[(re.compile(p), code) for p, code in group] for group in lists], begins
    return c


def load(countries: DataFrame, strict: bool = False) -> Countries:
    """The table as patterns. It is a dimension: more than MOST_COUNTRIES rows are an error, not a broadcast."""
    rows = countries.select("Name", "CCA3", "Nationality").take(MOST_COUNTRIES + 1)
    if len(rows) > MOST_COUNTRIES:
        raise ValueError("the table of countries has too many rows to travel with a query")
    return Countries([tuple(r) for r in rows], strict)


def find_country(texts: DataFrame, countries: Countries, column: str = "text", method: str = "longest", categories: bool = False) -> DataFrame:
    """Append country and remainder to each row; null text or no match: null country and the plain text."""
    held = texts.sparkSession.sparkContext.broadcast(countries)

    @F.pandas_udf("struct<country:string,remainder:string>")
    def search(values: pd.Series) -> pd.DataFrame:
        find = held.value.find
        return pd.DataFrame([(None, None) if v is None else find(v, method, categories) for v in values], columns=["country", "remainder"])

    names = [c for c in texts.columns if c not in ("country", "remainder")]
    return texts.withColumn("_c", search(F.col(column))).select(*names, "_c.country", "_c.remainder")


def country_names(rows: DataFrame, countries: DataFrame, code: str = "country", to: str = "country_name", missing: str | None = "") -> DataFrame:
    """Append the name of a code, ``missing`` without one. A left join on the code; of a code's several names the first in order of name."""
    extra = rows.sparkSession.createDataFrame(list(EXTRA_NAMES.items()), "_code string, _name string")
    by = countries.select(F.col("CCA3").alias("_code"), F.col("Name").alias("_name")).unionByName(extra).where("_code is not null").groupBy("_code").agg(F.min("_name").alias("_name"))
    return rows.join(by, F.col(code) == F.col("_code"), "left").withColumn(to, F.coalesce("_name", F.lit(missing))).drop("_code", "_name")


def name_places(ents, names):
    """Geolocated entities (array of structs) with ``name`` renamed to resolved_placename and their country's name from a map, null if unknown."""
    with_name = lambda e: e.withField("resolved_placename", e["name"]).dropFields("name").withField("country_name", F.element_at(names, e["country_code3"]))
    return F.transform(ents, with_name)
