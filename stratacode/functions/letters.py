"""Letters, names and small text features; array work stays in Catalyst, Unicode tables and sequences in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Letters that Unicode does not decompose, in plain Latin.
WHOLE_LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
_WHOLE = str.maketrans(WHOLE_LETTERS)


def plain(text: str) -> str:
    """Text without diacritics, in plain Latin letters where a letter has them; other scripts stay."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_WHOLE)) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    """:func:`plain` of each text; null stays null."""
    return texts.map(plain, na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """text without combining marks, each letter else as it is; null stays null."""
    return texts.map(lambda x: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))), na_action="ignore")


def first_line_outside_parentheses(x: Column) -> Column:
    """F8: a text without its parentheses, up to its first line end."""
    return F.split(F.trim(F.regexp_replace(x, r"(?s)\(.*?\)", "")), "\n")[0]


def format_fields(template: Column, **fields: Column) -> Column:
    """``{name}`` in a template replaced by each field; a null field leaves the empty string."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def softmax(scores: Column) -> Column:
    """F16: softmax of an array, shifted by its largest element; null or empty arrays stay so."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda acc, v: acc + v))


def argmax(scores: Column) -> Column:
    """Position (from 0) of the largest element, the first of equals; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def roll_up(ents: Column, *labels: str) -> Column:
    """Distinct texts of the entities (text, label) of some labels, sorted; null entities give none."""
    own = F.filter(ents, lambda e: e["label"].isin(*labels))
    return F.array_sort(F.array_distinct(F.coalesce(F.transform(own, lambda e: e["text"]), F.array().cast("array<string>"))))


def strip_ents(tokens: Column) -> Column:
    """the words of tokens (text, ws, ent_type) outside entities, but for articles and possessive marks."""
    own = F.filter(tokens, lambda t: (F.coalesce(t["ent_type"], F.lit("")) == "") & ~t["text"].isin("a", "and", "the", "'s", "'", "s"))
    return F.trim(F.array_join(F.transform(own, lambda t: F.concat(t["text"], F.coalesce(t["ws"], F.lit("")))), ""))


def noun_phrases(tokens: Column) -> Column:
    """runs of adjectives and nouns that end in a noun, as texts."""
    tags = F.array_join(F.transform(tokens, lambda t: F.when(t["pos"].isin("NOUN", "PROPN"), "n").when(t["pos"] == "ADJ", "a").otherwise("-")), "")
    runs = F.regexp_extract_all(tags, F.lit("(-|[an]*n|a+)"), F.lit(1))
    ends = F.aggregate(runs, F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(r))))
    spans = F.filter(F.zip_with(runs, ends, lambda r, e: F.struct(r.alias("r"), e.alias("e"))), lambda s: s["r"].endswith("n"))
    return F.transform(spans, lambda s: F.trim(F.array_join(F.transform(F.slice(tokens, s["e"] - F.length(s["r"]) + 1, F.length(s["r"])), lambda t: F.concat(t["text"], F.coalesce(t["ws"], F.lit("")))), "")))


def ranker_text(*fields: Column | tuple[Column]) -> Column:
    """first lines of text fields, each behind a space, and list fields (given as one-tuples) joined by commas; nulls give nothing."""
    parts = [F.coalesce(F.array_join(f[0], ", "), F.lit("")) if isinstance(f, tuple) else F.coalesce(F.concat(F.lit(" "), F.split(f, "\n")[0]), F.lit("")) for f in fields]
    return F.trim(F.concat(*parts))


def clean_entries(names: Column) -> Column:
    """distinct names without ``(disambiguation)``; names with ``#`` or ``/`` are dropped. Sorted."""
    kept = F.filter(names, lambda n: ~n.rlike("[#/]"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda n: F.trim(F.replace(n, F.lit("(disambiguation)"), F.lit(""))))))


def page_entries(title: Column, redirects: Column, alternative_names: Column, infobox: Column) -> Column:
    """F32: a page's names, and its info box's name alone, with its suffix behind it, and behind its prefix, offices and rank; cleaned."""
    name = F.element_at(infobox, "name")
    forms = [name, F.concat(name, F.lit(" "), F.element_at(infobox, "honorific-suffix"))]
    forms += [F.concat(F.element_at(infobox, k), F.lit(" "), name) for k in ("honorific-prefix", "office", "office1", "rank")]
    none = F.array().cast("array<string>")
    return clean_entries(F.concat(F.array_compact(F.array(title)), F.coalesce(redirects, none), F.coalesce(alternative_names, none), F.array_compact(F.array(*forms))))


def option_features(intro: Column, short_desc: Column, categories: Column, intro_sim: Column, desc_sim: Column, reason: Column) -> Column:
    """struct of seven features of a candidate page; a similarity to an empty text counts -0.5."""
    empty = lambda t: F.coalesce(t, F.lit("")) == ""
    return F.struct(
        F.when(empty(intro), F.lit(-0.5)).otherwise(intro_sim.cast("double")).alias("intro_sim"),
        F.when(empty(short_desc), F.lit(-0.5)).otherwise(desc_sim.cast("double")).alias("desc_sim"),
        *(F.coalesce((reason == r).cast("int"), F.lit(0)).alias(f"{r}_match") for r in ("title", "redirect", "alt")),
        F.sqrt(F.length(F.coalesce(intro, F.lit("")))).alias("intro_len"),
        F.coalesce(F.nullif(F.size(categories), F.lit(-1)), F.lit(0)).alias("cat_len"),
    )


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of bits for each character of ``a`` (one machine operation for many cells)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        held = row & at.get(c, 0)
        row = ((row + held) | (row - held)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """null where either text is null."""
    return pd.Series([None if x is None or y is None else common_subsequence(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def lcs_shares(lengths: Column, query: Column) -> Column:
    """A10: struct<best, mean> of the subsequence lengths over the query's length; no candidates: 0."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0.0), lambda acc, v: acc + v)
    return F.struct(F.when(n > 0, F.array_max(lengths) / F.length(query)).otherwise(0.0).alias("best"), F.when(n > 0, total / n / F.length(query)).otherwise(0.0).alias("mean"))


def entity_sentences(doc_id: Column, sents: Column, ents: Column) -> Column:
    """An array to explode: PERSON and ORG entities (text, label, start) with the sentence (start, end, text) that they begin in."""
    own = F.filter(ents, lambda e: e["label"].isin("PERSON", "ORG"))
    return F.transform(own, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), F.get(F.transform(F.filter(sents, lambda s: (s["start"] <= e["start"]) & (e["start"] < s["end"])), lambda s: s["text"]), F.lit(0)).alias("sentence")))
