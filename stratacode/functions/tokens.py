"""Actors joined by conjunctions, found in a dependency tree."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPAN = ArrayType(StructType([StructField("text", StringType()), StructField("qa_start_char", IntegerType()), StructField("qa_end_char", IntegerType())]))


def _bounds(toks: list[dict], start: int, end: int) -> tuple[int | None, int | None]:
    """The tokens that a span begins and ends in: exactly, else one character off; the end may be two or three short or one past as a last try."""
    near = lambda offsets, at: next((t["i"] for group in offsets for t in toks if at(t) in group), None)
    first = near([(start,), (start - 1, start + 1)], lambda t: t["idx"])
    return first, near([(end,), (end - 2,), range(end - 3, end + 2)], lambda t: t["idx"] + len(t["text"]))


def expand_tokens(tokens: Iterable[dict], i: int, extra: int | None = None) -> list[dict]:
    """token ``i`` with its compound and adjective children, and theirs, and one token more; in document order."""
    by = {t["i"]: t for t in tokens}
    found, todo = {extra} - {None}, [i]
    seen: set[int] = set()
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += [t["i"] for t in by.values() if t["head"] == x and t["i"] != x and t["dep"] in ("compound", "amod")]
    return [by[k] for k in sorted(found | seen)]


def expand_actor(tokens: Iterable[dict] | None, start: int, end: int) -> str:
    """what stands around an answer's tokens: their compounds, and what they are in apposition to; without punctuation, "" where nothing does."""
    toks = [] if tokens is None else sorted(tokens, key=lambda t: t["i"])
    first, last = _bounds(toks, start, end)
    if first is None or last is None:
        return ""
    own = {t["i"] for t in toks if first <= t["i"] <= last}

    def tree(i: int) -> set[int]:
        found, todo = set(), [i]
        while todo:
            if (x := todo.pop()) not in found:
                found.add(x)
                todo += [t["i"] for t in toks if t["head"] == x and t["i"] != x]
        return found

    roots = {t["i"] for t in toks if t["head"] in own and t["dep"] == "compound"} | {t["head"] for t in toks if t["i"] in own and t["dep"] == "appos"}
    around = set().union(*map(tree, roots)) - own if roots else set()
    return "".join(t["text"] + (t["ws"] or "") for t in toks if t["i"] in around and t.get("pos") != "PUNCT").strip()


def co_actors(tokens: Iterable[dict] | None, text: str | None, start: int, end: int) -> list[dict]:
    """The separate actors in the answer ``start:end``; the answer itself where nothing is joined; [] where no token ends near its end.

    ``tokens`` (i, idx, text, ws, dep, head) in document order; a root's head is itself. An actor is a conjunct,
    or what it is joined to, with its compound and adjective children, and with the answer's first token that
    has an adjective. Actors come in document order, each once.
    """
    toks = [] if tokens is None else sorted(tokens, key=lambda t: t["i"])
    by = {t["i"]: t for t in toks}
    kids: dict[int, list[int]] = {}
    for t in toks:
        if t["head"] != t["i"]:
            kids.setdefault(t["head"], []).append(t["i"])
    first, last = _bounds(toks, start, end)
    if first is None or last is None:
        return []

    def below(i: int, deps: tuple[str, ...] | None = None) -> set[int]:
        found, todo = set(), [i]
        while todo:
            if (x := todo.pop()) not in found:
                found.add(x)
                todo += [k for k in kids.get(x, ()) if deps is None or by[k]["dep"] in deps]
        return found

    heads: set[int] = set()
    for i in (i for i in by if first <= i <= last):
        if by[i]["dep"] == "conj":
            heads.add(i)
        for j in below(i):
            if by[j]["dep"] == "conj":
                heads |= {j, by[j]["head"]}
    described = next((i for i in sorted(by) if first <= i <= last and any(by[k]["dep"] == "amod" for k in kids.get(i, ()))), None)
    if not heads:
        return [{"text": text, "qa_start_char": start, "qa_end_char": end}]
    out = {}
    for h in sorted(heads):
        span = [by[i] for i in sorted(below(h, ("compound", "amod")) | ({described} - {None}))]
        said = "".join(t["text"] + (t["ws"] or "") for t in span).strip()
        out.setdefault((said, span[0]["idx"]), {"text": said, "qa_start_char": span[0]["idx"], "qa_end_char": span[-1]["idx"] + len(span[-1]["text"])})
    return list(out.values())


@F.pandas_udf(SPAN)
def split_actors(tokens: pd.Series, text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """:func:`co_actors` over Arrow batches; a null span gives no actor."""
    return pd.Series([[] if pd.isna(s) or pd.isna(e) else co_actors(t, x, int(s), int(e)) for t, x, s, e in zip(tokens, text, start, end, strict=True)], dtype=object)
