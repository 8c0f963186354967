"""Folding, tokens, query terms and excerpts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query words without meaning of their own, taken out before tokens are formed (in this order), and after.
FILLERS = ["有没有", "怎么", "怎样", "如何", "什么", "为何", "是否", "可以", "这个", "那个", "一个", "一下", "哪些", "别的", "吗", "呢", "吧"]
STOP_WORDS = ["and", "or", "the", "a", "an", "to", "of", "in", "is", "are", "what", "how", "why"]
OPERATORS = ["and", "not", "near"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HAN = r"\p{IsHan}+"
_WORD = r"[\p{L}\p{N}]+"


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; pure ASCII, where it changes nothing, stays in the JVM."""
    return F.coalesce(_compatible(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only, as substring search folds."""
    return F.translate(text, _UPPER, _UPPER.lower())


def folded(text: Column, compatible: bool = True) -> Column:
    """NFKC, lower case, single spaces, no space at the ends."""
    base = nfkc(text) if compatible else text
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"[\s\p{Z}\x{FEFF}]+", " "), r"^ | $", "")


def index_tokens(text: Column, compatible: bool = True) -> Column:
    """Distinct tokens: two-character pieces of Han runs (a lone character as it is), then other words."""
    base = F.lower(nfkc(text) if compatible else text)
    runs = F.regexp_extract_all(base, F.lit(f"({_HAN})"), 1)
    pieces = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
            ),
        )
    )
    words = F.regexp_extract_all(F.regexp_replace(base, _HAN, " "), F.lit(f"({_WORD})"), 1)
    return F.array_distinct(F.concat(pieces, words))


def fold_query(query: str) -> str:
    return re.sub(r"[\s﻿]+", " ", unicodedata.normalize("NFKC", query).lower()).strip()


def tokens_of(text: str) -> list[str]:
    """The tokens of one short text, on the driver; the same as ``index_tokens`` gives."""
    base = unicodedata.normalize("NFKC", text).lower()
    found: dict[str, None] = {}
    for run in regex.findall(r"\p{Han}+", base):
        found.update(dict.fromkeys([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]))
    found.update(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"\p{Han}+", " ", base))))
    return list(found)


def query_tokens(query: str) -> list[str]:
    return [t for t in tokens_of(query) if t not in OPERATORS]


def meaningful_terms(query: str) -> list[str]:
    """What a query asks for, without fillers and stop words."""
    rest = fold_query(query)
    for filler in FILLERS:
        rest = rest.replace(filler, " ")
    return [t for t in query_tokens(rest) if t not in STOP_WORDS]


def excerpt_of(content: Column, content_folded: Column, query: Column, terms: Column, before: int = 90, width: int = 320) -> Column:
    """The stretch of ``content`` around the (folded) query, else around its first term, else from the start."""
    exact = F.instr(content_folded, query)
    places = F.filter(F.transform(terms, lambda t: F.instr(content_folded, t)), lambda p: p > 0)
    anchor = F.when(exact > 0, exact).otherwise(F.coalesce(F.array_min(places), F.lit(1)))
    start = F.greatest(anchor - before, F.lit(1))
    piece = F.regexp_replace(F.substring(content, start, F.lit(width)), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
    tail = F.when(start + width - 1 < F.length(content), "…").otherwise("")
    return F.concat(F.when(start > 1, "…").otherwise(""), piece, tail)


def tidy(text: Column) -> Column:
    """Optional text: NFKC, single spaces, NULL when empty."""
    return F.nullif(F.regexp_replace(F.regexp_replace(nfkc(text), r"[\s\p{Z}\x{FEFF}]+", " "), r"^ | $", ""), F.lit(""))


def body_text(content: Column) -> Column:
    """Line ends as newlines, no space at the ends."""
    return F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
