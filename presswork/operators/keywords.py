"""Weighted keyword matching over cleaned article text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.text import clean_html, occurrences
from presswork.operators.binding import bind

# What the list page's keyword form allows.
MAX_PAIRS = 10
MIN_WEIGHT, MAX_WEIGHT = 1, 10
DEFAULT_PAIRS = (("", 1),)

def keyword_pairs(pairs: Sequence[tuple[str, int]] = DEFAULT_PAIRS) -> list[tuple[str, int]]:
    """Pairs checked against the limits of the keyword form."""
    if not 1 <= len(pairs) <= MAX_PAIRS:
        raise ValueError(f"give 1 to {MAX_PAIRS} keywords")
    for _, weight in pairs:
        if not MIN_WEIGHT <= weight <= MAX_WEIGHT:
            raise ValueError(f"weights go from {MIN_WEIGHT} to {MAX_WEIGHT}")
    return [(keyword, int(weight)) for keyword, weight in pairs]


def _overlaps_itself(needle: str) -> bool:
    return any(needle.startswith(needle[i:]) for i in range(1, len(needle)))


def _longest(needles: Sequence[str]) -> str:
    """A pattern for the longest of the needles at a place, which tries no letter twice."""
    tree: dict = {}
    for needle in needles:
        at = tree
        for letter in needle:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(letter) + pattern(below) for letter, below in sorted(at.items()) if letter]
        if not ways:
            return ""
        several = f"(?:{'|'.join(ways)})"
        return several + "?+" if "" in at else ways[0] if len(ways) == 1 else several
    first = "".join(re.escape(letter) for letter in sorted(tree))
    return f"(?=[{first}])(?=({pattern(tree)}))"


def _candidates(text: Column, needles: Sequence[str]) -> Column:
    """Every place at which a needle begins, as the longest one there, each between line breaks.

    One scan for all needles. The others that begin at a place are beginnings of the
    longest, so a needle begins as often as a line begins with it. A cleaned text, and so
    what is found in it, has no line breaks.
    """
    found = F.regexp_extract_all(text, F.lit(_longest(needles)), F.lit(1))
    return F.concat(F.lit("\n"), F.array_join(found, "\n"))


def _often_enough(text: Column, candidates: Column, needle: str, weight: int) -> Column:
    """Whether ``needle`` occurs at least ``weight`` times, without overlap.

    Places of a needle that can overlap itself are counted in the text once there are enough.
    """
    if weight <= 0:
        return text.isNotNull()
    if needle == "":
        return occurrences(text, needle) >= weight
    line = "\n" + needle
    once = F.contains(candidates, F.lit(line))
    if weight == 1:
        return once
    enough = once & (occurrences(candidates, line) >= weight)
    return enough & (occurrences(text, needle) >= weight) if _overlaps_itself(needle) else enough


def match_keywords(df: DataFrame, pairs: Sequence[tuple[str, int]],
                   html_column: str = "content") -> DataFrame:
    """Rows whose cleaned text holds a keyword at least as often as its weight.

    Adds ``matched_keywords``; rows that match nothing, or have no content, go.
    Keywords stand in pair order, repeated pairs repeated. No shuffle. The text is cleaned
    once per row and searched once for all keywords, and a generator over the match drops
    the other rows, where a filter would be pushed down and match twice.
    """
    if not pairs:
        return df.withColumn("matched_keywords", F.array().cast("array<string>")).limit(0)
    rows = bind(df, "_text", F.lower(clean_html(F.col(html_column))))
    needles = sorted({keyword.lower() for keyword, weight in pairs if weight > 0} - {""})
    if needles:
        rows = bind(rows, "_candidates", _candidates(F.col("_text"), needles))
    met = F.array_compact(F.array(*[
        F.when(_often_enough(F.col("_text"), F.col("_candidates"), keyword.lower(), weight), F.lit(keyword))
        for keyword, weight in pairs]))
    found = F.filter(F.array(met), lambda m: F.size(m) > 0)
    return rows.withColumn("matched_keywords", F.explode(found)).drop("_text", "_candidates")
