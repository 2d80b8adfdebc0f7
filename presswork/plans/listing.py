"""The list page and the detail page as whole plans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.text import first_filled, join_list, preview
from presswork.functions.suffixes import SuffixRules
from presswork.operators import filters
from presswork.operators.domains import with_domain
from presswork.operators.enrich import main_content, main_summary
from presswork.operators.keywords import DEFAULT_PAIRS, keyword_pairs, match_keywords
from presswork.operators.ordering import SORT_COLUMNS, sort_articles


@dataclass(frozen=True)
class ListRequest:
    """What a visitor of the list page can ask for."""

    pairs: Sequence[tuple[str, int]] = DEFAULT_PAIRS
    title: str | None = None
    sources: list[str] | None = None
    start: dt.date | str | None = None
    end: dt.date | str | None = None
    domain: str | None = None
    kind: str | None = None
    sort_by: str = "date"
    ascending: bool = False
    title_mode: str = "bag"
    end_inclusive_day: bool = False
    #: Public-suffix rules for the domain; those of the public list if not given.
    rules: SuffixRules | None = None


def _by_language(second: str, first: str, second_language: bool) -> Column:
    """The second-language column where filled, else the first-language one."""
    return first_filled(F.col(second), F.col(first)) if second_language else F.col(first)


def article_cards(df: DataFrame, second_language: bool = True) -> DataFrame:
    """What the list shows of each row, and the columns it can be sorted by."""
    keywords = (join_list(F.col("matched_keywords"))
                if "matched_keywords" in df.columns else F.lit(""))
    return df.select(
        "id", *SORT_COLUMNS, "domain", "views",
        _by_language("title_persian", "title", second_language).alias("title"),
        preview(_by_language("summary_persian", "summary", second_language)).alias("summary"),
        keywords.alias("keywords"))


CARD_COLUMNS = ("id", "title", "date", "source", "domain", "views", "summary", "keywords")


def article_list(content: DataFrame, request: ListRequest) -> DataFrame:
    """Cards of the rows a request selects, in its order.

    Filters on short columns run before any text is cleaned, copies of a row
    that the title search finds twice are made after it, and only card columns
    enter the sort. A sort reads its input twice, first for a sample of the keys,
    so the small cards are shuffled before it: both readings then start from
    them and no text is cleaned a second time.
    """
    df = filters.by_sources(content, request.sources)
    df = filters.by_type(df, request.kind)
    df = filters.by_date_range(df, request.start, request.end, request.end_inclusive_day)
    df = filters.title_search(df, request.title, mode="any")
    df = filters.by_domain(with_domain(df, request.rules), request.domain)
    df = match_keywords(df, keyword_pairs(request.pairs))
    if request.title_mode == "bag":
        df = filters.title_search(df, request.title, mode="bag")
    cards = article_cards(df).repartition("id")
    cards = sort_articles(cards, request.sort_by, request.ascending)
    return cards.select(*CARD_COLUMNS)


def article_details(content: DataFrame, content_id: int | None = None,
                    second_language: bool = True,
                    rules: SuffixRules | None = None) -> DataFrame:
    """The detail page's fields for one item, or for all of them.

    ``title_api`` is the second-language title whether or not there is another.
    """
    df = content if content_id is None else filters.by_id(content, content_id)
    body = main_content() if second_language else F.col("content")
    return with_domain(df, rules).select(
        "id",
        _by_language("title_persian", "title", second_language).alias("title"),
        _by_language("summary_persian", "summary", second_language).alias("summary"),
        body.alias("content"),
        F.col("title_persian").alias("title_api"),
        main_summary().alias("summary_api"),
        "date", "source", "domain",
        "author", "views", "final_score", "type")
