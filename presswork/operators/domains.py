"""Registered domains found by joining suffix rules."""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presswork.functions.suffixes import SuffixRules, public_rules, rules_of_table
from presswork.functions.urls import domain_at, host, last_labels
from presswork.operators.binding import bind


def _levels(rules: SuffixRules) -> dict[int, dict[str, tuple[bool, bool, bool]]]:
    """Rules by their number of labels: suffix to (exact, wildcard, exception)."""
    levels: dict[int, dict[str, tuple[bool, bool, bool]]] = {}
    for suffix in rules.exact | rules.wildcard | rules.exception:
        kinds = (suffix in rules.exact, suffix in rules.wildcard, suffix in rules.exception)
        levels.setdefault(suffix.count(".") + 1, {})[suffix] = kinds
    return dict(sorted(levels.items()))


@lru_cache(maxsize=4)
def _tables(rules: SuffixRules) -> tuple[tuple[int, pa.Table], ...]:
    """A table for each number of labels, made once for a set of rules."""
    tables = []
    for d, found in _levels(rules).items():
        suffixes = sorted(found)
        exact, wild, exception = zip(*(found[s] for s in suffixes))
        tables.append((d, pa.table({
            f"_suffix{d}": suffixes, f"_exact{d}": exact, f"_wild{d}": wild, f"_exempt{d}": exception})))
    return tuple(tables)


def _by_rules(hosts: DataFrame, rules: SuffixRules) -> DataFrame:
    """Adds ``domain`` to rows with a ``_host``.

    One join for each number of labels a rule can have, so a row meets at most
    one rule per join and is never multiplied. The rules are broadcast: their
    number is bounded, and the rows stay where they are.
    """
    name = F.lower("_host")
    labels = F.size(F.split(name, r"\."))
    out = hosts
    lengths: list[Column] = [F.lit(0), F.lit(0)]
    exempt: list[Column] = []
    for d, table in _tables(rules):
        level = hosts.sparkSession.createDataFrame(table)
        key = F.when(labels >= d, last_labels(name, d))
        out = out.join(F.broadcast(level), key == F.col(f"_suffix{d}"), "left")
        lengths.append(F.when(F.col(f"_exact{d}"), d))
        lengths.append(F.when(F.col(f"_wild{d}") & (labels > d), d + 1))
        exempt.insert(0, F.when(F.col(f"_exempt{d}"), d - 1))
    longest = F.nullif(reduce(lambda a, b: F.greatest(a, b), lengths), F.lit(0))
    count = F.coalesce(*exempt, longest)
    domain = F.coalesce(domain_at(F.col("_host"), count), F.lit(""))
    return out.select(*hosts.columns, domain.alias("domain"))


def with_domain(df: DataFrame, rules: SuffixRules | DataFrame | None = None,
                url_column: str = "url") -> DataFrame:
    """Adds ``domain``, the registered domain of a URL.

    ``rules`` are those of the public list unless others, or a table (suffix,
    is_wildcard, is_exception), are given. '' for addresses, bare suffixes, and
    hosts under no known suffix; NULL for a NULL URL. The host is worked out once.
    """
    if isinstance(rules, DataFrame):
        rules = rules_of_table(rules)
    url = F.col(url_column)
    found = _by_rules(bind(df, "_host", host(url)), public_rules() if rules is None else rules)
    found = bind(found, "_domain", F.when(url.isNotNull(), F.col("domain")))
    return found.select(*df.columns, F.col("_domain").alias("domain"))
