"""Host and registered domain of a URL as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from presswork.functions.suffixes import SuffixRules
from presswork.functions.text import WHITESPACE, with_value

# Optional scheme, optional user part, then the host up to port, path, query
# or fragment. Works for scheme-less and otherwise broken URLs, which the URL
# parser built into Spark refuses.
_HOST = r"^(?:(?:[A-Za-z0-9+.-]+:)?//)?(?:[^/?#]*@)?([^/:?#@]*)"

# Characters that separate host labels besides the plain dot.
_WIDE_DOTS = "。．｡"


def host(url: Column) -> Column:
    """The host name of a URL, '' when there is none; NULL stays NULL."""
    name = F.btrim(F.regexp_extract(url, _HOST, 1), F.lit(WHITESPACE))
    return F.rtrim(F.translate(name, _WIDE_DOTS, "..."), F.lit("."))


def last_labels(name: Column, count: int | Column) -> Column:
    """The last ``count`` labels of a host name, all of it when it has fewer."""
    if isinstance(count, int):
        return F.substring_index(name, ".", -count)
    return F.call_function("substring_index", name, F.lit("."), -count)


def domain_at(name: Column, suffix_labels: Column) -> Column:
    """The host's suffix and one more label; '' where that label is missing."""
    has_more = F.size(F.split(name, r"\.")) > suffix_labels
    domain = last_labels(name, suffix_labels + 1)
    return F.when(has_more & ~F.startswith(domain, F.lit(".")), domain).otherwise("")


def suffix_labels(name: Column, rules: SuffixRules) -> Column:
    """How many labels of a lower-case host are its public suffix, else NULL.

    The longest rule wins, and an exception beats the wildcard it is made for.
    Membership tests against constants become hash lookups.
    """
    def by_depth(names: frozenset[str]) -> dict[int, list[str]]:
        depths: dict[int, list[str]] = {}
        for suffix in sorted(names):
            depths.setdefault(suffix.count(".") + 1, []).append(suffix)
        return depths

    labels = F.size(F.split(name, r"\."))
    exact, wild, exempt = map(by_depth, (rules.exact, rules.wildcard, rules.exception))
    deepest = max([*exact, *(d + 1 for d in wild), *exempt], default=0)
    cases: list[tuple[Column, int]] = []
    for depth, names in sorted(exempt.items(), reverse=True):
        cases.append((last_labels(name, depth).isin(names), depth - 1))
    for depth in range(deepest, 0, -1):
        hits = []
        if depth in exact:
            hits.append(last_labels(name, depth).isin(exact[depth]))
        if depth - 1 in wild:
            hits.append(last_labels(name, depth - 1).isin(wild[depth - 1]))
        if hits:
            cases.append(((labels >= depth) & reduce(Column.__or__, hits), depth))
    if not cases:
        return F.lit(None).cast("int")
    (condition, count), *rest = cases
    chain = F.when(condition, count)
    for condition, count in rest:
        chain = chain.when(condition, count)
    return chain


def registered_domain(url: Column, rules: SuffixRules) -> Column:
    """The domain a site owner registered, e.g. ``b.co.uk`` for ``a.b.co.uk``.

    '' for addresses, bare suffixes, and hosts under no known suffix. Rules are
    matched without regard to case; the result keeps the URL's own letters. They
    become constants of the plan, so this form suits a few dozen rules;
    ``with_domain`` takes the public list.
    """

    def domain(name: Column) -> Column:
        labels = with_value(F.lower(name), lambda lowered: suffix_labels(lowered, rules))
        return F.coalesce(with_value(labels, lambda count: domain_at(name, count)), F.lit(""))

    return F.when(url.isNotNull(), with_value(host(url), domain))
