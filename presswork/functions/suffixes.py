"""Public-suffix rules: the complete public list, or those of a file or table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The public list has about ten thousand rules; more than this is no suffix list.
MAX_RULES = 100_000

_PRIVATE = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="


@dataclass(frozen=True)
class SuffixRules:
    """Rules by kind; the dot-joined labels without the "*." or "!" mark."""

    exact: frozenset[str] = field(default_factory=frozenset)
    wildcard: frozenset[str] = field(default_factory=frozenset)
    exception: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if len(self.exact) + len(self.wildcard) + len(self.exception) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} suffix rules")


def _spellings(rule: str) -> set[str]:
    """A rule in lower case, and as the ASCII form that hosts often carry."""
    rule = rule.lower()
    try:
        return {rule, rule.encode("idna").decode("ascii")}
    except UnicodeError:
        return {rule}


def _rules(marked: list[str]) -> SuffixRules:
    kinds: dict[str, set[str]] = {"exact": set(), "wildcard": set(), "exception": set()}
    for rule in marked:
        if rule.startswith("!"):
            kinds["exception"] |= _spellings(rule[1:])
        elif rule.startswith("*."):
            kinds["wildcard"] |= _spellings(rule[2:])
        else:
            kinds["exact"] |= _spellings(rule)
    return SuffixRules(**{kind: frozenset(rules) for kind, rules in kinds.items()})


def rules_from_text(text: str, private: bool = False) -> SuffixRules:
    """Rules from text in the public suffix list's format.

    ``//`` starts a comment line and other lines hold blank-separated rules. Rules
    of the private section, such as those of hosting companies, count if asked for.
    """
    marked: list[str] = []
    inside = False
    for line in text.splitlines():
        if line.lstrip().startswith("//"):
            inside = _PRIVATE[0] in line or (inside and _PRIVATE[1] not in line)
        elif private or not inside:
            marked += line.split()
    return _rules(marked)


@lru_cache
def public_rules(private: bool = False) -> SuffixRules:
    """The rules of the public suffix list that comes with the package."""
    text = files("presswork.data").joinpath("public_suffix_list.dat").read_text(encoding="utf-8")
    return rules_from_text(text, private)


def suffix_frame(spark: SparkSession, rules: SuffixRules) -> DataFrame:
    """Rules as a table (suffix, is_wildcard, is_exception)."""
    rows = ([(s, False, False) for s in sorted(rules.exact)]
            + [(s, True, False) for s in sorted(rules.wildcard)]
            + [(s, False, True) for s in sorted(rules.exception)])
    suffix, wildcard, exception = zip(*rows) if rows else ((), (), ())
    return spark.createDataFrame(pa.table({
        "suffix": pa.array(suffix, pa.string()),
        "is_wildcard": pa.array(wildcard, pa.bool_()),
        "is_exception": pa.array(exception, pa.bool_())}))


def suffix_table(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The same table, read from a rules file by Spark."""
    return suffix_frame(
        spark, rules_from_text(spark.read.text(path, wholetext=True).first()[0], private))


def rules_of_table(table: DataFrame) -> SuffixRules:
    """The rules of such a table, at most MAX_RULES."""
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} suffix rules")
    return _rules([("!" if r["is_exception"] else "*." if r["is_wildcard"] else "") + r["suffix"]
                   for r in rows])
