"""Quality rules: a decision list over text statistics, learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from presswork.llm.workers import map_batches, with_text

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_lines", "n_distinct_words", "n_capitals", "n_digits", "n_marks"]

#: What rules may compare, as SQL over the statistics.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 2_000_000:  # else three ids fit into one number
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * distinct + ids[2:]
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = counts[at] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(ids) - 2 + shift] |= repeated
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The STATISTICS of one whole text."""
    text = text or ""
    words = text.encode().split()
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (
        len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeat_words(ids, len(index)), len(lines), len(index),
        int(((points >= 65) & (points <= 90)).sum()), int(((points >= 48) & (points <= 57)).sum()),
        text.count("!") + text.count("?"))


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the STATISTICS (long) of every whole text; they replace columns of their names.

    Words are runs of characters other than the six ASCII spaces, lines are split at
    line feeds and count if they hold a word. NULL and empty texts count 0 in all.
    ``keep`` names the columns that stay (all but the text if not given).
    """
    columns = [c for c in (docs.columns if keep is None else keep)
               if c not in STATISTICS and (keep is not None or c != text)]
    schema = StructType([docs.schema[c] for c in columns]
                        + [StructField(s, LongType()) for s in STATISTICS])

    narrow, at = with_text(docs, columns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            rows = np.array([statistics_of(t.as_py()) for t in texts], np.int64)
            rows = rows.reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], *[pa.array(rows[:, i]) for i in range(len(STATISTICS))]],
                names=schema.names)

    return map_batches(narrow, run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        found = values[self.feature] > self.threshold
        return found if self.above else ~found

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = list[Condition]


def _covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    covered = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        covered &= condition.holds(values)
    return covered


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: int, max_conditions: int) -> Rule:
    """Adds the condition with the best information gain until no good row is covered."""
    rule: Rule = []
    covered = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        if not p0:
            break
        best, best_gain = None, 1e-9
        for feature, column in values.items():
            inside = column[covered]
            order = np.argsort(inside, kind="stable")
            inside, is_bad = inside[order], bad[covered][order]
            ends = np.flatnonzero(inside[:-1] < inside[1:])
            if not len(ends):
                continue
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            p_below = np.cumsum(is_bad)[ends]
            n_below = ends + 1 - p_below
            for above, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    cut = (inside[ends[at]] + inside[ends[at] + 1]) / 2
                    best, best_gain = Condition(feature, above, float(cut)), gain[at]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Cuts conditions off the end while that does not lower the rule's worth on unseen rows."""
    def worth(candidate: Rule) -> float:
        covered = _covers(candidate, values)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_rules(statistics: DataFrame, label: str = "label", precision: float = 0.75,
                least: int = 3, cuts: int = 256, max_conditions: int = 4,
                max_rules: int = 16) -> list[Rule]:
    """An ordered list of conjunctions, each of which marks a text as bad (label 0).

    ``statistics`` is a bounded sample with the STATISTICS and a label; it is
    collected. Rows are dealt by number into two thirds for growing and one third for
    pruning. Each rule is grown on what earlier rules left, pruned, and taken if at
    least ``precision`` of all rows it covers in either part, and ``least`` bad ones,
    are bad. With no such rule the list ends; without labels, or with labels of one
    kind only, it is empty.
    """
    table = statistics.selectExpr(
        f"`{label}` = 0 AS bad", *[f"cast({sql} AS double) AS `{f}`" for f, sql in FEATURES.items()],
    ).dropna().toPandas().sort_values(["bad", *FEATURES]).reset_index(drop=True)
    bad = table.pop("bad").to_numpy(bool)
    pruning = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (left & bad).any() and (left & ~bad).any():
        def part(mask: np.ndarray) -> dict[str, np.ndarray]:
            return {f: table[f].to_numpy()[mask] for f in FEATURES}
        rule = _grow(part(left & ~pruning), bad[left & ~pruning], cuts, max_conditions)
        if not rule:
            break
        rule = _prune(rule, part(left & pruning), bad[left & pruning])
        covered = _covers(rule, part(np.ones(len(bad), bool))) & left
        parts = [covered & ~pruning, covered & pruning]
        good_enough = all((c & bad).sum() >= precision * c.sum() for c in parts)
        if (covered & bad).sum() < least or not good_enough:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def deciding_rule(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that covers a row of STATISTICS; NULL if none."""
    number = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        covered = F.lit(True)
        for condition in rules[i - 1]:
            covered = covered & condition.column()
        number = F.when(covered, F.lit(i)).otherwise(number)
    return number


def describe(rules: list[Rule]) -> list[str]:
    """The rules as text."""
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule)
            for rule in rules]
