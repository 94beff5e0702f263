"""Quality rules: a decision list over text statistics, learned from labels, run as Spark expressions.

Statistics are column expressions.  Rules that reject are learned one after the other by sequential
covering: a rule grows threshold conditions by information gain, is pruned on rows that did not grow
it, and takes the rows it covers away.  The list becomes one ordered `when` chain; no Python runs on
the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The list is learned from at most so many labelled documents, chosen by a hash of doc_id.
LABELLED_ROWS = 20_000
#: Statistics that conditions may test.
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mean_word", "bang_share", "digit_share", "distinct_share")


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, given the array column words.

    Windows sorted by hash stand next to their equals; of the repeated ones, in text order, each
    covers three words less those that the next one covers too."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))
    return F.when(n >= 4, F.array_sort(windows))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and FEATURES.

    Words are runs of other characters than space and \\t-\\r.  A null text has none.  A line counts as
    duplicate if it has a word and equals an earlier line.  Shares are 0 where their base is 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn("__trimmed", F.btrim(text, F.lit(BLANKS)))
    step = step.withColumn("__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", "[\\x20\\x09-\\x0D]+")))
    step = step.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    step = step.withColumn("__sorted", _repeat_words(F.col("__words")))
    s, last = F.col("__sorted"), F.size("__sorted") - 1

    def h(k: Column) -> Column:
        return F.get(s, k)["h"]

    again = F.filter(F.sequence(F.lit(0), last), lambda k: (h(k) == h(k - 1)) | (h(k) == h(k + 1)))
    places = F.array_sort(F.transform(again, lambda k: F.get(s, k)["i"]))
    step = step.withColumn("__places", F.when(s.isNotNull(), places))
    p, end = F.col("__places"), F.size("__places") - 1
    covered = F.aggregate(
        F.sequence(F.lit(0), end), F.lit(0), lambda total, k: total + F.when(k == end, 3).otherwise(F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k)))
    )
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.size("__places") > 0, covered), F.lit(0)).cast("long"),
            "__upper": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "__bang": F.length(text) - F.length(F.translate(text, "!?", "")),
            "__digit": F.length(text) - F.length(F.translate(text, "0123456789", "")),
            "__n_lines": F.size("__lines"),
            "__distinct": F.size(F.array_distinct("__words")),
        }
    )

    def share(part: Column | str, whole: str) -> Column:
        part = F.col(part) if isinstance(part, str) else part
        return F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(0.0)

    step = step.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "__n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("__upper", "word_chars"),
            "mean_word": share("word_chars", "n_words"),
            "bang_share": share("__bang", "word_chars"),
            "digit_share": share("__digit", "word_chars"),
            "distinct_share": share("__distinct", "n_words"),
        }
    )
    return step.drop("__trimmed", "__words", "__lines", "__sorted", "__places", "__upper", "__bang", "__digit", "__n_lines", "__distinct")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.bound if self.above else row[self.feature] <= self.bound

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


def _cuts(values: list[float], most: int = 64) -> list[float]:
    """Midpoints between distinct values, at most `most` of them, evenly spread over the rows."""
    ordered = sorted(values)
    step = max(1, len(ordered) // most)
    picks = sorted({*ordered[::step], ordered[-1]})
    return [(a + b) / 2 for a, b in zip(picks, picks[1:], strict=False)]


def _grow(rows: list[dict], target: str, features: tuple[str, ...], most: int) -> list[Condition]:
    """Conditions added while they gain information about the target class."""
    rule: list[Condition] = []
    while len(rule) < most:
        good = sum(r[target] for r in rows)
        if not good or good == len(rows):
            break
        before, best, choice = math.log2(good / len(rows)), 1e-9, None
        for feature in features:
            marked = sorted((r[feature], r[target]) for r in rows)
            cuts, k, below, below_good = _cuts([v for v, _ in marked]), 0, 0, 0
            for bound in cuts:
                while k < len(marked) and marked[k][0] <= bound:
                    below, below_good, k = below + 1, below_good + marked[k][1], k + 1
                for above, n, p in ((False, below, below_good), (True, len(marked) - below, good - below_good)):
                    if p:
                        gain = p * (math.log2(p / n) - before)
                        if gain > best:
                            best, choice = gain, Condition(feature, above, bound)
        if choice is None:
            break
        rule.append(choice)
        rows = [r for r in rows if choice.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list[dict], target: str) -> float:
    """(p - n) / (p + n) over the rows that the rule covers; -1 if none."""
    covered = [r[target] for r in rows if all(c.holds(r) for c in rule)]
    return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0


def learn(rows: list[dict], target: str, features: tuple[str, ...] = FEATURES, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9) -> list[list[Condition]]:
    """An ordered list of rules, each a conjunction, that cover the rows whose target is 1.

    Of each three rows two grow a rule and one prunes it.  Learning ends with most_rules rules, or with the first one
    that is right about fewer than least_precision of the rows it covers, or covers fewer than three; a rule has
    most_conditions conditions at most.  These bound the list, not the rows that it judges."""
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and any(r[target] for r in rows):
        growing, pruning = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        rule = _grow(growing, target, features, most_conditions)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda cut: _worth(cut, pruning, target))
        covered = [r[target] for r in rows if all(c.holds(r) for c in rule)]
        if len(covered) < 3 or sum(covered) < least_precision * len(covered):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, **bounds) -> list[list[Condition]]:
    """Learn the list from the statistics of labelled documents that pass the base filter, within the bounds of learn().

    At most `rows` labelled documents are used, those of the least hash of doc_id; only their
    statistics come to the driver.  Null labels are left out; a doc_id labelled more than once counts
    as 1 if any of its labels is 1."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    # a filter would be pushed below the statistics and compute them once more, so it runs here
    got = stats.select("doc_id", "base_failed", *FEATURES, (F.col("__quality") == 0).cast("int").alias("bad")).collect()
    ordered = sorted((r.asDict() for r in got if not r["base_failed"]), key=lambda r: (hash((r["doc_id"] * 2654435761) & 0xFFFFFFFF), r["doc_id"]))
    return learn(ordered, "bad", **bounds)


def verdict(rules: list[list[Condition]]) -> Column:
    """False for the rows that a rule rejects, as an ordered chain of conditions."""
    chain = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, (c.column() for c in rule))
        chain = F.when(holds, False) if chain is None else chain.when(holds, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fired(rules: list[list[Condition]]) -> Column:
    """The rule that rejects a row, as text; null if none."""
    chain = None
    for rule in rules:
        holds, name = reduce(lambda a, b: a & b, (c.column() for c in rule)), " and ".join(map(str, rule))
        chain = F.when(holds, F.lit(name)) if chain is None else chain.when(holds, F.lit(name))
    return F.lit(None).cast("string") if chain is None else chain


def judge(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, **bounds) -> DataFrame:
    """docs with statistics(), `kept` and `rule`: kept is false if the base filter fails or a learned
    rule fires.  Without labels nothing is learned and the base filter decides alone.

    Rules are learned on `rows` labelled documents at most, those of the least hash of doc_id, with
    thresholds at 64 quantiles of each statistic at most; of rules that do equally well the first in the order
    of the statistics wins; the list has at most 12 rules of 4 conditions, each right about nine in ten of what it
    covers, unless bounds (most_rules, most_conditions, least_precision) say otherwise.  Each row is judged by its own text, so repeated rows are judged alike; columns of
    docs that have such a name are replaced; an empty table gives none; a long text is counted whole."""
    rules = fit(docs, labels, rows, **bounds)
    return statistics(docs).withColumns({"kept": ~F.col("base_failed") & verdict(rules), "rule": F.when(~F.col("base_failed"), fired(rules))})
