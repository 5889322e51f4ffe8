"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of each text come from array and string functions on its own row;
nothing is shuffled. Sequential covering learns the list on a bounded sample
of labelled statistics: each rule is grown condition by condition on two
thirds of the sample, pruned on the rest, and covers rows of low quality;
rules are added while they are precise. The list becomes one ordered
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded, fold

PER_LABEL = 3000
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "distinct_share", "line_words")
LEAST_PRECISION = 0.95
MOST_RULES, MOST_CONDITIONS, CUTS = 8, 3, 40


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep places next to an equal hash, measure their union."""

    def of_sorted(s: Column) -> Column:
        same = lambda x, k, d: s[k + d]["h"] == x["h"]
        twice = F.filter(s, lambda x, k: ((k > 0) & same(x, k, F.when(k > 0, -1).otherwise(0))) | ((k < F.size(s) - 1) & same(x, k, F.when(k < F.size(s) - 1, 1).otherwise(0))))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, start, add, lambda a: a["n"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(ordered), of_sorted)[0]  # binds the sorted array once


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """keep and the base statistics and features of each whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = documents.select(*keep, text.alias("text"), F.split(text, "[\\x20\\x09-\\x0D]", -1).alias("pieces"))
    split = cut.select(*keep, "text", F.array_remove("pieces", "").alias("words"), (F.length("text") - F.size("pieces") + 1).cast("long").alias("word_chars"))
    n = F.size("words")
    windows = F.transform(F.array("words"), lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + j] for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))[0]
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    wide = split.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", windows.alias("windows"), lines.alias("lines"), F.size(F.array_distinct("words")).alias("n_distinct"),
        _count(F.col("text"), "[#*$%&|<>]").cast("long").alias("n_symbols"), _count(F.col("text"), "[A-Z]").alias("n_upper"), _count(F.col("text"), "!").alias("n_exclaim"),
    )
    repeated = F.transform(F.array("windows"), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))[0]
    based = wide.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_distinct", "n_upper", "n_exclaim",
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    features = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "exclaim_share": ("n_exclaim", "word_chars"), "distinct_share": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines")}
    return based.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(share(a, b).alias(k) for k, (a, b) in features.items()))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.bound) if self.above else F.col(self.feature) < F.lit(self.bound)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.bound if self.above else v < self.bound


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain, covers = None, 1e-9, inside
        for f in FEATURES:
            v = x[:, FEATURES.index(f)]
            for bound in np.unique(np.quantile(v[inside], np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    c = inside & (v >= bound if above else v < bound)
                    p, n = bad[c].sum(), (~bad[c]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain, covers = Condition(f, above, float(bound)), g, c
        if best is None:
            break
        rule, inside = (*rule, best), covers
    return rule


def _precision(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = _holds(rule, x)
    return (bad[c].sum() + 0.5) / (c.sum() + 1.0)


def cover(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering of the rows marked bad; x has a column for each of FEATURES."""
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (bad & left & ~prune).sum() >= 2:
        rule = _grow(x[left & ~prune], bad[left & ~prune])
        px, pb = x[left & prune], bad[left & prune]
        shorter = [rule[:k] for k in range(len(rule), 0, -1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (_precision(r, px, pb), len(r)))
        if _precision(rule, x[left], bad[left]) < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~_holds(rule, x)
    return rules


def learn(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[Rule]:
    """Rules for labels.quality = 0 from about per_label documents of each label outside fold 0; none without labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((fold() != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded(known, "quality", per_label)
    rows = statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "quality").orderBy("doc_id").collect()  # bounded by per_label
    if not rows:
        return []
    return cover(np.array([[float(r[f]) for f in FEATURES] for r in rows]), np.array([r["quality"] == 0 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: false for rows that a rule covers."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each row of documents.

    Null and empty texts have no words and fail the base. Repeated rows get
    equal verdicts. Only doc_id and text are read.
    """
    stats = statistics(documents, "doc_id")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(rules)).alias("kept"))
