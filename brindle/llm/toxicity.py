"""Toxicity from a learned lexicon, misspellings included.

The lexicon holds words, and stems of inflected words, that labelled toxic
documents use far more often than others. A term is counted once for every
word that it follows, so that copies of one document are no evidence; a stem
needs several forms. The words' trie is walked together with the Levenshtein
automaton of a word, whose states are rows of the edit table cut off above
the allowed number of edits; that finds the terms within 0, 1 or 2 edits of
it (by the term's length), and the stems of FUZZY_STEM letters or more within
1 edit of any beginning of the word. Words are kept beside the stems they
begin with, so that misspelled forms of shorter stems are found by the whole
word. By the pigeonhole principle a word within k edits of a term keeps one of
k+1 pieces of it, the first at its start, the last at its end (for stems: at
most one place from where it belongs); words that keep none are not walked.

Each hit is weighed by its context window: between quotation marks it counts
as quotation, not abuse. A logistic model over the weighted hits gives the
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resident import drop, kept
from .sampling import bounded, fold
from .scratch import small_batches
from .words import filled, scan, slices

PER_LABEL = 2000
CONTEXT_WORDS = 8
LEAST_ODDS = 2.5
STEM_LENGTHS, LEAST_FORMS = (4, 5, 6, 7, 8), 6
FUZZY_STEM = 6
LEAST_G = 25.0  # log-likelihood ratio of a term's counts; chance terms stay below
CACHE_WORDS = 300_000
TOGETHER = 64  # texts whose contexts are gathered at once
OPENING, CLOSING = "\"“„«‹‘「", "\"”“»›’」"
_RUN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
FEATURES = ("strongest", "weight", "density", "fuzzy", "quoted")


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool = False


def edits(term: Term) -> int:
    if term.stem:
        return int(len(term.text) >= FUZZY_STEM)
    return 0 if len(term.text) < 5 else 1 if len(term.text) < 10 else 2


class Automaton:
    """Terms within reach of a word: the lexicon's trie walked with the word's Levenshtein automaton."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.exact = {t.text: i for i, t in enumerate(terms) if not t.stem}
        self.stems = {t.text: i for i, t in enumerate(terms) if t.stem}
        self.stem_lengths = sorted({len(t) for t in self.stems}, reverse=True)
        self.trie: dict = {}
        self.most = max(map(edits, terms), default=0)
        #: By a word's length: beginnings, ends (by their lengths) and middles that a word in reach can keep.
        self.kept: dict[int, tuple[dict[int, set[str]], dict[int, set[str]], set[str]]] = {}
        #: The same for stems: beginnings by their lengths, and ends by their lengths and where they may stand.
        self.stem_starts: dict[int, set[str]] = {}
        self.stem_ends: dict[tuple[int, int], set[str]] = {}
        for i, t in enumerate(terms):
            k, n = edits(t), len(t.text)
            if not k:
                continue
            node = self.trie
            for c in t.text:
                node = node.setdefault(c, {})
            node["" if not t.stem else "*"] = i
            if t.stem:
                self.stem_starts.setdefault(n // 2, set()).add(t.text[: n // 2])
                for at in range(n // 2 - 1, n // 2 + 2):
                    self.stem_ends.setdefault((at, n - n // 2), set()).add(t.text[n // 2 :])
                continue
            pieces = [t.text[j * n // (k + 1) : (j + 1) * n // (k + 1)] for j in range(k + 1)]
            for length in range(n - k, n + k + 1):
                starts, ends, middles = self.kept.setdefault(length, ({}, {}, set()))
                starts.setdefault(len(pieces[0]), set()).add(pieces[0])
                ends.setdefault(len(pieces[-1]), set()).add(pieces[-1])
                middles.update(pieces[1:-1])

    def step(self, row: tuple[int, ...], word: str, c: str) -> tuple[int, ...]:
        """The automaton's next state after the trie's character c; entries above most are all alike."""
        cut = self.most + 1
        out = [min(row[0] + 1, cut)]
        for i, w in enumerate(word):
            out.append(min(row[i] + (w != c), row[i + 1] + 1, out[i] + 1, cut))
        return tuple(out)

    def may_reach(self, word: str) -> bool:
        if any(word[:n] in x for n, x in self.stem_starts.items()) or any(word[at : at + n] in x for (at, n), x in self.stem_ends.items()):
            return True
        if (kept := self.kept.get(len(word))) is None:
            return False
        starts, ends, middles = kept
        return any(word[:n] in x for n, x in starts.items()) or any(word[-n:] in x for n, x in ends.items()) or any(m in word for m in middles)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the term with the fewest edits, the strongest of such; None if none is in reach."""
        if (i := self.exact.get(word)) is not None:
            return i, 0
        for n in self.stem_lengths:
            if (i := self.stems.get(word[:n])) is not None:
                return i, 0
        return self.walk(word) if self.may_reach(word) else None

    def walk(self, word: str) -> tuple[int, int] | None:
        best: tuple[int, float, int] | None = None
        stack = [(self.trie, tuple(min(i, self.most + 1) for i in range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c in ("", "*"):
                    term = self.terms[child]
                    distance = min(row) if term.stem else row[-1]  # a stem may end anywhere in the word
                    if distance <= edits(term) and (best is None or (distance, -term.weight, child) < best):
                        best = (distance, -term.weight, child)
                elif min(after := self.step(row, word, c)) <= self.most:
                    stack.append((child, after))
        return None if best is None else (best[2], best[0])


class Scorer:
    """Features of texts under a lexicon."""

    def __init__(self, terms: list[Term]):
        self.automaton, self.terms = Automaton(terms), terms
        self.cache: dict[int, tuple[int, int] | None] = {}

    def chunk(self, raw: bytes) -> tuple[int, int] | None:
        """The best match of the words in a run of characters without white space."""
        found = [m for w in _RUN.findall(raw.decode("utf-8", "replace").lower()) if (m := self.automaton.match(w))]
        return min(found, key=lambda m: (m[1], -self.terms[m[0]].weight)) if found else None

    def features(self, texts: pa.Array) -> np.ndarray:
        """(texts, FEATURES), in slices of the column's bytes; each distinct chunk is matched once."""
        out = np.zeros((len(texts), len(FEATURES)))
        if not self.terms:
            return out
        for lo, _, data, offsets in slices(texts):
            words = scan(data, offsets)
            values, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            raw, cache, hit = data.tobytes(), self.cache, np.zeros(len(values), bool)
            keys, starts, ends = values.tolist(), words.starts[first].tolist(), words.ends[first].tolist()
            for i, key in enumerate(keys):
                if key not in cache:
                    cache[key] = self.chunk(raw[starts[i] : ends[i]])
                hit[i] = cache[key] is not None
            at = np.flatnonzero(hit[inverse])
            docs = np.searchsorted(words.first, at, "right") - 1
            for d in np.unique(docs):
                a, b = int(words.first[d]), int(words.first[d + 1])
                out[lo + d] = self.weigh(raw, words, [(int(i), *cache[keys[inverse[i]]]) for i in at[docs == d]], a, b)
        return out

    def weigh(self, raw: bytes, words, hits: list[tuple[int, int, int]], a: int, b: int) -> list[float]:
        strongest = total = fuzzy = quotes = 0.0
        for i, term, distance in hits:
            quoted = self.quoted(raw, words, i, a, b)
            w = self.terms[term].weight * (1 - 0.4 * distance) * (0.05 if quoted else 1.0)
            strongest, total = max(strongest, w), total + w
            fuzzy += distance > 0
            quotes += quoted
        n = len(hits)
        return [strongest, math.log1p(total), math.log1p(100 * total / (b - a)), fuzzy / n, quotes / n]

    def quoted(self, raw: bytes, words, i: int, a: int, b: int) -> bool:
        """Whether quotation marks open before a hit and close after it, within the context window."""
        before = raw[words.starts[max(a, i - CONTEXT_WORDS)] : words.starts[i]].decode("utf-8", "replace")
        own = raw[words.starts[i] : words.ends[i]].decode("utf-8", "replace")
        after = raw[words.ends[i] : words.ends[min(b - 1, i + CONTEXT_WORDS)]].decode("utf-8", "replace")
        opened = own[:1] in OPENING and own[:1] or next((c for c in reversed(before) if c in OPENING or c in CLOSING), "")
        closed = next((c for c in reversed(own) if c in CLOSING), "") or next((c for c in after if c in CLOSING or c in OPENING), "")
        if before.count('"') % 2 == 0 and opened == '"' and own[:1] != '"':
            return False
        return opened in OPENING and bool(opened) and closed in CLOSING and bool(closed)


def _contexts(among: frozenset[str] | None):
    """Distinct (term, form, word before it) of texts; terms are w + a word, or s + the beginning of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for texts in (filled(b.column("text")).slice(k, TOGETHER) for b in batches for k in range(0, len(b), TOGETHER)):
            seen: set[tuple[str, str, str]] = set()
            for text in texts.to_pylist():
                words = _RUN.findall(text.lower())
                for w, before in set(zip(words, ["", *words], strict=False)):
                    terms = [f"w{w}"] if len(w) >= 3 else []
                    terms += [f"s{w[:n]}" for n in STEM_LENGTHS if len(w) > n]
                    seen.update((t, w, before) for t in terms if among is None or t in among)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(3)], ["term", "form", "before"])

    return run


def _frequencies(rows: DataFrame, among: frozenset[str] | None, least: int) -> dict[str, int]:
    """Contexts of each term with at least least of them; stems with enough forms."""
    found = rows.select("text").mapInArrow(_contexts(among), "term string, form string, before string").distinct()
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("form", 0.02).alias("forms"))
    enough = (F.col("n") >= least) & (F.substring("term", 1, 1).eqNullSafe("w") | (F.col("forms") >= (LEAST_FORMS if among is None else 0)))
    return {r["term"]: r["n"] for r in counts.where(enough).collect()}  # of a bounded sample


def _evidence(t: int, c: int, bad: int, good: int) -> float:
    """Log-likelihood ratio of t toxic and c clean documents with a term against one rate for both."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (t + c) / (bad + good)
    return 2 * (part(t, bad, t / bad) + part(c, good, c / max(1, good)) - part(t, bad, p) - part(c, good, p))


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Terms of a bounded labelled sample (text, toxic) with log odds of LEAST_ODDS and evidence of LEAST_G at least."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    toxic = _frequencies(sample.where("toxic = 1"), None, max(4, bad // 500))
    clean = _frequencies(sample.where("toxic = 0"), frozenset(toxic), 1)
    strong: dict[str, float] = {}
    for term, t in toxic.items():
        t, c = min(t, bad), min(clean.get(term, 0), good)
        odds = math.log((t + 0.5) / (bad + 1)) - math.log((c + 0.5) / (good + 1))
        if odds >= LEAST_ODDS and _evidence(t, c, bad, good) >= LEAST_G:
            strong[term] = odds
    stems: dict[str, float] = {}
    for term in sorted((t for t in strong if t[0] == "s"), key=len):
        if not any(term[1:].startswith(s) for s in stems):
            stems[term[1:]] = strong[term]
    terms = [Term(s, odds, True) for s, odds in stems.items()]
    terms += [Term(t[1:], odds) for t, odds in strong.items() if t[0] == "w"]
    return sorted(terms, key=lambda t: t.text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(terms: list[Term]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            x = scorer.features(filled(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _scorer(terms: tuple[Term, ...]) -> Scorer:
    return kept(("scorer", terms), lambda: Scorer(list(terms)))


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = _scorer(self.terms).features(filled(texts))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learns lexicon and weights from about per_label documents of each label outside fold 0. Without labels, all scores are 0."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((fold() != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded(known, "toxic", per_label)
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").where(F.col("text").isNotNull()).persist(StorageLevel.DISK_ONLY)
    try:
        terms = learn_lexicon(sample)
        rows = sample.mapInArrow(_features(terms), "toxic int, x array<double>").collect()  # bounded by per_label
    finally:
        sample.unpersist()
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(tuple(terms), (0.0,) * len(FEATURES) + (30.0 if len(y) and y[0] else -30.0,))
    return Model(tuple(terms), tuple(fit_logistic(np.array([r["x"] for r in rows]), y)))


def _scored(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(model.scores(batch.column("text")))], [*columns, "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of documents.

    Null and empty texts, and texts without a hit, get the model's base rate.
    Repeated rows get equal scores. Only doc_id and text are read.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() == 0).alias("held_out"))
    rows = docs.mapInArrow(_scored(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of documents scored below threshold, all their columns as they are."""
    small_batches(documents.sparkSession)
    schema = documents.schema
    names = [f"c{i}" for i in range(len(schema))]
    inner = documents.toDF(*names)
    text = names[documents.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text)) < threshold))

    return inner.mapInArrow(run, inner.schema).toDF(*schema.names)
