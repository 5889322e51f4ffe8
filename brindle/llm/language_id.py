"""Language by rank-order profiles of n-grams.

A profile ranks the most frequent letter n-grams (n = 1 to 3, words padded by
a blank) of a language. A document's own most frequent n-grams are compared
with each profile: the distance is the sum of how far each is out of place,
with the profile's length for n-grams that the profile lacks.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import bounded, fold
from .words import filled

PROFILE = 400
PER_LANGUAGE = 1500
UNDETERMINED = "und"
_BLANK = 1  # no letter has this code point


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of a text, repeats included: 21 bits for each code point."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(letter, codes, _BLANK)
    padded = np.concatenate(([_BLANK], codes, [_BLANK])).astype(np.uint64)
    padded = padded[(padded != _BLANK) | np.concatenate(([True], padded[:-1] != _BLANK))]
    two = padded[:-1] | padded[1:] << np.uint64(21)
    three = two[:-1] | padded[2:] << np.uint64(42)
    return np.concatenate((padded[padded != _BLANK], two, three[padded[1:-1] != _BLANK]))


def ranked(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, most first; ties by the key."""
    values, counts = np.unique(keys, return_counts=True)
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        few = counts >= least
        values, counts = values[few], counts[few]
    return values[np.argsort(-counts, kind="stable")[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), filled(batch.column("text")).to_pylist(), strict=True):
            values, counts = np.unique(grams(text), return_counts=True)
            seen = total.setdefault(lang, Counter())
            for v, c in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] += c
    for lang, seen in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def learn(labelled: DataFrame, profile: int = PROFILE, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """The ranked profile of each lang, from a bounded sample of (doc_id, text, lang)."""
    counts = bounded(labelled, "lang", per_language).select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= profile).collect():  # profile rows for each lang
        top.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: np.array([gram for _, gram in sorted(top[lang])], np.uint64) for lang in sorted(top)}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs, self.size = list(profiles), max((len(p) for p in profiles.values()), default=1)
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for k, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.keys, p), k] = np.arange(len(p))

    def __call__(self, text: str) -> tuple[str, float]:
        own = ranked(grams(text), self.size)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0) / (self.size * len(own))
        order = np.argsort(off, kind="stable")
        best = off[order[0]]
        next_best = off[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], float(min(1.0, max(0.0, 1 - best / next_best))) if next_best > 0 else 0.0


def _predict(profiles: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles)
        for batch in batches:
            found = [classify(t) for t in filled(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, profile: int = PROFILE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents (doc_id, text, lang).

    Profiles come from about per_language rows of each lang outside fold 0;
    null langs are not learned from. A null text, one without a letter, or an
    empty training set gives 'und' with score 0. score is how much nearer the
    best profile is than the second. Ties go to the first lang by name.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    profiles = learn(docs.where((fold() != 0) & F.col("lang").isNotNull()), profile, per_language)
    return docs.select("doc_id", "text", (fold() == 0).alias("held_out")).mapInArrow(_predict(profiles), "doc_id long, held_out boolean, lang_pred string, score double")
