"""Full-text search on DataFrames: tokens, conjunctive match, BM25, highlight and snippet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    return [t for x in re.findall(r"[^\W]+(?:'[\w']*)*|'[\w']+", query.lower()) if (t := x.strip("'_"))]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, _ and ', without _ and ' at their ends."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}_']+)"), F.lit(1))
    return F.array_remove(F.transform(runs, lambda x: F.regexp_replace(x, "^['_]+|['_]+$", "")), "")


def _equals(term: str):
    return lambda x: x == F.lit(term)


def match(documents: DataFrame, key: str, columns: list[str], query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, rank) of the documents that hold all terms of query in any of columns; rank is BM25.

    Documents are scanned once: term frequencies and lengths are counted in
    each row, and only counts of one row per corpus are shuffled.
    """
    wanted = terms_of(query)
    distinct = sorted(set(wanted))
    joined = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    counted = documents.select(F.col(key), tokens(joined).alias("__t")).select(key, F.size("__t").alias("__dl"), *(F.size(F.filter("__t", _equals(t))).alias(f"__tf{i}") for i, t in enumerate(distinct)))
    if not distinct:
        return counted.where(F.lit(False)).select(key, F.lit(0.0).alias("rank"))
    totals = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(distinct))))
    hits = counted.where(" AND ".join(f"__tf{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(totals))  # totals is one row
    score = F.lit(0.0)
    for t in wanted:
        i = distinct.index(t)
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))
    return hits.select(key, score.alias("rank"))


def _hit(word: Column, query: str) -> Column:
    return F.arrays_overlap(tokens(word), F.array(*map(F.lit, sorted(set(terms_of(query))) or [""])))


def highlight(text: Column, query: str, before: str, after: str) -> Column:
    """text with every white-space-delimited word that holds a term wrapped; white space is kept."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(\\s+|\\S+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(_hit(x, query), F.concat(F.lit(before), x, F.lit(after))).otherwise(x)), "")


def snippet(text: Column, query: str, before: str, after: str, ellipsis: str, n: int) -> Column:
    """n words around the first match, joined by single spaces."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\s+"), "")

    def of(w: Column) -> Column:
        hits = F.transform(w, lambda x: _hit(x, query))
        first = F.greatest(F.array_position(hits, True).cast("int") - 1, F.lit(0))
        start = F.greatest(F.least(first - n // 2, F.size(w) - n), F.lit(0))
        shown = F.transform(F.slice(w, start + 1, n), lambda x: F.when(_hit(x, query), F.concat(F.lit(before), x, F.lit(after))).otherwise(x))
        return F.concat(F.when(start > 0, F.lit(ellipsis)).otherwise(""), F.array_join(shown, " "), F.when(start + n < F.size(w), F.lit(ellipsis)).otherwise(""))

    return F.transform(F.array(words), of)[0]
