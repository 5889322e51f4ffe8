"""Bounded, repeatable samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out of all learning. A null id counts as empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def bounded(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the key; all of them where there are fewer."""
    rates = {r[label]: per_label / r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, rate in rates.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (chance < rate))
    return rows.where(keep)
