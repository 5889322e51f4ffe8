"""Recursive queries with set semantics, and deeper than the engine's own recursion allows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brindle.sources.shared import shared_dir


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 10_000, every: int = 5) -> DataFrame:
    """anchor, then step of the last new rows, until none are new.

    With distinct, rows found before are dropped by an anti-join (null-safe),
    so cycles end. Each round's rows are checkpointed in the folder that the
    session shares, their union every few rounds.
    """
    spark = anchor.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    names = anchor.columns
    new = anchor.distinct() if distinct else anchor
    total = new
    for k in range(1, most + 1):
        found = step(new).toDF(*names)
        if distinct:
            seen = total.toDF(*(f"__{n}" for n in names))
            same = [found[n].eqNullSafe(seen[f"__{n}"]) for n in names]
            found = found.distinct().join(seen, same, "left_anti")
        new = found.checkpoint()  # read by the next round, and by every later one as part of the total
        if new.isEmpty():
            return total
        total = total.union(new)
        if k % every == 0:
            total = total.checkpoint()
    raise RecursionError(f"more than {most} rounds")
