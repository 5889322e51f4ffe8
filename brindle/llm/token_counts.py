"""Token counts of flat token files without an index, by their separators.

A flat file is a run of token ids, each document's ids followed by an
end-of-document id, cut into blocks of equal size with no regard to
documents. Each block is searched for separators with one vectorised
comparison. A prefix scan over the blocks' summaries (separators so far, ids
since the last separator) stitches documents that cross blocks and gives
every document its ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import token_ids
from .scratch import Scratch

BLOCK_IDS = 1 << 16
FLAT = "kind string, part int, k long, doc_id long, ids binary"


def _flat(dtype: np.dtype, block_ids: int, encode):
    """Documents as they come to blocks of block_ids ids; and, apart from them, which doc_id is the k-th of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ordinal, held, width = TaskContext.get().partitionId(), 0, 0, b"", block_ids * dtype.itemsize

        def rows(kind: str, first: int, doc_ids: pa.Array, ids: pa.Array) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), doc_ids, ids], ["kind", "part", "k", "doc_id", "ids"])

        for batch in encode(batches):
            yield rows("document", ordinal, batch.column("doc_id"), pa.nulls(len(batch), pa.binary()))
            ordinal += len(batch)
            for lo in range(0, len(batch), 256):
                held += b"".join(batch.column("ids").slice(lo, 256).to_pylist())
                blocks = [held[i : i + width] for i in range(0, len(held) - width + 1, width)]
                if blocks:
                    yield rows("block", block, pa.nulls(len(blocks), pa.int64()), pa.array(blocks, pa.binary()))
                    block, held = block + len(blocks), held[len(blocks) * width :]
        if held:
            yield rows("block", block, pa.nulls(1, pa.int64()), pa.array([held], pa.binary()))

    return run


SCANNED = "part int, block long, n_ids long, n_ends long, last_end long, ends array<int>"


def _scan(dtype: np.dtype, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, dtype) for x in batch.column("ids").to_pylist()]
            ends = [np.flatnonzero(x == end_id).astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("k"), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(e) for e in ends], pa.int64()), pa.array([int(e[-1]) if len(e) else -1 for e in ends], pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
                [x.split()[0] for x in SCANNED.split(", ")],
            )

    return run


def counts_of_blocks(blocks: DataFrame, dtype: np.dtype, end_id: int, scratch: Scratch) -> DataFrame:
    """(part, k, n_tokens) of the k-th document of each flat file, from blocks (part, k, ids).

    n_tokens is without the separator. Ids after a file's last separator
    belong to no document. The scan over summaries is a window of one file's
    blocks: a file is one task's output, so its number of blocks is bounded.
    """
    scanned = scratch.write(blocks.select("part", "k", "ids").mapInArrow(_scan(dtype, end_id), SCANNED), "scanned")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    placed = scanned.select("part", "block", "n_ids", "n_ends", "last_end").withColumn("start", start)
    opened = F.when(F.col("n_ends") > 0, F.col("start") + F.col("last_end") + 1)
    carried = placed.withColumn("first_k", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("open", F.coalesce(F.max(opened).over(before), F.lit(0))).select("part", "block", "start", "first_k", "open")
    rows = scanned.where("n_ends > 0").select("part", "block", "ends").join(carried, ["part", "block"])
    return rows.select("part", "start", "first_k", "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "part",
        (F.col("first_k") + F.col("i")).alias("k"),
        (F.col("start") + F.col("end") - F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)).alias("n_tokens"),
    )


def token_counts(documents: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens of every whole text (null: empty), counted in the flat files it writes.

    Special tokens' strings in texts are encoded as ordinary text, so end_id
    can only be a separator. Each task of the scan writes one file, in the
    order of its rows, so nothing is shuffled but counts; repeated rows each
    get a count. Only doc_id and text are read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "counts")
    dtype = token_ids.dtype_of(tokenizer_path)
    encode = token_ids.tokenised(tokenizer_path, end_id, special_as_text=True)
    flat = documents.select("doc_id", "text").mapInArrow(_flat(dtype, block_ids, encode), FLAT)
    flat.write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("flat"))
    flat = spark.read.schema(FLAT).parquet(scratch.path("flat"))
    counted = counts_of_blocks(flat.where("kind = 'block'"), dtype, end_id, scratch)
    named = flat.where("kind = 'document'").select("part", "k", "doc_id")
    return named.join(counted, ["part", "k"]).select("doc_id", "n_tokens")
