"""Token ids in a binary file format: frequency ranks, byte-aligned codes, separate control bytes.

Ids are replaced by their rank of frequency in the whole corpus, so that
frequent ids take one byte. A rank takes 1 to 4 bytes; the lengths, two bits
each, stand apart in control bytes, four ids to a byte. A block holds the
control bytes, the data bytes, and for each of its documents the doc_id and
the number of ids. Blocks are rows of a Parquet container: Spark's committer
makes the write safe against lost tasks, and any store that Spark can write
will do. Files and the blocks in them ascend by doc_id. A header beside them
holds the id of each rank, the end id and where each file starts, so that the
folder alone is enough to read the ids.

Reading looks the lengths of four ids up in a table by the control byte, and
gathers all ids of a block at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_ids
from .scratch import Scratch

BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = "part int, block int, start long, n_ids long, doc_ids binary, counts binary, nulls binary, control binary, data binary"
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of uint32."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    at = ends - lengths
    raw = np.zeros(len(data) + 3, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        out |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[lengths]


def _blocks(ranks: np.ndarray, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            control, data = encode(ranks[ids])
            row = [part, block, start, len(ids), np.array([d or 0 for d, _ in held], "<i8").tobytes(), np.array([len(x) // dtype.itemsize for _, x in held], "<u4").tobytes(), bytes(d is None for d, _ in held), control, data]
            block, start, held, size = block + 1, start + len(ids), [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append((doc_id, ids.as_py()))
                size += len(held[-1][1]) // dtype.itemsize
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def _read(ids_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of[decode(row["control"], row["data"], row["n_ids"])].astype("<u4")
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(counts), pa.int32()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool)),
                        pa.array(row["start"] + ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
                    ],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return run


def _explode_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            seen = np.frombuffer(x, np.int64)
            total = seen.copy() if total is None else total + seen
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])


HEADER_SCHEMA = "ids_of binary, end_id long, parts binary, starts binary"


class TokenFiles:
    """Token files in a folder, opened from the folder alone: blocks, ids_of (the id of each rank), end_id, and starts (part, ids before it)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
        header = spark.read.schema(HEADER_SCHEMA).parquet(f"{path}/header").first()
        self.ids_of, self.end_id = np.frombuffer(header["ids_of"], "<u4"), header["end_id"]
        self.starts = list(zip(*(np.frombuffer(header[c], "<i8").tolist() for c in ("parts", "starts")), strict=True))

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 for each document, from the files' bytes."""
        rows = self.blocks.mapInArrow(_read(self.ids_of), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
        bases = self.spark.createDataFrame(self.starts or [(0, 0)], "part int, base long")
        return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None, words: int | None = None) -> TokenFiles:
    """Encodes every whole text (null: empty) and writes the ids, each document's followed by end_id, to the folder path.

    Documents ascend by doc_id, null first; rows with one doc_id are ordered
    by their number of ids and the ids. Only doc_id and text are read.
    An empty table gives no blocks. Without path the files go to the shared
    folder. words bounds a worker's word table, see token_ids; it changes no
    result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or scratch.path("files")
    dtype = token_ids.dtype_of(tokenizer_path)
    made = documents.select("doc_id", "text").mapInArrow(token_ids.tokenised(tokenizer_path, end_id, counts=True, words=words), token_ids.SCHEMA)
    ids = scratch.write(made, "ids")
    frequency = ids.where(F.col("kind") == token_ids.COUNTS).select("ids").mapInArrow(_explode_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    vocabulary = token_ids.load(tokenizer_path, False).get_vocab_size()
    n = np.zeros(max([vocabulary, end_id + 1, *(r["id"] + 1 for r in frequency)]), np.int64)
    for r in frequency:
        n[r["id"]] = r["n"]
    ids_of = np.argsort(-n, kind="stable").astype("<u4")
    ranks = np.empty(len(n), np.uint32)
    ranks[ids_of] = np.arange(len(n), dtype=np.uint32)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = token_ids.in_order(ids.where(F.col("kind") == token_ids.IDS), shuffled)
    ordered.mapInArrow(_blocks(ranks, dtype), BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each file
    parts = np.array(sorted((r["part"], r["n"]) for r in sizes), "<i8").reshape(-1, 2)
    starts = np.cumsum(parts[:, 1]) - parts[:, 1]
    header = (bytearray(ids_of.tobytes()), end_id, bytearray(parts[:, 0].astype("<i8").tobytes()), bytearray(starts.astype("<i8").tobytes()))
    spark.createDataFrame([header], HEADER_SCHEMA).coalesce(1).write.parquet(f"{path}/header")
    scratch.drop("ids")
    return TokenFiles(spark, path)


def token_digest(documents: DataFrame, tokenizer_path: str, end_id: int = 1, words: int | None = None) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return write_token_files(documents, tokenizer_path, end_id, words=words).read()
