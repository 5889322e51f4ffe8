"""MinHash near-dedup with an LSH forest.

A text's set holds its distinct 5-word shingles (all words as one shingle if
there are fewer; none without words). Two texts are linked if
``100 * intersection >= 75 * union`` of the full sets.

1. One pass over the texts makes each set's 128-bit identity and a signature
   of 128 minima of 16 bits. Equal sets collapse to one node.
2. The forest has 16 trees. Tree t orders all signatures by the values
   8t, 8t+11, 8t+22 ... (taken cyclically); range partitioning and sorting lay
   out each tree, so no prefix is a key of one task. Candidates of a node are
   its nearest rows in each tree, those with the longest common prefix: in
   crowded regions rows must agree deeper to be nearest, elsewhere two
   values are enough.
3. Pairs whose signatures agree on too few of 128 values are put away (4.3
   standard deviations below a similarity of 0.75).
4. Each node's best pair is verified first, on the full sets. The others are
   verified only where they would join two components.
5. A window that is full of rows with the least prefix may have cut others off.
   Nodes with such a window in any tree, linked or not, are the crowd, and
   the crowd is finished exactly: sets of a similarity of 0.75 share one of
   the rarest quarter of their shingles (prefix filter), so components that
   share none of these, in any number of steps, are in different pools. Pools
   are made of components, not of nodes: a component that is alone in its pool
   needs no further work. In a pool all sets of different components are
   compared in full, in cells of bounded size: those outside its largest
   component against all.

Null and empty texts have no set and are linked with nothing. Repeated rows
stay rows; rows with one doc_id and different texts are different nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, merged
from .resident import drop
from .scratch import Scratch
from .words import filled, mix, random_u64, scan, shingles, slices

HASHES, TREES, DEPTH, REACH, LEAST_PREFIX = 128, 16, 12, 3, 2
CELL_SHINGLES, CELL_SETS, DENSE = 1 << 18, 2048, 64
_XOR = (random_u64(HASHES, 101) >> np.uint64(32)).astype(np.uint32)
_MUL = (random_u64(HASHES, 202) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ORDERS = np.array([[(8 * t + 11 * i) % HASHES for i in range(DEPTH)] for t in range(TREES)])


def least_matches(percent: int, hashes: int = HASHES) -> int:
    p = percent / 100
    return int(hashes * p - 4.3 * (hashes * p * (1 - p)) ** 0.5)


def signatures(hashes: np.ndarray, first: np.ndarray, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL, kind: type = np.uint16) -> np.ndarray:
    """A row for each text: the low bits of its minima under len(xor) functions; texts without shingles are left at 0."""
    n = len(first) - 1
    out = np.zeros((n, len(xor)), kind)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(h)
        at = first[full]
        for j in range(len(xor)):
            np.bitwise_xor(h, xor[j], out=v)
            np.multiply(v, mul[j], out=v)
            v ^= v >> np.uint32(15)
            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
            out[full, j] = np.minimum.reduceat(v, at).astype(kind)
    return out


def identity(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits for each set of distinct hashes, whatever their order."""
    out: list[bytes | None] = []
    for s in sets:
        if len(s):
            a, b = mix(s + np.uint64(1)), mix(s ^ np.uint64(0x5851F42D4C957F2D))
            out.append(np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(b)], ">u8").tobytes())
        else:
            out.append(None)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop()
    for batch in batches:
        texts, ids = filled(batch.column("text")), batch.column("doc_id")
        for lo, hi, data, offsets in slices(texts):
            hashes, first = shingles(scan(data, offsets))
            sets = [np.unique(hashes[first[k] : first[k + 1]]) for k in range(hi - lo)]
            sig = signatures(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()),
                    batch.column("row").slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(identity(sets), pa.binary()),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ],
                ["doc_id", "row", "n_shingles", "node", "sig"],
            )


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the tree's number and the values of its order, big-endian."""
    for batch in batches:
        node = batch.column("node")
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        for t in range(TREES):
            key = np.empty((len(sig), 1 + 2 * DEPTH), np.uint8)
            key[:, 0] = t
            key[:, 1:] = np.ascontiguousarray(sig[:, _ORDERS[t]], ">u2").view(np.uint8).reshape(len(sig), -1)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()), node], ["key", "node"])


def _pairs(keys: list[bytes], nodes: list[bytes]) -> pa.RecordBatch:
    """Pairs of rows at most REACH apart; a row that shares the prefix with one further away is paired with itself."""
    width = 1 + 2 * DEPTH
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
    found: set[tuple[bytes, bytes]] = set()
    for step in range(1, REACH + 1):
        same = (rows[step:] == rows[:-step])[:, : 1 + 2 * LEAST_PREFIX].all(axis=1)
        for i in np.flatnonzero(same):
            a, b = nodes[i], nodes[i + step]
            if a != b:
                found.add((a, b) if a < b else (b, a))
    cut = (rows[REACH + 1 :] == rows[: -REACH - 1])[:, : 1 + 2 * LEAST_PREFIX].all(axis=1)
    for i in np.flatnonzero(cut):
        found.update(((nodes[i], nodes[i]), (nodes[i + REACH + 1], nodes[i + REACH + 1])))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near rows in sorted partitions; REACH + 1 rows are carried from batch to batch."""
    keys: list[bytes] = []
    nodes: list[bytes] = []
    for batch in batches:
        keys, nodes = keys[-REACH - 1 :] + batch.column("key").to_pylist(), nodes[-REACH - 1 :] + batch.column("node").to_pylist()
        yield _pairs(keys, nodes)


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last REACH + 1 rows of each partition, to be stitched to the next."""
    head: list[tuple[bytes, bytes]] = []
    tail: list[tuple[bytes, bytes]] = []
    for batch in batches:
        rows = list(zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), strict=True))
        head = (head + rows[: REACH + 1])[: REACH + 1]
        tail = (tail + rows[-REACH - 1 :])[-REACH - 1 :]
    rows = head + tail
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.binary())], ["key", "node"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            some = batch.slice(k, 64)
            sets = [np.frombuffer(m, np.int64) for m in some.column("members").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([some.column("node").take(of), pa.array(np.concatenate(sets))], ["node", "h"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) sizes of the intersections of all sets: matrix products for shingles of many sets, single pairs for the rest."""
    n, out = len(left), np.zeros((len(left), len(right)), np.float32)
    of = np.repeat(np.arange(n + len(right)), [len(x) for x in (*left, *right)])
    values, ids = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    order = np.argsort(ids, kind="stable")  # of is ascending: in each id's run the left sets come first
    of, ids = of[order], ids[order]
    first = np.searchsorted(ids, np.arange(len(values) + 1))
    lefts = np.bincount(ids[of < n], minlength=len(values))
    rights = np.diff(first) - lefts
    dense = (lefts > 0) & (rights > 0) & (lefts + rights > DENSE)
    some = np.flatnonzero(dense)
    for k in range(0, len(some), 512):
        x = np.zeros((n + len(right), 512), np.float32)
        for j, v in enumerate(some[k : k + 512]):
            x[of[first[v] : first[v + 1]], j] = 1
        out += x[:n] @ x[n:].T
    rare = np.flatnonzero((of < n) & ~dense[ids] & (rights[ids] > 0))
    for k in range(0, len(rare), 1 << 16):
        at = rare[k : k + (1 << 16)]
        many, begin = rights[ids[at]], (first[:-1] + lefts)[ids[at]]
        to = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        np.add.at(out, (np.repeat(of[at], many), of[to] - n), 1)
    return out.astype(np.int64)


def _compared(percent: int):
    """Links of a cell's left sets to its right sets, as many as join its components."""

    def run(cell: pa.Table) -> pa.Table:
        sides = [cell.filter(pc.equal(cell.column("left"), x)) for x in (True, False)]
        found: list[tuple[bytes, bytes]] = []
        if all(len(x) for x in sides):
            left, right = ([np.frombuffer(m, np.uint64) for m in x.column("members").to_pylist()] for x in sides)
            names = sorted(set(cell.column("label").to_pylist()))
            number = {x: i for i, x in enumerate(names)}
            a, b = (np.array([number[x] for x in side.column("label").to_pylist()]) for side in sides)
            common = intersections(left, right)
            total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - common
            at, to = np.nonzero((100 * common >= percent * total) & (a[:, None] != b))
            _, once = np.unique(np.minimum(a[at], b[to]) * len(names) + np.maximum(a[at], b[to]), return_index=True)
            up = list(range(len(names)))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            nodes = [x.column("node").to_pylist() for x in sides]
            for i, j in zip(at[once].tolist(), to[once].tolist(), strict=True):
                x, y = top(int(a[i])), top(int(b[j]))
                if x != y:
                    up[x] = y
                    found.append((nodes[0][i], nodes[1][j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return run


def _finished(crowd: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) that join components of the crowd (node, label, members), by exact comparison."""
    rows = scratch.write(crowd.select("node", "members").mapInArrow(_exploded, "node binary, h long"), "crowd-rows", "lz4")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = rows.join(shared, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("hs"))
    # Shingles that no other set has come first in a prefix of size - ceil(percent of size) + 1; they are counted, not kept.
    need = F.ceil(F.length("members") / 8 * percent / 100).cast("int")
    prefixes = crowd.select("node", "label", need.alias("need")).join(ranked, "node").where(F.size("hs") >= F.col("need"))
    keys = scratch.write(prefixes.select("label", F.explode(F.slice("hs", F.lit(1), F.size("hs") - F.col("need") + 1)).alias("x")).select("label", "x.h").distinct(), "crowd-keys", "lz4")
    hubs = keys.groupBy("h").agg(F.min("label").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pools = connected(keys.join(hubs, "h").select(F.col("label").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct(), scratch, "pools").select(F.col("node").alias("label"), F.col("label").alias("pool"))

    pooled = pools.join(crowd.select("node", "label", (F.length("members") / 8).cast("long").alias("size")), "label")
    counted = pooled.groupBy("pool", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("mass"))
    cells = lambda mass, sets: F.ceil(F.greatest(mass / CELL_SHINGLES, sets / CELL_SETS)).cast("int")
    biggest = counted.groupBy("pool").agg(F.max(F.struct("mass", "sets", "label")).alias("top"), F.sum("mass").alias("mass"), F.sum("sets").alias("sets"))
    grid = biggest.select("pool", F.col("top.label").alias("top"), cells(F.col("mass"), F.col("sets")).alias("columns"), cells(F.col("mass") - F.col("top.mass"), F.col("sets") - F.col("top.sets")).alias("lines")).where("lines > 0")
    placed = pooled.drop("size").join(grid, "pool").join(crowd.select("node", "members"), "node")
    line, column = (F.pmod(F.xxhash64("node", F.lit(x)), F.col(x)).cast("int") for x in ("lines", "columns"))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    fields = ["pool", "line", "column", "left", "node", "label", "members"]
    left = placed.where("label <> top").withColumn("line", line).withColumn("column", every("columns")).withColumn("left", F.lit(True))
    right = placed.withColumn("column", column).withColumn("line", every("lines")).withColumn("left", F.lit(False))
    both = left.select(*fields).union(right.select(*fields))
    links = scratch.write(both.groupBy("pool", "line", "column").applyInArrow(_compared(percent), "a binary, b binary"), "links-crowd")
    scratch.drop("crowd-rows", "crowd-keys")
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, texts = batch.column("node"), filled(batch.column("text"))
        for lo, hi, data, offsets in slices(texts):
            hashes, first = shingles(scan(data, offsets))
            sets = [np.unique(hashes[first[k] : first[k + 1]]) for k in range(hi - lo)]
            same = [i == n.as_py() for i, n in zip(identity(sets), node.slice(lo, hi - lo), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [node.slice(lo, hi - lo).filter(pa.array(same)), pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())], ["node", "members"]
            )


def linked(sets_a: pa.Array, sets_b: pa.Array, percent: int) -> list[bool]:
    out = []
    for a, b in zip(sets_a.to_pylist(), sets_b.to_pylist(), strict=True):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.concatenate((x, y))
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= percent * (len(x) + len(y) - common))
    return out


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(linked(batch.column("x"), batch.column("y"), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept: one row for each row of documents.

    component_id is the smallest doc_id that can be reached over links, kept
    says whether the row is that document. Null and empty texts keep
    themselves. Extra columns of documents are not read. A null doc_id stays
    null: it names its component only if the component has no other, and its
    row is then kept if it stands alone.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    signed = scratch.write(docs.mapInArrow(_signed, "doc_id long, row long, n_shingles long, node binary, sig binary"), "signed", "lz4")
    nodes = scratch.write(
        signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("sig").alias("sig")), "nodes", "lz4"
    )

    forest = nodes.select("node", "sig").mapInArrow(_planted, "key binary, node binary").repartitionByRange(_parts(spark), "key", "node").sortWithinPartitions("key", "node")
    pairs = scratch.write(_with_seams(forest), "pairs")
    both = (
        pairs.where("a <> b").distinct()
        .join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    )
    candidates = scratch.write(both.mapInArrow(_alike(least_matches(percent)), "a binary, b binary, alike int"), "candidates")

    cut = scratch.write(pairs.where("a = b").select(F.col("a").alias("node")).distinct(), "cut")
    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).union(cut).distinct()
    where = nodes.select("node", "row").join(wanted, "node")
    members = scratch.write(docs.join(where, "row").select("node", "text").mapInArrow(_sets, "node binary, members binary").groupBy("node").agg(F.first("members").alias("members")), "members", "lz4")

    def verify(some: DataFrame, name: str) -> DataFrame:
        rows = some.select("a", "b").join(members.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
        return scratch.write(rows.mapInArrow(_verified(percent), "a binary, b binary"), name)

    ends = candidates.select("a", "b", F.explode(F.array("a", "b")).alias("node"), "alike")
    best = ends.groupBy("node").agg(F.max(F.struct("alike", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    joined = connected(verify(best, "links-best"), scratch, "best")
    label = lambda side: joined.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    rest = (
        candidates.select("a", "b").join(best, ["a", "b"], "left_anti")
        .join(label("a"), "a", "left").join(label("b"), "b", "left")
        .where("coalesce(a_label, a) <> coalesce(b_label, b)")
    )
    near = merged(joined, verify(rest, "links-rest"), scratch, "near")
    crowd = scratch.write(cut.join(near, "node", "left").select("node", F.coalesce("label", "node").alias("label")).join(members, "node"), "crowd", "lz4")
    labels = merged(near, _finished(crowd, scratch, percent), scratch, "all")
    found = nodes.select("node", "doc_id").join(labels, "node")
    smallest = found.groupBy("label").agg(F.min("doc_id").alias("component"))
    component = found.join(smallest, "label").select("node", "component")
    named = scratch.write(nodes.select("node", F.col("doc_id").alias("own")).join(component, "node", "left").select("node", F.coalesce("component", "own").alias("component_id")), "named")
    scratch.drop("pairs", "candidates", "members", "cut", "crowd", "links-best", "links-rest", "links-crowd")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def deduplicated(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id; all columns as they are.

    Rows with a null doc_id have no name by which they could go and stay.
    """
    gone = near_duplicates(documents, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
    text_hash = F.xxhash64(F.col("doc_id"), F.col("text"))
    repeats = documents.groupBy(text_hash.alias("__again")).count().where("count > 1").select("__again").persist()
    if repeats.isEmpty():
        return left
    once = left.join(repeats, text_hash == repeats["__again"], "left_anti")
    again = left.join(repeats, text_hash == repeats["__again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again)


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _with_seams(forest: DataFrame) -> DataFrame:
    """Neighbours inside partitions, and over their borders: 2 * (REACH + 1) rows of each partition meet in one sort."""
    inside = forest.mapInArrow(_neighbours, "a binary, b binary")
    borders = forest.mapInArrow(_edges_of, "key binary, node binary").distinct().coalesce(1).sortWithinPartitions("key", "node")
    return inside.union(borders.mapInArrow(_neighbours, "a binary, b binary"))


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in "xy")
            alike = (x == y).sum(axis=1)
            keep = pa.array(alike >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(alike, pa.int32()).filter(keep)], ["a", "b", "alike"])

    return run
