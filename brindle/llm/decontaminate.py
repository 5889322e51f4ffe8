"""Benchmark decontamination with SimHash windows, in DataFrame expressions only.

A document leaks an item if a window of the document, as many words long as
the item, has a weighted similarity of 0.75 or more with it: shingles of
five words (all words of a shorter item) with their numbers of occurrences,
the sum of minima over the sum of maxima.

1. A window with c shingles and an item with n reach that only if they share
   at least percent * (c + n) / (100 + percent) of them. One pass hashes every
   shingle of every text and keeps the places of shingles that items hold;
   for each length of items, the windows that hold enough of these places,
   whatever their order and whichever items they are from, are fingerprinted.
   Of windows that begin with the same such place only the last is taken: the
   others hold no more. Nothing that can reach the similarity is left out.
2. Windows and items get a 64-bit SimHash. The items' hashes are indexed by
   eight blocks of eight bits, each block with all values up to two flips
   away: by the pigeonhole principle every pair within RADIUS (8 * 3 - 1)
   meets in a block. At a similarity of 0.75 a pair's distance is 11 on
   average with a deviation of 3; 0.002 % of such pairs lie beyond RADIUS. A
   window meets 71 % of unlike items of its length in some block, 2 % are
   left by the distance.
3. Pairs within the radius are verified exactly on their shingles.

Sums of bits are packed, two 32-bit counters to a long, more than the shingles
of any text. Words are runs without white space of the lower-cased
text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WIDTH = 5
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_ROWS = 500_000  # of 16 to 40 bytes each
_LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]", -1), "")


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of all shingles. The words are bound once: an optimizer that moves this expression can't repeat them per shingle."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(w[i + j] for j in range(width))))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to be small; joined by shuffle otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def simhash(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n and fp: majority of each bit over a group's rows h (a row for each occurrence)."""
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(32)))
    fp = F.lit(0).cast("long")
    for j, lane in itertools.product(range(32), range(2)):
        count = F.shiftrightunsigned(F.col(f"s{j}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
        bit = 1 << (j + 32 * lane)
        fp = fp.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, "n", fp.alias("fp"))


def _blocks(fp: str) -> Column:
    return F.posexplode(F.array(*(F.shiftrightunsigned(F.col(fp), BLOCK_BITS * b).bitwiseAND(F.lit(0xFF)).cast("int") for b in range(BLOCKS)))).alias("block", "value")


def _flips() -> Column:
    masks = [sum(1 << b for b in some) for k in range(FLIPS + 1) for some in itertools.combinations(range(BLOCK_BITS), k)]
    return F.explode(F.array(*map(F.lit, masks)))


def _starts(percent: int) -> Column:
    """Where windows begin that hold enough of the places `at`: with the i-th place, if the place that makes up the number is in the window."""
    own = F.least("doc_len", "len") - F.col("width") + 1
    least = F.expr(f"({percent} * (least(doc_len, len) + len - 2 * width + 2) + {100 + percent - 1}) div {100 + percent}").cast("int")
    last = F.greatest(F.col("doc_len") - F.col("len"), F.lit(0))
    inner = F.transform("at", lambda p, i: F.when(F.get("at", i + least - 1) < p + own, F.least(p, last)))
    end = F.when((F.size("at") >= least) & (F.get("at", F.size("at") - least) >= last), last)
    return F.array_distinct(F.array_compact(F.concat(inner, F.array(end))))


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """doc_key, doc_id, item_id, first_word, n_words, shared, total: the best window of each document and item.

    100 * shared >= percent * total holds. A window begins with a shingle that
    some item of its length holds, or ends with the text; ties go to the
    first such window. A text shorter than an item is one window.
    doc_key is a hash of doc_id and text, see keyed(): equal rows are one
    document here. Equal rows of benchmark are one item; different texts
    with one item_id (null too) are compared each, and the best is reported.
    Null and empty texts, items without words, and empty tables give no rows.
    Only doc_id, item_id and the texts are read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    read = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = read.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("len"), F.least(F.size("words"), F.lit(WIDTH)).alias("width")).dropDuplicates(["item"])
    per_width = [items.where(F.col("width") == w).select("item", "item_id", "len", "width", F.posexplode_outer(shingles_of(F.col("words"), w)).alias("q", "h")) for w in range(1, WIDTH + 1)]
    known = per_width[0]
    for more in per_width[1:]:
        known = known.union(more)
    known = scratch.write(known, "items")
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # five at most
    keys = known.groupBy("width", "h").agg(F.lit(1).alias("one"))

    docs = keyed(documents).select("doc_key", "doc_id", "text")
    texts = docs.select("doc_key", words_of(F.col("text")).alias("words"))
    found = None
    for w in widths or [WIDTH]:
        own = texts.select("doc_key", F.size("words").alias("doc_len"), shingles_of(F.col("words"), w).alias("hs"))
        rows = own.select("doc_key", "doc_len", F.posexplode_outer("hs").alias("p", "h")).join(_small(keys.where(F.col("width") == w).select("h")), "h").withColumn("width", F.lit(w))
        found = rows if found is None else found.union(rows)
    hits = scratch.write(found, "hits")
    lengths = known.select("width", "h", "len").distinct()
    placed = hits.join(_small(lengths), ["width", "h"]).groupBy("doc_key", "doc_len", "width", "len").agg(F.sort_array(F.collect_set("p")).alias("at"))  # a group is part of one text
    windows = scratch.write(placed.select("doc_key", "width", "len", F.explode(_starts(percent)).alias("start")), "windows")

    hit_docs = _small(windows.select("doc_key").distinct(), 2_000_000)
    there = docs.join(hit_docs, "doc_key").dropDuplicates(["doc_key"])
    there = scratch.write(there.select("doc_key", "doc_id", words_of(F.col("text")).alias("words")), "texts")
    cut = None
    for w in widths or [WIDTH]:
        hashed = there.select("doc_key", shingles_of(F.col("words"), w).alias("hs"))
        part = windows.where(F.col("width") == w).join(hashed, "doc_key").select("doc_key", "width", "len", "start", F.explode_outer(F.slice("hs", F.col("start") + 1, F.col("len") - w + 1)).alias("h"))
        cut = part if cut is None else cut.union(part)
    rows = scratch.write(cut, "rows")

    window = ["doc_key", "width", "len", "start"]
    prints = scratch.write(simhash(rows, *window).withColumnRenamed("n", "n_window"), "prints")
    item_prints = simhash(known, "item", "width", "len").select("item", "width", "len", F.col("n").alias("n_item"), F.col("fp").alias("item_fp"))
    index = item_prints.select("*", _blocks("item_fp")).select("*", _flips().alias("flip")).select("item", "width", "len", "n_item", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = prints.select("*", _blocks("fp"))
    near = probes.join(_small(index), ["width", "len", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    candidates = near.select(*window, "n_window", "item", "n_item").distinct()

    counted = rows.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("c"))
    item_counts = known.groupBy("item", "h").agg(F.count(F.lit(1)).alias("c_item"))
    shared = candidates.join(counted, window).join(_small(item_counts), ["item", "h"]).groupBy(*window, "item", "n_window", "n_item").agg(F.sum(F.least("c", "c_item")).alias("shared"))
    scored = shared.withColumn("total", F.col("n_window") + F.col("n_item") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("total"))
    names = known.select("item", "item_id").distinct()
    best = scored.join(_small(names), "item").groupBy("doc_key", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("s"), (-F.col("start")).alias("at"), F.col("len"), "shared", "total")).alias("x"))
    out = best.join(there.select("doc_key", "doc_id"), "doc_key").select("doc_key", "doc_id", "item_id", (-F.col("x.at")).alias("first_word"), F.col("x.len").alias("n_words"), "x.shared", "x.total")
    return scratch.write(out, "leaks")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("doc_key", F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of documents that leak no item, all their columns as they are (a column doc_key of their own included)."""
    gone = leaks(documents, benchmark, percent).select(F.col("doc_key").alias("__leaking")).distinct()
    key = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return documents.join(_small(gone, 2_000_000), key == gone["__leaking"], "left_anti")
