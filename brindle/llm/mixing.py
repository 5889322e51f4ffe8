"""Mixing documents to target weights of domains with soft membership.

A naive Bayes classifier over hashed byte trigrams, fitted on a bounded
sample of rows labelled with a domain, gives each document a posterior over
the domains. Document d with n_d tokens of the pipeline's tokenizer has a
rate r_d >= least; its copies count n_d * r_d * p_dk tokens towards domain k. The rates minimise the
squared distance between these expected totals and the targets by projected
gradient steps, scaled by the domains' second moments. A step depends on the
rows only through sums of one number per domain, so every step is one
distributed aggregation, and the rates follow from the list of steps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded
from .scratch import Scratch
from .token_ids import encoder
from .words import _LOWER, _SPACE, filled, slices

PER_DOMAIN = 1500
BUCKETS = 1 << 12
TEXTS = 512  # counted at once: a text takes 16 KB, however short it is
SHARPNESS = 60.0  # trigrams' worth of evidence that a posterior may rest on
STEPS, TOLERANCE = 25, 1e-6
TEMPER = 0.7


def bucketed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) counts of byte trigrams; digits count as one byte, white space as another."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    b = _LOWER[data].astype(np.uint32)
    b[(b >= 48) & (b < 58)] = 48
    b[_SPACE[data]] = 32
    if len(b) > 2:
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        for k in np.flatnonzero(np.diff(offsets) > 2):
            out[k] = np.bincount(h[offsets[k] : offsets[k + 1] - 2], minlength=BUCKETS)
    return out


def _domain_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        domains = batch.column("domain").to_pylist()
        for lo, hi, data, offsets in slices(filled(batch.column("text")), rows=TEXTS):
            x = bucketed(data, offsets)
            for k in range(lo, hi):
                total[domains[k]] = total.get(domains[k], 0) + x[k - lo].astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["domain", "counts"])


def fit(documents: DataFrame, domain: str, per_domain: int = PER_DOMAIN) -> tuple[list[str], np.ndarray]:
    """(domains, log probabilities (BUCKETS, domains)) from about per_domain rows of each non-null domain."""
    rows = documents.select("doc_id", "text", F.col(domain).cast("string").alias("domain")).where(F.col("domain").isNotNull() & F.col("text").isNotNull())
    parts = bounded(rows, "domain", per_domain).select("domain", "text").mapInArrow(_domain_counts, "domain string, counts array<double>")
    summed = parts.select("domain", F.posexplode("counts").alias("b", "c")).groupBy("domain", "b").agg(F.sum("c").alias("c")).where("c > 0").collect()  # domains x BUCKETS at most
    domains = sorted({r["domain"] for r in summed})
    counts = np.full((BUCKETS, len(domains)), 0.5)
    for r in summed:
        counts[r["b"], domains.index(r["domain"])] += r["c"]
    return domains, np.log(counts / counts.sum(axis=0))


def _posteriors(logs: np.ndarray, tokenizer: str, words: int | None = None):
    weights = logs.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, words=words)
        for batch in batches:
            texts = filled(batch.column("text"))
            for lo, hi, data, offsets in slices(texts, rows=TEXTS):
                x = bucketed(data, offsets)
                n = x.sum(axis=1, keepdims=True)
                z = (x @ weights).astype(np.float64) / np.maximum(n, 1) * np.minimum(n, SHARPNESS)
                p = np.exp(z - z.max(axis=1, keepdims=True)) if weights.shape[1] else z
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                _, tokens = coder.encode(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_key").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_key", "doc_id", "n_tokens", "posterior"])

    return run


def rates(p: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    r = np.full(len(p), max(1.0, least))
    for g in steps:
        r = np.maximum(least, r - p @ g)
    return r


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _totals(k: int, steps: list[np.ndarray], least: float, moments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p, n = _matrix(batch.column("posterior"), k), batch.column("n_tokens").to_numpy(zero_copy_only=False)
            r = rates(p, steps, least)
            total += (n * r) @ p
            if moments:
                second += (p * n[:, None]).T @ p
        values = np.concatenate((total, second.ravel() if moments else []))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "x"])

    return run


class Mixture:
    """members: doc_key, doc_id, n_tokens, posterior; domains; targets and reached token totals; the steps of the rates.

    weights name known domains only, others get none; ValueError otherwise, or
    if they are negative or all zero. residual is the largest gap between
    reached and targets as a share of all tokens: it is TOLERANCE or less
    where the targets were met, and more where the documents cannot meet them
    or STEPS steps were too few. Null and empty texts have no tokens and
    posteriors of equal parts; rows without a domain are mixed, not learned
    from; without any domain, all rates are 1. Extra columns are not read.
    words bounds a worker's word table, see token_ids; it changes no result.
    """

    def __init__(self, documents: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0, per_domain: int = PER_DOMAIN, tokenizer: str | None = None, words: int | None = None):
        spark = documents.sparkSession
        scratch = Scratch(spark, "mixing")
        if tokenizer is None:
            from .queries import tokenizer_path

            tokenizer = tokenizer_path()
        self.least, self.steps = least, []
        self.domains, logs = fit(documents, domain, per_domain)
        k = len(self.domains)
        keyed = documents.select(_key(documents).alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.members = scratch.write(keyed.mapInArrow(_posteriors(logs, tokenizer, words), "doc_key long, doc_id long, n_tokens long, posterior array<double>"), "members")
        if not k:
            self.targets = self.reached = np.zeros(0)
            self.residual = 0.0
            return
        sums = self._sum(True)
        natural, second = sums[:k], sums[k:].reshape(k, k)
        size = max(1.0, natural.sum())
        share = natural / size
        if weights and (unknown := sorted(set(weights) - set(self.domains))):
            raise ValueError(f"weights name domains that no labelled row has: {', '.join(unknown)}")
        if weights and not (min(weights.values()) >= 0 and sum(weights.values()) > 0):
            raise ValueError("weights must not be negative, and not all zero")
        wanted = np.array([weights.get(d, 0.0) for d in self.domains]) if weights else np.where(share > 0, share, 1e-12) ** TEMPER
        wanted = wanted / wanted.sum()
        scale = max(share[wanted > 0] / wanted[wanted > 0]) if least >= 1 else 1.0
        self.targets = wanted * scale * size
        inverse = np.linalg.inv(second / size + 1e-6 * np.eye(k))
        self.reached = natural if least <= 1 else self._sum(False)
        for _ in range(STEPS):
            gap = (self.reached - self.targets) / size
            if np.abs(gap).max() < TOLERANCE:
                break
            self.steps.append(inverse @ gap)
            before, self.reached = self.reached, self._sum(False)
            if np.abs(self.reached - self.targets).sum() >= np.abs(before - self.targets).sum() * (1 - 1e-9):
                break
        self.residual = float(np.abs(self.reached - self.targets).max() / size)

    def _sum(self, moments: bool) -> np.ndarray:
        rows = self.members.select("n_tokens", "posterior").mapInArrow(_totals(len(self.domains), self.steps, self.least, moments), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        k = len(self.domains)
        out = np.zeros(k + k * k if moments else k)
        for r in rows:
            out[r["i"]] = r["x"]
        return out

    def rated(self) -> DataFrame:
        """doc_key, doc_id, n_tokens, domain (the likeliest; null without domains), posterior, rate, copies.

        copies is the rate rounded up or down by a hash of the document, so
        that expected copies equal the rate and any rerun gives the same.
        """
        domains, steps, least = self.domains, self.steps, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = _matrix(batch.column("posterior"), len(domains)) if domains else np.zeros((len(batch), 0))
                r = rates(p, steps, least) if domains else np.ones(len(p))
                top = [domains[i] for i in p.argmax(axis=1)] if domains else [None] * len(p)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "doc_id", "n_tokens", "posterior")), pa.array(top, pa.string()), pa.array(r)], ["doc_key", "doc_id", "n_tokens", "posterior", "domain", "rate"])

        rows = self.members.mapInArrow(run, "doc_key long, doc_id long, n_tokens long, posterior array<double>, domain string, rate double")
        chance = F.pmod(F.xxhash64("doc_key", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
        whole = F.floor(F.col("rate") + 1e-9)
        return rows.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("long")).cast("long"))


def _key(documents: DataFrame):
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents, each as often as its copies, all their columns as they are.

    With least = 1 every row stays at least once and the targets' total grows
    so far that no domain has to shrink. Equal rows get equal copies. Null
    and empty texts have posteriors of equal parts and no tokens.
    """
    copies = Mixture(documents, **options).rated().groupBy(F.col("doc_key").alias("__key")).agg(F.max("copies").alias("__copies"))
    schema = documents.columns
    rows = documents.toDF(*(f"c{i}" for i in range(len(schema))))
    key = F.xxhash64(F.col(f"c{schema.index('doc_id')}"), F.coalesce(F.col(f"c{schema.index('text')}"), F.lit("")))
    again = rows.join(copies, key == F.col("__key")).select(*rows.columns, F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__again"))
    return again.drop("__again").toDF(*schema)
