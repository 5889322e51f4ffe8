"""Token ids of whole texts, written as a table that later stages read.

The tokenizer drops white space, so a text's ids are the ids of its words.
It also ignores case and splits a word from a full stop or comma. Words are
found and hashed by numpy over slices of many texts; a worker keeps a bounded
open-addressing table from a word's 64-bit hash to its ids, and the ids of a
slice are gathered in one step. Words not seen before are encoded many at a
time, apart by a NUL that no other part can produce. Texts that may hold a
special token's string go to the tokenizer whole, and so does every text if
the tokenizer is otherwise. Two words of one worker's table with the same
hash would share ids: at CACHE_WORDS words the chance is below 1 to 10 million.
A full table takes some 250 MB of a worker, by reckoning, whatever it reads;
a caller whose workers have less room gives a smaller number of words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .resident import kept
from .words import filled, scan, slices

CACHE_WORDS = 1_200_000
BASE_WORDS = 800_000  # kept to know words again that differ in case or final punctuation
SLOT_BITS = 16  # at first; the table grows so that half of it is free
RUN_WORDS = 1 << 17  # looked up at once
JOINED, TOGETHER = 512, 32  # words encoded as one text, such texts encoded at once
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which may begin a contraction


@functools.cache
def load(path: str, special_as_text: bool):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


def splits_as_assumed(tokenizer) -> bool:
    """Whether white space leaves no trace, case none either, and final stops and NUL stand alone."""

    def ids(x: str) -> list[int]:
        return tokenizer.encode(x, add_special_tokens=False).ids

    parts = ["xy", "Thé", "1a", "it's", "(b)"]
    spaced = [i for x in parts for i in ids(x)]
    same = all(ids(sep.join(parts)) == spaced for sep in (" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n  "))
    tails = all(ids(x + y) == ids(x) + ids(y) for x in ("xy", "Thé", "1a") for y in (*TAIL, ".,", "%%%", TAIL))
    return same and tails and ids("XyÉZ") == ids("xyéz") and len(ids("\0")) == 1 and ids("a \0 b") == ids("a") + ids("\0") + ids("b")


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False, words: int | None = None):
        self.most_words, self.most_bases = (CACHE_WORDS, BASE_WORDS) if words is None else (words, 2 * words // 3)
        self.tokenizer = load(path, special_as_text)
        self.by_word = splits_as_assumed(self.tokenizer)
        self.marks = [] if special_as_text else sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self.by_word:
            self.nul = self.tokenizer.encode("\0", add_special_tokens=False).ids[0]
            self.tails: dict[str, bytes] = {"": b""}
            self.forget()

    def forget(self) -> None:
        self.bases: dict[str, bytes] = {}
        self.room(SLOT_BITS)
        self.begin, self.many, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def room(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.zeros(1 << bits, np.uint64)  # a word's hash, 0 where free
        self.word = np.zeros(1 << bits, np.int32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words without white space or NUL."""
        out: list[bytes] = []
        joined = [" \0 ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        made = (e.ids for k in range(0, len(joined), TOGETHER) for e in self.tokenizer.encode_batch_fast(joined[k : k + TOGETHER], add_special_tokens=False))
        for own, n in zip(made, range(0, len(words), JOINED), strict=True):
            ids = np.array(own, self.dtype)
            raw, ends = ids.tobytes(), np.flatnonzero(ids == self.nul) * self.dtype.itemsize
            starts = [0, *(ends + self.dtype.itemsize).tolist()]
            out.extend(raw[a:b] for a, b in zip(starts, [*ends.tolist(), len(raw)], strict=True))
            if len(out) != min(n + JOINED, len(words)):
                raise ValueError("a word holds what separates words")
        return out

    def tail(self, punctuation: str) -> bytes:
        if punctuation not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[punctuation] = self.whole([punctuation])[0]
        return self.tails[punctuation]

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of each of some new words, whatever characters they hold."""
        if len(self.bases) > self.most_bases:
            self.bases = {}
        out, todo, odd = [b""] * len(parts), [], []
        for k, part in enumerate(parts):
            base = part.rstrip(TAIL)
            if not base or not base[-1].isalnum() or base[-1] > "\u024f" or len(base[-1].lower()) > 1:
                base = part
            stop = self.tail(part[len(base) :])
            if base and max(base) < "\u0250":  # beyond, lower case may depend on the neighbours
                base = base.lower()
            if (known := self.bases.get(base)) is not None:
                out[k] = known + stop
            elif "\0" in base or not base or any(c.isspace() for c in (base if not base.isalnum() else "")):
                odd.append(k)
            else:
                todo.append((k, base, stop))
        for k, ids in zip(odd, self.whole([parts[k] for k in odd]) if odd else [], strict=True):
            out[k] = ids
        new = list({base for _, base, _ in todo})
        self.bases.update(zip(new, self.words(new), strict=True))
        for k, base, stop in todo:
            out[k] = self.bases[base] + stop
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the table, -1 where it is not there."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.slots[at]
        out = np.where(there == hashes, self.word[at], -1)
        rest = np.flatnonzero((there != hashes) & (there != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.slots[at[rest]]
            hit = rest[there == hashes[rest]]
            out[hit] = self.word[at[hit]]
            rest = rest[(there != hashes[rest]) & (there != 0)]
        return out

    def put(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Adds distinct new words to the table."""
        many = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        number = np.arange(len(self.many), len(self.many) + len(ids), dtype=np.int32)
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(many) - many))
        self.many = np.concatenate((self.many, many))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), self.dtype)))
        if 2 * len(self.many) > len(self.slots):
            used = self.slots != 0
            before, words = self.slots[used], self.word[used]
            self.room((2 * len(self.many) - 1).bit_length())
            self.place(before, words)
        self.place(hashes, number)

    def place(self, hashes: np.ndarray, number: np.ndarray) -> None:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.slots[at] == 0
            self.slots[at[free]] = hashes[free]
            mine = self.slots[at] == hashes
            self.word[at[mine]] = number[mine]
            hashes, number, at = hashes[~mine], number[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def run(self, hashes: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of at most RUN_WORDS words; spelled(i) is the i-th."""
        at = self.find(hashes)
        if (at < 0).any():
            if len(self.many) > self.most_words:
                self.forget()
                at = self.find(hashes)
            missing = np.flatnonzero(at < 0)
            new, first = np.unique(hashes[missing], return_index=True)
            self.put(new, self.learn([spelled(i) for i in missing[first].tolist()]))
            at[missing] = self.find(hashes[missing])
        many = self.many[at]
        ends = np.cumsum(many)
        return self.flat[np.repeat(self.begin[at] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)], many

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); texts is an array of large strings without nulls."""
        ids: list[np.ndarray] = [np.zeros(0, self.dtype)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        for lo, hi, data, offsets in slices(texts):
            if not self.by_word:
                made = [np.frombuffer(x, self.dtype) for x in self.whole(texts.slice(lo, hi - lo).to_pylist())]
                ids += made
                counts.append(np.array([len(x) for x in made], np.int64))
                continue
            words = scan(data, offsets)
            hashes = words.hashes | np.uint64(1)

            def spelled(i: int, data=data, words=words) -> str:
                return data[words.starts[i] : words.ends[i]].tobytes().decode()

            runs = [self.run(hashes[k : k + RUN_WORDS], lambda i, k=k: spelled(k + i)) for k in range(0, len(hashes), RUN_WORDS)]
            own = np.concatenate([ids[0], *(x for x, _ in runs)])
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([counts[0], *(m for _, m in runs)]))))[words.first]
            many = np.diff(bounds)
            some = texts.slice(lo, hi - lo)
            marked = functools.reduce(pc.or_, (pc.match_substring(some, m) for m in self.marks)) if self.marks else pa.nulls(0)
            at = 0
            for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                whole = np.frombuffer(self.whole([some[k].as_py()])[0], self.dtype)
                ids += [own[at : bounds[k]], whole]
                at, many[k] = bounds[k + 1], len(whole)
            ids.append(own[at:])
            counts.append(many)
        return np.concatenate(ids), np.concatenate(counts)


def encoder(path: str, special_as_text: bool = False, words: int | None = None) -> Encoder:
    """The worker's only encoder, whichever operator asks for it; its cache serves task after task."""
    return kept(("encoder", path, special_as_text, words), lambda: Encoder(path, special_as_text, words))


COUNTS = "counts"
IDS = "ids"
SCHEMA = "kind string, doc_id long, n_tokens long, ids binary"


def tokenised(path: str, end_id: int | None, special_as_text: bool = False, counts: bool = False, words: int | None = None):
    """For mapInArrow over (doc_id, text): rows of ids, the end id included; with counts, one row of id frequencies for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, special_as_text, words)
        seen = np.zeros(coder.tokenizer.get_vocab_size() if counts else 0, np.int64)
        for batch in batches:
            texts = filled(batch.column("text"))
            for lo, hi, _, _ in slices(texts):
                ids, many = coder.encode(texts.slice(lo, hi - lo))
                if end_id is not None:
                    ids, many = np.insert(ids, np.cumsum(many), end_id), many + 1
                if counts:
                    seen += np.bincount(ids, minlength=len(seen))
                ends = np.concatenate(([0], np.cumsum(many))) * coder.dtype.itemsize
                if ends[-1] >= 1 << 31:
                    raise ValueError("a text has 2 GB of ids or more")
                raw = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array([IDS] * len(many)), batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(many, pa.int64()), raw], ["kind", "doc_id", "n_tokens", "ids"])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([COUNTS]), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([seen.tobytes()], pa.binary())], ["kind", "doc_id", "n_tokens", "ids"])

    return run


def dtype_of(path: str) -> np.dtype:
    return encoder(path).dtype


def in_order(ids: DataFrame, parts: int) -> DataFrame:
    """Range partitions in ascending doc_id order; ties are ordered by their ids."""
    return ids.select("doc_id", "n_tokens", "ids").repartitionByRange(parts, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")
