"""What a Python worker of the pipeline holds, and that the results do not depend on it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from brindle.llm import mixing, queries, resident, token_ids, toxicity


def test_one_table_a_worker():
    path = queries.tokenizer_path()
    coder = token_ids.encoder(path)
    assert token_ids.encoder(path, False) is coder and list(resident._kept.values()) == [coder]
    terms = (toxicity.Term("awful", 3.0),)
    scorer = toxicity._scorer(terms)
    assert toxicity._scorer(terms) is scorer and list(resident._kept.values()) == [scorer]
    list(toxicity._contexts(None)(iter([])))
    assert not resident._kept


def test_small_word_table():
    texts = pa.array([" ".join(f"Word{i},x{j}" for i in range(200)) for j in range(40)], pa.large_string())
    small, large = (token_ids.Encoder(queries.tokenizer_path(), words=n) for n in (300, None))
    ids, many = small.encode(texts.slice(0, 20))
    more, own = small.encode(texts.slice(20))
    wanted, counts = large.encode(texts)
    assert np.concatenate((ids, more)).tolist() == wanted.tolist() and np.concatenate((many, own)).tolist() == counts.tolist()
    assert len(small.many) < len(large.many) == 8000


def test_short_texts_are_mixed_in_bounded_memory():
    n, rng = 10_000, np.random.default_rng(3)
    texts = ["", *(f"a few short words {k}" for k in rng.integers(0, 1000, n - 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts), pa.array(["en", "de"] * (n // 2))], ["doc_key", "doc_id", "text", "domain"])
    run = mixing._posteriors(np.log(rng.random((mixing.BUCKETS, 3))), queries.tokenizer_path())
    alone = [next(run(iter([batch.slice(k, 1)]))) for k in (0, 600, n - 1)]
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(run(iter([batch])))
        counted = next(mixing._domain_counts(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20  # 16 KB for each text of the batch would be 160 MB
    assert got.column("doc_id").to_pylist() == list(range(n))
    for k, row in zip((0, 600, n - 1), alone, strict=True):
        assert row.column("n_tokens")[0].as_py() == got.column("n_tokens")[k].as_py()
        assert np.allclose(row.column("posterior")[0].as_py(), got.column("posterior")[k].as_py())
    assert sum(map(sum, counted.column("counts").to_pylist())) == sum(max(0, len(t) - 2) for t in texts)
