"""The pipeline's stages take effect and keep clean documents."""

import zlib

import numpy as np


def test_pipeline(spark, sf):
    import corpus_pipeline
    from brindle.llm import decontaminate, minhash_dedup, queries, toxicity
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    left = docs.where(~docs.doc_id.isin(list(rejected)) if rejected else "true")
    doubled = {r.doc_id for r in minhash_dedup.near_duplicates(left).where("not kept").collect()}
    left = left.where(~left.doc_id.isin(list(doubled)) if doubled else "true")
    leaking = {r.doc_id for r in decontaminate.leaks(left, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {r.doc_id for r in docs.collect()} - rejected - doubled - leaking
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    crc = {r.doc_id: zlib.crc32(np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect()}
    assert all(crc[r.doc_id] == r.ids_crc32 for r in got)
