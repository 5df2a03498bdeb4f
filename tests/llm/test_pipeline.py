"""The pipeline's stages against their operators and brute force."""

import collections

import numpy as np

import corpus_pipeline
from cinderplan.llm import packing, registry
from tests.conftest import DATA
from tests.llm.test_operators import links, rule_features


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    (_, rules), (_, perplexity), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES

    before = docs.collect()
    passed = rules(spark, docs, DATA).collect()
    ids = {r.doc_id for r in passed}
    for r in before:
        n, _, _, _, repeated = rule_features(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in ids
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in ids

    judged = perplexity(spark, spark.createDataFrame(passed, docs.schema), DATA)
    assert judged.columns == columns
    good = judged.collect()
    assert len(good) >= 0.95 * len(passed)

    single = near(spark, spark.createDataFrame(good, docs.schema), DATA)
    assert single.columns == columns
    rest = single.collect()
    roots = links([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in rest} == {root for root, _ in roots.values()}

    mixed = mix(spark, spark.createDataFrame(rest, docs.schema), DATA)
    assert mixed.columns == columns
    many = mixed.collect()
    assert max(collections.Counter(r.doc_id for r in many).values()) <= 3

    pieces = pack(spark, spark.createDataFrame(many, docs.schema), DATA).collect()
    encode = packing.Encoder(registry.tokenizer())
    assert sum(r.length for r in pieces) == sum(len(encode.one(r.text or "")) + 1 for r in many)
    assert all(r.length <= 2048 for r in pieces)
    used = collections.Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and np.mean(list(used.values())) > 0.8 * 2048


def test_run(spark):
    """What run() returns is what the stages give one after the other."""
    pieces = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    encode = packing.Encoder(registry.tokenizer(), special=True)
    want = collections.Counter((r.doc_id, len(encode.one(r.text or "")) + 1) for r in docs.collect())
    got = collections.Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert got == want and sum(r.length for r in pieces) == sum(n * k for (_, n), k in want.items())


def test_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables pass every stage."""
    text = " ".join(f"The {a} river runs slowly past the {b} hills, and nobody minds." for a in ("old", "wide", "cold", "quiet") for b in ("green", "far", "blue"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, votes string, _row string, hash string, kept int, _gone int, copies string"
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text + " Twice."), (None, None), (5, "word " * 50_000), (6, " ".join(sorted(text.split())))]
    docs = spark.createDataFrame([(i, t, "en" if i != 2 else None, None if i == 1 else "s", None, "v", "r", "h", 1, 2, "c") for i, t in rows], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        found = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            assert {(r.doc_id, r.text) for r in found} <= set(rows)
        if k == 2:
            assert sorted(r.doc_id for r in found if r.text == text) == [1]
