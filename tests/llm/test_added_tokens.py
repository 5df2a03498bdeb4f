"""Packing's ids of texts that hold the vocabulary's added tokens, against the library at its defaults."""

import zlib

import numpy as np

import corpus_pipeline
from cinderplan.llm import registry

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "so  <|endoftext|>\n it  goes", "<|endoftext|", "a  b <|endoftext|> c d e", "plain words here", "\u00e9<|endoftext|>\u4e2d", "", None]


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer())
    assert t.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for k, x in enumerate(TEXTS)}
    got = registry.op9_packing(spark, str(tmp_path)).collect()
    # none of these is cut: a sequence of 2048 tokens holds all
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got} == {k: (len(x) // 4, zlib.crc32(x)) for k, x in want.items()}
    whole = {}
    for r in corpus_pipeline.packing_stage(spark, d, str(tmp_path)).collect():
        whole.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in whole.items()} == want
