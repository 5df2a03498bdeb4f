"""What the quality classifier's word model holds outside the JVM's heap: Python workers' arrays, Arrow batches, Parquet pages."""

import random
import tracemalloc
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from cinderplan.llm import quality_lm

SHARDS = 30


def block(size):
    """Documents of about ``size`` characters in all, as the operator hands them to workers."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=320)) for _ in range(size // 1950)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["en"] * len(texts)), ids, pa.array(texts)], names=["doc_id", "lang", "hash", "text"])
    return [batch.slice(k, 500) for k in range(0, batch.num_rows, 500)]


def peak(f):
    """f's result, and the most MB that it held at once."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_block_takes_little_of_a_workers_memory():
    batches = block(quality_lm.BLOCK_BYTES)
    counted, counting = peak(lambda: list(quality_lm._counter(SHARDS)(iter(batches))))
    rows = pa.Table.from_batches(list(quality_lm._asker(SHARDS)(iter(batches))))
    rows = rows.filter(pc.equal(rows.column("block"), rows.column("block")[0]))
    own, asked = (rows.filter(x) for x in (pc.less(rows.column("part"), 0), pc.greater_equal(rows.column("part"), 0)))
    known = pa.table({"kind": pa.array([], pa.string()), "blob": pa.array([], pa.binary())})
    answers = quality_lm._answerer([(0.5, 0.75, 0.9)] * 3)((), known, asked)
    judge = quality_lm._judge(SHARDS, SimpleNamespace(value=bytes([40]) * 64**4), 1000.0, 0.5)
    scored, judging = peak(lambda: judge((pa.scalar(0),), own, answers))
    assert len(counted) >= SHARDS and scored.num_rows > 2000 and np.isfinite(scored.column("nll").to_numpy()).all()
    assert counting < 110 and judging < 120, (counting, judging)


def test_blobs_go_to_spark_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(quality_lm, "BATCH_BYTES", 20_000, raising=False)
    counted = pa.Table.from_batches(list(quality_lm._counter(SHARDS)(iter(block(200_000)))))
    out = quality_lm._trigrams(SHARDS)((pa.scalar(0, pa.int32()),), counted)
    sizes = [[len(x.as_py()) for x in b.column("blob")] for b in out.to_batches()]
    assert len(sizes) > 5 and all(sum(x[:-1]) < 20_000 for x in sizes)
    assert sum(map(len, sizes)) == out.num_rows == 2 + len({x.as_py() for x in out.filter(pc.equal(out.column("kind"), "end")).column("part")})
    assert quality_lm._rows([]).num_rows == 0


def test_blobs_are_not_compressed_again(spark):
    d = spark.createDataFrame([(t,) for t in block(20_000)[0].column("text").to_pylist()], "text string")
    path = Path(urlparse(quality_lm.WordModel(d, 2).path).path)
    files = [pq.ParquetFile(x).metadata for x in path.glob("*.parquet")]
    kinds = {m.row_group(g).column(c).compression for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)}
    assert kinds == {"UNCOMPRESSED"}
