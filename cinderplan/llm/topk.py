"""Exact top-k search by integer inner product with a three-phase uniform threshold.

A vector's components are cut into ``LISTS`` runs; a run's inner product is a local score, and a row's score is the sum
of its local scores. Queries and rows are dealt in blocks, a list's blocks are tables of their own.

1. For each query every list gives its k best local scores, over all blocks. The sums of these rows alone are resolved;
   the k-th best is a safe cutoff: k rows reach it, so that no row below it is in the answer.
2. A row that misses cutoff / LISTS in every list has a sum below the cutoff. So each block of queries, which carries its
   cutoffs to all blocks of rows, collects from each list the entries that reach their share (ties included).
3. Only for the pairs that some list has collected are the other lists' scores computed; sums below the cutoff drop out,
   and the rest is ranked.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no part; shorter vectors
count as padded with zeros; repeated rows are candidates each, and rows with the query's own id never are; queries that
share an id are answered as one, by the least of their vectors; ties go to the smaller id; fewer than k candidates give
fewer rows. Scores must fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderplan.llm.common import stored

LISTS = 2
QUERY_BLOCK = 1024
ROW_BLOCK = 4096


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)


def integer(v: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(v, lambda x: F.floor(x * scale).cast("long"))


def dealt(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """rows(row long, ...) with a block number, and the number of blocks of about ``size`` rows."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")), n


def blocks(rows: DataFrame, name: str, width: int, lists: int) -> DataFrame:
    """rows(row, vec_id, z, name) as a row per block: name, rows, ids, and a matrix per list, in the narrowest integers that hold it."""
    schema = f"{name} int, rows binary, ids binary, kinds string, {', '.join(f'list{j} binary' for j in range(lists))}"

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        z = table.column("z").combine_chunks()
        lengths = np.asarray(pa.compute.list_value_length(z), np.int64)
        matrix = np.zeros((table.num_rows, width), np.int64)
        matrix[np.arange(width)[None, :] < lengths[:, None]] = z.flatten().to_numpy(zero_copy_only=False)
        most = int(np.abs(matrix).max(initial=0))
        kind = next(t for t, bound in (("int16", 2**15), ("int32", 2**31), ("int64", np.inf)) if 0 <= most < bound or bound == np.inf)
        own = {f"list{j}": [np.ascontiguousarray(matrix[:, s]).astype(kind).tobytes()] for j, s in enumerate(_cuts(width, lists))}
        ids = {c: [table.column(k).to_numpy().astype(np.int64).tobytes()] for c, k in (("rows", "row"), ("ids", "vec_id"))}
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), **ids, "kinds": [kind], **own})

    return rows.groupBy(name).applyInArrow(pack, schema)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers; in doubles where no partial sum can reach 2 ** 53."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _cuts(width: int, lists: int) -> list[slice]:
    at = [width * j // lists for j in range(lists + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def _open(row: dict, side: str, j: int) -> np.ndarray:
    """The matrix of list j of a block of rows (or of queries: side "q_")."""
    n = len(row[side + "ids"]) // 8
    m = np.frombuffer(row[f"{side}list{j}"], row[side + "kinds"])
    return m.reshape(n, len(m) // max(n, 1))


def _local(k: int):
    """Phase 1: for one list, a block of queries and a block of rows, each query's k best local scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids, rows = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "ids", "rows"))
                j = row["list"]
                part = _product(_open(row | {f"q_list{j}": row["q_part"]}, "q_", j), _open(row | {f"list{j}": row["part"]}, "", j))
                own = q_ids[:, None] == ids[None, :]
                part = np.where(own, np.iinfo(np.int64).min, part)
                if part.shape[1] > k:
                    best = np.argpartition(-part, k - 1, axis=1)[:, :k]
                else:
                    best = np.broadcast_to(np.arange(part.shape[1]), part.shape)
                i = np.repeat(np.arange(len(q_ids)), best.shape[1])
                at = best.ravel()
                ok = ~own[i, at]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[ok]]), pa.array(np.full(int(ok.sum()), j, np.int32)), pa.array(rows[at[ok]]), pa.array(part[i[ok], at[ok]])], names=["query_id", "list", "row", "part"])

    return run


def _collect(lists: int, resolved_only: bool = False):
    """Phases 2 and 3 for a block of queries with their cutoffs and a block of rows: the pairs whose sum reaches the cutoff.

    resolved_only: instead of them, how many pairs were collected and so resolved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids, low = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "ids", "cutoffs"))
                own = q_ids[:, None] == ids[None, :]
                known: list[tuple[np.ndarray, np.ndarray]] = []
                for j in range(lists):
                    part = _product(_open(row, "q_", j), _open(row, "", j))
                    # an integer sum of L parts reaches c only if some part reaches c / L: L * part >= c
                    at = np.flatnonzero((part * lists >= low[:, None]) & ~own)
                    known.append((at, part.ravel()[at]))
                pairs = np.unique(np.concatenate([at for at, _ in known]))
                i, c = np.divmod(pairs, max(len(ids), 1))
                if resolved_only:
                    yield pa.RecordBatch.from_arrays([pa.array([len(pairs)], pa.int64()), pa.array([own.size], pa.int64())], names=["resolved", "pairs"])
                    continue
                score = np.zeros(len(pairs), np.int64)
                for j, (at, part) in enumerate(known):
                    place = np.searchsorted(pairs, at)
                    score[place] += part
                    missing = np.ones(len(pairs), bool)
                    missing[place] = False
                    q, m = _open(row, "q_", j), _open(row, "", j)
                    for x in np.array_split(np.flatnonzero(missing), 1 + int(missing.sum()) // 100_000):
                        score[x] += np.einsum("ij,ij->i", q[i[x]].astype(np.int64), m[c[x]].astype(np.int64))
                ok = score >= low[i]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[ok]]), pa.array(ids[c[ok]]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

    return run


def _with_cutoffs(q_blocks: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """q_blocks with each query's cutoff (a very small one where there are fewer than k candidates), in the order of ids."""

    def attach(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.frombuffer(left.column("q_ids")[0].as_py(), np.int64)
        known = dict(zip(right.column("query_id").to_pylist(), right.column("cutoff").to_pylist(), strict=True))
        low = np.array([known.get(int(i), -(2**62)) for i in ids], np.int64)
        return left.append_column("cutoffs", [[low.tobytes()]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q_blocks.schema) + ", cutoffs binary"
    return q_blocks.groupBy("qb").cogroup(cutoffs.groupBy("qb")).applyInArrow(attach, schema)


def _searched(rows: DataFrame, queries: DataFrame, k: int, lists: int, query_block: int, row_block: int) -> DataFrame:
    """Pairs of query blocks, with their cutoffs, and row blocks: what phase 2 reads."""
    v = stored(rows.select("vec_id", "z").withColumn("row", F.monotonically_increasing_id()), "vectors")
    q = stored(queries.groupBy("vec_id").agg(F.min("z").alias("z")).withColumn("row", F.monotonically_increasing_id()), "asked")
    width = max(v.agg(F.coalesce(F.max(F.size("z")), F.lit(0))).first()[0], q.agg(F.coalesce(F.max(F.size("z")), F.lit(0))).first()[0])
    v, _ = dealt(v, "cb", row_block)
    q, n_q = dealt(q, "qb", query_block)
    c_blocks = stored(blocks(v, "cb", width, lists), "rows")
    names = ["ids", "kinds", *(f"list{j}" for j in range(lists))]
    q_blocks = stored(blocks(q, "qb", width, lists).select("qb", *(F.col(c).alias(f"q_{c}") for c in names)), "queries")
    every = lambda d: d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def listed(d: DataFrame, prefix: str, *rest: str) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(j).alias("list"), F.col(f"{prefix}list{j}").alias(f"{prefix}part")) for j in range(lists)))
        return d.select(*rest, f"{prefix}ids", f"{prefix}kinds", F.explode(parts).alias("_p")).select(*rest, f"{prefix}ids", f"{prefix}kinds", "_p.*")

    local = every(listed(c_blocks, "", "cb", "rows")).join(listed(q_blocks, "q_", "qb"), ["qb", "list"]).drop("cb")
    best = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "row")
    first = local.mapInArrow(_local(k), "query_id long, list int, row long, part long").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    # the sums of the k best of each list, and no others
    tried = stored(first.select("query_id", "row").distinct(), "tried")
    dot = F.aggregate(F.zip_with("z", "_z", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    summed = tried.join(v.select("row", "z"), "row").join(q.select(F.col("vec_id").alias("query_id"), F.col("z").alias("_z"), "qb"), "query_id").select("query_id", "qb", "row", dot.alias("score"))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "row")
    kth = summed.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") == k).select("query_id", "qb", F.col("score").alias("cutoff"))
    ready = stored(_with_cutoffs(q_blocks, stored(kth, "cutoffs")), "queries")
    return every(c_blocks.drop("rows")).join(ready, "qb")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k best rows for each query by inner product: query_id, rank, vec_id, score.

    rows, queries: (vec_id long, z array<long>).
    """
    found = _searched(rows, queries, k, lists, query_block, row_block).mapInArrow(_collect(lists), "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def resolved(rows: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> tuple[int, int]:
    """How many pairs of a query and a row the search resolves, of how many there are."""
    counted = _searched(rows, queries, k, lists, query_block, row_block).mapInArrow(_collect(lists, True), "resolved long, pairs long")
    return tuple(counted.agg(F.coalesce(F.sum("resolved"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first())
