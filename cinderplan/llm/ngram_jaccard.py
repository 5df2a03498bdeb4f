"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts are word n-gram sets (words ``[^\\x20\\x09-\\x0D]+``, n = 5; a shorter text is one n-gram of all its words).
Two texts are linked if the Jaccard similarity of their sets is at least the threshold.

1. Equal word sequences are one class (partial aggregation, so a huge group of copies costs one row a task).
2. Every class gets a MinHash signature; band and row counts follow from the threshold and target recall.
3. Classes are shuffled on band hashes. In a bucket shared by several classes, pairs whose signatures agree far
   enough below the threshold to be safe are joined into candidate components. Large buckets are cut into
   cells (block against block), so that no task holds a whole hot bucket.
4. In every candidate component all pairs are verified on full n-gram sets, again cell by cell; a cell returns
   links counted and a spanning forest, never pairs.

Defined results: a null, empty or blank text has no n-grams, links to nothing and is its own class; rows with a null
doc_id are returned with class_id null and take no part in links; rows that repeat a doc_id and text count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import components, groups, pieces, release, small, stored

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Share of equal signature bytes below which a pair is no candidate: for 120 hashes, 5 standard deviations under 0.8.
SLACK_SIGMAS = 5.0
#: Classes in a block of a bucket or component.
BLOCK = 512


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``most`` hashes that finds a pair at the threshold with the wanted probability."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1) if threshold < 1 else (1, 1)
    for rows in range(2, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(count: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    found = text.split() if text else []  # bytes.split() splits at exactly the six ASCII white-space characters
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(n, len(found))
    by = _odd(width, 17 * width)
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total += _mix(h[i : len(h) - width + 1 + i] + by[i])
    return np.unique(_mix(total))


def _signer(n: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _odd(bands * rows, 1), _odd(bands * rows, 2)
        spread = _odd(rows, 3)
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                keys = np.zeros((len(texts), 2), np.uint64)
                for i, t in enumerate(texts):
                    d = xxhash.xxh3_128_intdigest(b" ".join(t.split())) if t else 0
                    keys[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
                sets = [shingles(t, n) for t in texts]
                full = np.array([len(s) > 0 for s in sets], bool)
                kept = [s for s in sets if len(s)]
                sig = np.empty((len(kept), bands * rows), np.uint64)
                if kept:
                    flat, starts = np.concatenate(kept), np.cumsum([0, *map(len, kept[:-1])])
                    x = np.empty_like(flat)
                    for j in range(bands * rows):
                        np.multiply(flat, times[j], out=x)
                        np.add(x, plus[j], out=x)
                        sig[:, j] = np.minimum.reduceat(x, starts)
                mixed = _mix(sig)
                hashed = np.zeros((len(kept), bands), np.uint64)
                for i in range(rows):
                    hashed += _mix(mixed[:, i::rows][:, :bands] + spread[i])
                hashed = _mix(hashed + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                short = (mixed >> np.uint64(56)).astype(np.uint8)
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                none = pa.array(~full)
                at = iter(short)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("hash"),
                        pa.compute.if_else(none, None, pa.array(keys[:, 0].view(np.int64))),
                        pa.compute.if_else(none, None, pa.array(keys[:, 1].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.ravel())),
                        pa.array([next(at).tobytes() if f else None for f in full], pa.binary()),
                    ],
                    schema=schema,
                )
        release()

    return sign, "doc_id long, hash long, k1 long, k2 long, bands array<long>, sig binary"


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric boolean matrix."""
    m = len(linked)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], m).min(1, initial=m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agree(sig: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of signatures have at least ``least`` equal bytes."""
    m, k = sig.shape
    equal = np.zeros((m, m), np.uint8 if k < 256 else np.uint16)
    for j in range(k):
        equal += sig[:, j, None] == sig[None, :, j]
    return equal >= least


def _candidates(hashes: int, least: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, ["bucket", "lo", "hi"]):
            cid = t.column("cid").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, hashes)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[(sig[two] == sig[two + 1]).sum(1) >= least]
            a, b = [cid[two]], [cid[two + 1]]
            for s, m in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                root = _roots(_agree(sig[s : s + m], least))
                moved = np.flatnonzero(root != np.arange(m))
                a.append(cid[s + moved])
                b.append(cid[s + root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return near


def _set_maker(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
                mask = (1 << 64) - 1
                rows = []
                for i, t in enumerate(texts):
                    d = xxhash.xxh3_128_intdigest(b" ".join(t.split())) if t else 0
                    if (k1[i] & mask, k2[i] & mask) == (d >> 64, d & mask):  # another text under the same id is not this class
                        rows.append(i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("cid", "root", "copies", "blocks")), pa.array([shingles(texts[i], n).tobytes() for i in rows], pa.binary())],
                    names=["cid", "root", "copies", "blocks", "grams"],
                )
        release()

    return sets


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; columns that one set has alone are left out, the rest is multiplied in slices."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    count = np.bincount(col)
    keep = count[col] > 1
    wide = np.cumsum(count > 1) - 1
    row, col = row[keep], wide[col[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1024, (8 << 20) // len(sets))
    width = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, width, step):
        a, b = np.searchsorted(col, [at, at + step])
        block = np.zeros((len(sets), min(step, width - at)), np.float32)
        block[row[a:b], col[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _verifier(num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, ["root", "lo", "hi"]):
            cid, block, copies = (t.column(c).to_numpy() for c in ("cid", "block", "copies"))
            grams = t.column("grams")
            lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                _, at = np.unique(cid[s:e], return_index=True)  # repeated rows of one document
                at += s
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in at]
                size = np.array([len(x) for x in sets], np.int64)
                both = _shared(sets)
                linked = both * (num + den) >= num * (size[:, None] + size[None, :])
                np.fill_diagonal(linked, False)
                if lo[s] != hi[s]:
                    linked &= block[at][:, None] != block[at][None, :]  # pairs inside a block have a cell of their own
                root = _roots(linked)
                out.append((cid[at], (linked * copies[at][None, :]).sum(1), cid[at][root]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "links", "parent"])
        release()

    return verify


def _in_cells(df: DataFrame, key: str) -> DataFrame:
    """df dealt by (key, lo, hi) cells and sorted by them within partitions."""
    d = df.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("_other"))
    d = d.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other", "blocks")
    return d.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _classified(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, hash (of the text), root (of its component of classes; null for rows without links), class_id, n_links."""
    bands, rows = bands_and_rows(threshold, recall, max_hashes)
    hashes = bands * rows
    least = max(1, math.floor(hashes * threshold - SLACK_SIGMAS * math.sqrt(hashes * threshold * (1 - threshold))))
    ratio = round(threshold * 10_000)
    num, den = ratio // math.gcd(ratio, 10_000), 10_000 // math.gcd(ratio, 10_000)
    sign, schema = _signer(n, bands, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash(docs).alias("hash"), F.col("text").cast("string").alias("text"))

    signed = stored(texts.mapInArrow(sign, schema), "signed")
    found = signed.where("k1 is not null and doc_id is not null").groupBy("k1", "k2")
    classes = stored(found.agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", F.explode("bands").alias("bucket"))
    active = members.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).alias("blocks"))
    near = members.join(active, "bucket").join(classes.select("cid", "sig"), "cid")
    edges = _in_cells(near, "bucket").select("bucket", "lo", "hi", "cid", "sig").mapInArrow(_candidates(hashes, least), "a long, b long")
    rooted = stored(components(edges), "rooted")

    blocks = rooted.groupBy("root").count().select("root", F.ceil(F.col("count") / block).alias("blocks"))
    wanted = stored(rooted.join(blocks, "root").join(classes.select(F.col("cid").alias("node"), "id", "k1", "k2", "copies"), "node"), "wanted")
    wanted = wanted.select(F.col("id").alias("doc_id"), F.col("node").alias("cid"), "root", "k1", "k2", "copies", "blocks")
    grams = texts.drop("hash").join(small(wanted), "doc_id").select("text", "cid", "root", "k1", "k2", "copies", "blocks")
    grams = grams.mapInArrow(_set_maker(n), "cid long, root long, copies long, blocks long, grams binary")
    checked = stored(_in_cells(grams, "root").select("root", "lo", "hi", "block", "cid", "copies", "grams").mapInArrow(_verifier(num, den), "cid long, links long, parent long"), "checked")

    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    final = stored(components(checked.select(F.col("cid").alias("a"), F.col("parent").alias("b"))), "final")
    least_id = classes.select(F.col("cid").alias("node"), "id").join(final, "node").groupBy("root").agg(F.min("id").alias("class_id"))
    named = final.join(least_id, "root").select(F.col("node").alias("cid"), "root", "class_id")
    known = classes.select("cid", "k1", "k2", "id", "copies").join(named, "cid", "left").join(links, "cid", "left")
    known = known.select("k1", "k2", F.coalesce("root", "cid").alias("root"), F.coalesce("class_id", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = signed.select("doc_id", "hash", *(F.when(F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")))
    return own.join(known, ["k1", "k2"], "left").select("doc_id", "hash", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def similarity_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, class_id, n_links. Options: those of ``_classified``.

    class_id: the least doc_id of the connected component of links (exact copies included); n_links: how many other
    documents are linked to this one.
    """
    return _classified(docs, **options).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that of the least doc_id, and of its texts in the class the one of least hash.

    Rows without words and rows with a null doc_id stay; of rows that repeat a doc_id and text one stays; other texts under the same
    doc_id are judged by themselves.
    """
    own = stored(_classified(docs, **options).where("root is not null").select("doc_id", "hash", "root"), "classes")
    several = own.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("_first"), F.count("*").alias("n")).where("n > 1").select("root", "_first")
    copies = stored(own.join(several, "root").groupBy("doc_id", "hash", "_first").agg(F.count("*").alias("n")), "copies")
    first = F.struct("doc_id", "hash") == F.col("_first")
    named = lambda d: d.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    met = lambda d: (docs["doc_id"].cast("long") == d["_id"]) & (_hash(docs) == d["_hash"])
    gone, again = named(copies.where(~first)), named(copies.where(first & (F.col("n") > 1)))
    if not again.limit(1).count():
        return docs.join(small(gone), met(gone), "left_anti")
    away = gone.unionAll(again)
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_a"), _hash(docs).alias("_b"))
    one = packed.join(small(again), (F.col("_a") == F.col("_id")) & (F.col("_b") == F.col("_hash"))).dropDuplicates(["_a", "_b"]).select("_row.*")
    return docs.join(small(away), met(away), "left_anti").unionByName(one)
