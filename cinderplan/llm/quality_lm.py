"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text's words; perplexity against quantiles.

The model is of word trigrams, all of them, so that it grows with the corpus. Words it has not seen are spelled: the empty context's
rest goes to a model of order 4 over ``SYMBOLS`` character classes (``symbol_table``: basic Latin letters one by one, other characters
by kind), which is bounded: at most 64 ** 4 n-grams, 16 MB of log-probabilities (a byte each, in twelfths of a nat).

1. All trusted text is counted, in two folds by hash of doc_id. Blocks of text give their distinct word trigrams with counts, dealt
   by their first two words into shards; there they are summed. A shard so knows its contexts' totals too, and hands on what ends in
   each bigram, for the continuation counts of the lower orders. Character counts are dealt by their leading symbols into ``SYMBOLS``
   shards; such a shard becomes a dense block of log-probabilities, which is broadcast.
2. One fold's models judge the other fold's documents, then the next fold's are made. Documents go in ``WAVES``, so that what is
   underway at a time is a part of the corpus. A wave's documents are
   packed into blocks; a block's distinct n-grams of all orders are joined with the counts in the shards of the fold that its
   documents are not in, so that no document is judged by a model that has seen it, and the answers with the block. Perplexity is
   the mean over the document's characters; white space is always spelled.
3. Thresholds: a high quantile, per language, of the trusted documents' perplexities. A language with fewer than ``LEAST`` trusted
   documents, whose quantile says little, takes at least its median, or that of all if higher, plus the spread that trusted documents
   have about their languages' medians.

N-grams are 64-bit hashes; within a shard, 32 further bits tell them apart. Shards grow in number with the corpus, so that one of a
shard's n-grams is taken for a document's other n-gram once in some thousand questions about unseen ones, at every size.

Defined results: null or empty text has no perplexity (null) and is not kept; a language without trusted documents (null
included) takes the threshold of all; without any trusted document everything with text is kept; repeated rows are
judged alike; null ids are never trusted, but judged; a text is a unit of memory, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import cleaning, discard, new_folder, pieces, release, small, stored, written

SYMBOLS, ORDER, FOLDS = 64, 4, 2
STEPS = 12.0
QUANTILE = 0.995
#: Trusted documents with text below which a language's own quantile is not relied on alone.
LEAST = 30
#: Characters of typical text that a document's mean is drawn towards, so that a few words aren't judged on noise.
PSEUDO = 100
TEXT_BYTES = 4 << 20
#: Bytes of text in a block of documents, and in what is split into words at once, apart from a single longer text.
BLOCK_BYTES, PIECE_BYTES = 6 << 20, 1 << 18
#: Bytes of blobs that go to Spark in a batch, a blob at least.
BATCH_BYTES = 1 << 20
#: Characters of a fold's trusted text (or an eighth of the characters of all documents) for each of its shards.
SHARD_CHARS = 4 << 20
#: Parts in which documents are judged, one after the other; a multiple of FOLDS.
WAVES = 8
#: Counts and shares travel as logarithms: this many steps a nat, from -8 on, in 16 bits.
LOG_STEPS, LOG_LEAST = 1024.0, -8.0


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x3000. 0 bounds documents and never stands for a character."""
    out = np.full(0x3000, 63, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        low = c.lower()
        if c.isalpha():
            upper = c != low
            if cp < 128:
                out[cp] = 27 + (ord(low) - 97) % 4 if upper else 1 + cp - 97
            elif cp < 0x250:
                out[cp] = 31 if upper else 32 + cp % 16
            else:
                out[cp] = 48 + cp % 6
        elif c.isdigit():
            out[cp] = 54
        elif c == " ":
            out[cp] = 55
        elif c in "\n\r":
            out[cp] = 56
        elif c.isspace():
            out[cp] = 57
        elif c in ".?":
            out[cp] = 58
        elif c in ",;:":
            out[cp] = 59
        elif c in "'\"-()":
            out[cp] = 60
        elif c == "!":
            out[cp] = 61
        elif c in "#*$%&|<>":
            out[cp] = 62
    return out


def codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all characters of the texts, each text begun by order - 1 bounds; and the texts' lengths."""
    gap = "\0" * (ORDER - 1)
    cp = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    sym = table[np.minimum(cp, len(table) - 1)].astype(np.int32)
    far = cp >= len(table)
    if far.any():
        sym[far] = 48 + (cp[far] >> 7) % 6
    start = np.cumsum(lengths + ORDER - 1) - lengths
    bound = np.zeros(len(sym), bool)
    for k in range(1, ORDER):
        bound[start - k] = True
    sym[bound] = 0
    code = np.zeros(len(sym) - ORDER + 1, np.int32)
    for k in range(ORDER):
        code = code * SYMBOLS + sym[k : len(sym) - ORDER + 1 + k]
    return code[~bound[ORDER - 1 :]], lengths


def _char_counter():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        total = [(np.empty(0, np.int32), np.empty(0, np.int64))] * FOLDS
        for whole in batches:
            for batch in pieces(whole, "text", TEXT_BYTES):
                texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
                for fold in range(FOLDS):
                    if own := [t for t, f in zip(texts, folds, strict=True) if t and f == fold]:
                        found, n = np.unique(codes(own, table)[0], return_counts=True)
                        both, at = np.unique(np.concatenate([total[fold][0], found]), return_inverse=True)
                        total[fold] = both, np.bincount(at, np.concatenate([total[fold][1], n])).astype(np.int64)
        for fold in range(FOLDS):
            found, n = total[fold]
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fold, np.int32)), pa.array(part), pa.array(n[at : at + 100_000])], names=["fold", "code", "n"])

    return count


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled as of good quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def counts(trusted: DataFrame) -> DataFrame:
    """(fold, code, n): how often each n-gram of symbols occurs in trusted(doc_id, text)."""
    d = trusted.select(F.col("text").cast("string").alias("text"), fold().alias("fold")).where("text <> ''")
    return d.mapInArrow(_char_counter(), "fold int, code long, n long").groupBy("fold", "code").agg(F.sum("n").alias("n"))


def discounts(seen: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts (of 1 to 4)."""
    n1, n2, n3, n4 = (float(seen.get(k, 0)) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def counted(n: np.ndarray) -> dict[int, int]:
    return {k: int((n == k).sum()) for k in (1, 2, 3, 4)}


def smoothed(code: np.ndarray, n: np.ndarray, lower: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Dense probabilities [contexts, symbols] of one order for contexts 0.. in ``lower``'s rows, interpolated with lower.

    code: dense index context * SYMBOLS + symbol; lower: the lower order's probability of each such index.
    """
    count = np.zeros(lower.size)
    count[code] = n
    count = count.reshape(-1, SYMBOLS)
    total = count.sum(1, keepdims=True)
    kept = np.maximum(count - np.where(count == 0, 0, np.where(count == 1, d[0], np.where(count == 2, d[1], d[2]))), 0)
    left = total - kept.sum(1, keepdims=True)
    lower = lower.reshape(-1, SYMBOLS)
    return np.where(total > 0, (kept + left * lower) / np.maximum(total, 1), lower)


def lower_orders(c: DataFrame) -> np.ndarray:
    """Probabilities of order ORDER - 1, dense; from tables of at most 64 ** 3 continuation counts."""
    tables = []
    for k in range(ORDER - 1, 0, -1):  # the n-grams of order k + 1 that end in each n-gram of order k
        c = c.select(F.pmod("code", F.lit(SYMBOLS**k)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
        got = c.toArrow()
        tables.append((k, got.column("code").to_numpy(), got.column("n").to_numpy()))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k, code, n in reversed(tables):
        flat = p if k == 1 else np.tile(p, SYMBOLS)  # the context's first symbol changes nothing below
        p = smoothed(code, n, flat, discounts(counted(n))).ravel()
    return p


def packed(p: np.ndarray) -> bytes:
    """Probabilities as bytes: twelfths of a nat below 1, at most 255."""
    return np.clip(np.rint(-STEPS * np.log(p)), 0, 255).astype(np.uint8).tobytes()


def model(c: DataFrame) -> list[bytes]:
    """The shards of one fold's counts (code, n), by leading symbol: log-probabilities [64 ** 3] (``packed``) of each n-gram that begins with it."""
    p = lower_orders(c)
    seen = c.select(F.least("n", F.lit(5)).alias("n")).groupBy("n").count().collect()  # five rows
    d = discounts({r["n"]: r["count"] for r in seen})
    width = SYMBOLS ** (ORDER - 1)

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy() % width
        # within a shard the context is the leading symbol and two more; the lower order knows the latter and the symbol
        dense = smoothed(code, table.column("n").to_numpy(), p, d)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "logs": pa.array([packed(dense)], pa.binary())})

    rows = c.withColumn("shard", F.floor(F.col("code") / width).cast("int")).groupBy("shard").applyInArrow(shard, "shard int, logs binary").collect()  # 16 MB at most
    unseen = packed(p)
    got = {r["shard"]: bytes(r["logs"]) for r in rows}
    return [got.get(k, unseen) for k in range(SYMBOLS)]


def spread(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hashes of uint64 values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)  # 0 must not stay 0: it is the bound's key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs of keys."""
    return spread(a * np.uint64(0xD1342543DE82EF95) + spread(b))


#: The key of what stands before a text, and of a pair of those.
BOUND = np.zeros(1, np.uint64)
BOUNDS = pair(BOUND, BOUND)


@functools.cache
def _char_hashes() -> np.ndarray:
    return spread(np.arange(1 << 16, dtype=np.uint64))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x5851F42D4C957F2D
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts: where it begins and ends in the joined text, its text's number, and its key (uint64).

    Words are runs without ASCII white space; ideographs and what lies beyond begin words of their own. A key is a polynomial of the
    word's characters, from running sums.
    """
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    word = ~((cp == 32) | (cp - np.uint32(9) <= 4))
    begins = np.zeros(len(cp) + 1, bool)
    begins[0] = begins[first] = True
    begins = begins[:-1] | (cp >= 0x2E80)
    begins[1:] |= ~word[:-1]
    inside = np.flatnonzero(word)
    starts = np.flatnonzero(begins[inside])
    begin = inside[starts]
    end = begin + np.diff(starts, append=len(inside))
    size = 1 << max(19, int(len(cp)).bit_length())
    power, back = _powers(size) if size <= 1 << 19 else _powers.__wrapped__(size)  # workers keep the usual size only
    values = _char_hashes()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    values[far] = spread(cp[far].astype(np.uint64))
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(values * power[: len(cp)], out=sums[1:])
    key = spread((sums[end] - sums[begin]) * back[begin])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, np.append(first, len(cp)))))
    return begin, end, doc, key


def after(key: np.ndarray, fresh: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The key of what precedes each word, and bound before a text's first (fresh)."""
    out = np.empty_like(key)
    out[1:] = key[:-1]
    out[fresh] = bound
    return out


def place(key: np.ndarray, n: int) -> np.ndarray:
    """Where keys lie among n shards: the shard in the upper 32 bits, 32 further bits below; ascending with the key."""
    return (key >> np.uint64(32)) * np.uint64(n) + ((key & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32))


def low(at: np.ndarray) -> np.ndarray:
    """What tells n-grams of one shard apart."""
    return (at & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def trigram_place(at: np.ndarray, uv: np.ndarray, vw: np.ndarray) -> np.ndarray:
    """Trigrams lie in the shard of their first two words, whose place is ``at``."""
    return at & ~np.uint64(0xFFFFFFFF) | pair(uv, vw) & np.uint64(0xFFFFFFFF)


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def opened(blob: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(low: np.ndarray) -> bytes:
    """Ascending uint32 values as their differences."""
    return squeezed(np.diff(low, prepend=np.uint32(0)))


def ungapped(blob: bytes) -> np.ndarray:
    return np.cumsum(opened(blob, "u4"), dtype=np.uint32)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each distinct one begins."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def added(column: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(column[order], first) if len(first) else column[:0]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and each key's number among them."""
    order, first = grouped(keys)
    number = np.zeros(len(keys), np.int32)
    number[first] = 1
    number = np.cumsum(number, dtype=np.int32) - 1
    out = np.empty(len(keys), np.int32)
    out[order] = number
    return keys[order[first]], out


def by_shard(at: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The shards of ascending places, each with its slice."""
    cut = np.searchsorted(at >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]


def with_words(known: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    """Columns of numbers in known, as a list of those of known that occur and columns of numbers in it."""
    used = np.zeros(len(known), bool)
    for x in columns:
        used[x] = True
    number = (np.cumsum(used) - 1).astype(np.uint32)
    return [squeezed(known[used]), *(squeezed(number[x]) for x in columns)]


def words_of(blobs: list[bytes]) -> list[np.ndarray]:
    known = opened(blobs[0], "u8")
    return [known[opened(x, "u4")] for x in blobs[1:]]


def bundle(blobs: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in blobs)


def unbundle(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of the batches in tables of about ``most`` bytes of text, a row at least."""
    held, size = [], 0
    for whole in batches:
        for batch in pieces(whole, "text", PIECE_BYTES):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _split(table: pa.Table) -> Iterator[tuple[list[str], tuple[np.ndarray, ...]]]:
    """A table's texts piece by piece, each with its words (``word_keys``)."""
    for batch in table.to_batches():
        for part in pieces(batch, "text", PIECE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield texts, word_keys(texts)


GRAMS = "kind string, part int, blob binary, n1 long, n2 long, n3 long, n4 long"


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of a table's texts, and which begin a text."""
    keys, fresh = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for _, (_, _, doc, key) in _split(table):
        keys.append(key)
        fresh.append(np.diff(doc, prepend=-1) > 0)
    return np.concatenate(keys), np.concatenate(fresh)


def _counter(n: int):
    """Blocks of one fold's trusted text to (part, blob) with their distinct trigrams and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, BLOCK_BYTES):
            key, fresh = _words(table)
            if not len(key):
                continue
            known, w = ranked(key)
            del key, table
            known, w = np.concatenate([BOUND, known]), w.astype(np.uint64) + np.uint64(1)  # number 0 is the bound's
            v = after(w, fresh, np.uint64(0))
            u = after(v, fresh, np.uint64(0))
            m = len(known)
            if m**3 < 1 << 64:
                m = np.uint64(m)
                for x in (v, w):
                    u *= m
                    u += x
                grams = u
                del u, v, w, x
                grams.sort()
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                times = np.diff(first, append=len(grams)).astype(np.uint32)
                both, w = np.divmod(grams[first], m)
                del grams, first
                u, v = np.divmod(both, m)
                del both
            else:  # a very long text with very many different words
                order = np.lexsort((w, v, u))
                u, v, w = u[order], v[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
                times = np.diff(first, append=len(u)).astype(np.uint32)
                u, v, w = u[first], v[first], w[first]
            u, v, w = (x.astype(np.int64) for x in (u, v, w))
            part = (place(pair(known[u], known[v]), n) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(n + 1))
            for k in range(n):
                if len(x := order[cut[k] : cut[k + 1]]):
                    blob = bundle([*with_words(known, u[x], v[x], w[x]), squeezed(times[x])])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])
        release()

    return count


def _row(kind: str, part: int, blobs: list[bytes], n: np.ndarray | None = None) -> tuple:
    return kind, part, bundle(blobs), *((int((n == k).sum()) for k in (1, 2, 3, 4)) if n is not None else [0] * 4)


def _by_bytes(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that hold a blob, in batches of about ``BATCH_BYTES``, a row at least: Spark holds each batch whole outside its heap."""
    held, size = [], 0
    for k, row in enumerate(rows):
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH_BYTES or k == len(rows) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], t) for j, t in enumerate(schema.types)], schema=schema)
            held, size = [], 0


ROWS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("blob", pa.binary()), *((f"n{k}", pa.int64()) for k in (1, 2, 3, 4))])
BLOBS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    release()
    return pa.Table.from_batches(_by_bytes(rows, ROWS), ROWS)


def _as_context(n: np.ndarray) -> list[np.ndarray]:
    """What a context sums up over its continuations: their counts, and how many occur once, twice and more often."""
    return [n.astype(np.int64), *(x.astype(np.int64) for x in (n == 1, n == 2, n >= 3))]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The parts' columns, each in one; empties the list, so that no more than a column is held twice."""
    columns = [list(x) for x in zip(*parts, strict=True)]
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _trigrams(n: int):
    """A shard's partial counts to its trigrams ("3"), its contexts ("2c"), and what ends in bigrams, by their shards ("end")."""

    def shard(key: tuple, own: pa.Table) -> pa.Table:
        parts = []
        for x in own.column("blob"):
            *w, times = unbundle(x.as_py())
            parts.append((*words_of(w), opened(times, "u4")))
        u, v, w, times = _joined(parts)
        uv, vw = pair(u, v), pair(v, w)
        del u
        at = place(uv, n)
        grams = trigram_place(at, uv, vw)
        del uv
        order, first = grouped(grams)
        one = order[first]  # a row of each trigram
        total, grams = added(times.astype(np.int64), order, first), low(grams[one])
        del times, order
        rows = [_row("3", key[0].as_py(), [gaps(grams), squeezed(total)], total)]
        del grams
        at = at[one]
        vw = place(vw[one], n)
        v = v[one]
        w = w[one]
        order, first = grouped(at)
        rows.append(_row("2c", key[0].as_py(), [gaps(low(at[order[first]])), *(squeezed(added(x, order, first)) for x in _as_context(total))]))
        order, first = grouped(vw)
        one = order[first]
        ends, firsts = vw[one], np.diff(first, append=len(order))
        known, number = ranked(np.concatenate([v[one], w[one]]))
        v, w = np.split(number, 2)
        for k, s in by_shard(ends, n):
            rows.append(_row("end", k, [*with_words(known, v[s], w[s]), squeezed(firsts[s])]))
        return _rows(rows)

    return shard


def _bigrams(n: int):
    """What ends in a shard's bigrams to their continuation counts ("2"), and by word the contexts and ends of those ("word")."""

    def shard(key: tuple, own: pa.Table) -> pa.Table:
        parts = []
        for x in own.column("blob"):
            *w, firsts = unbundle(x.as_py())
            parts.append((*words_of(w), opened(firsts, "i8")))
        v, w, firsts = _joined(parts)
        vw = place(pair(v, w), n)
        order, first = grouped(vw)
        one, total = order[first], added(firsts, order, first)
        rows = [_row("2", key[0].as_py(), [gaps(low(vw[one])), squeezed(total)], total)]
        zero = np.zeros(len(one), np.int64)
        words = np.concatenate([place(w[one], n), place(v[one], n)])
        order, first = grouped(words)
        words = words[order[first]]
        sums = [added(x, order, first) for x in (np.concatenate([zero + 1, zero]), *(np.concatenate([zero, x]) for x in _as_context(total)))]
        for k, s in by_shard(words, n):
            rows.append(_row("word", k, [squeezed(words[s]), *(squeezed(x[s]) for x in sums)]))
        return _rows(rows)

    return shard


def _unigrams(key: tuple, own: pa.Table) -> pa.Table:
    """A shard's words: of how many bigrams they are the end, and what they are as contexts ("1")."""
    parts = [[opened(x, t) for x, t in zip(unbundle(b.as_py()), ("u8", *["i8"] * 5), strict=True)] for b in own.column("blob")]
    words, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, first = grouped(words)
    sums = [added(x, order, first) for x in columns]
    return _rows([_row("1", key[0].as_py(), [gaps(low(words[order[first]])), *map(squeezed, sums)], sums[0])])


class WordModel:
    """One fold's counts: a stored table of blobs by shard, the orders' discounts, and the empty context's total and rest."""

    def __init__(self, trusted: DataFrame, shards: int):
        """trusted: (text) of the fold, without nulls and empty texts."""
        spark, self.shards = trusted.sparkSession, shards
        dealt = trusted.mapInArrow(_counter(shards), "part int, blob binary")
        three, first = written(dealt.groupBy("part").applyInArrow(_trigrams(shards), GRAMS), "trigrams", blobs=True)
        two, second = written(three.where("kind = 'end'").groupBy("part").applyInArrow(_bigrams(shards), GRAMS), "bigrams", blobs=True)
        one = two.where("kind = 'word'").groupBy("part").applyInArrow(_unigrams, GRAMS)
        # one table of the four kinds that questions are put to; what was handed on goes
        self.table, self.path = written(three.where("kind in ('3', '2c')").unionAll(two.where("kind = '2'")).unionAll(one).repartition(max(1, shards // 8)), "words", blobs=True)
        discard(spark, first)
        discard(spark, second)
        of = {r["kind"]: r for r in self.table.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4"))).collect()}  # four rows
        self.cuts = [discounts({k: of[o][f"n{k}"] for k in (1, 2, 3, 4)} if o in of else {}) for o in "123"]

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = np.concatenate([np.empty(0, np.int64), *(opened(unbundle(x.as_py())[1], "i8") for x in batch.column("blob"))])
                yield pa.RecordBatch.from_arrays([pa.array([int(x.sum())], pa.int64()) for x in _as_context(n)], names=["n", "a", "b", "c"])

        sums = self.table.where("kind = '1'").select("blob").mapInArrow(total, "n long, a long, b long, c long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "nabc")).first()
        self.total = max(1, sums[0])
        self.rest = sum(d * x for d, x in zip(self.cuts[0], sums[1:], strict=True)) / self.total if sums[0] else 1.0


def as_logs(x: np.ndarray) -> np.ndarray:
    """uint16 logarithms of positive values; 0 stands for what is absent."""
    return np.clip(np.rint((np.log(x) - LOG_LEAST) * LOG_STEPS) + 1, 1, 65535).astype(np.uint16)


def from_logs(x: np.ndarray, absent: float) -> np.ndarray:
    return np.where(x == 0, absent, np.exp((x.astype(np.float64) - 1) / LOG_STEPS + LOG_LEAST))


def known_values(own: pa.Table, cuts: list[tuple[float, float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A shard's keys and answers (as_logs) for orders 3, 2 and 1.

    An answer is the discounted count and, below order 3, the total and the rest of the n-gram as a context.
    """
    got: dict[str, list[np.ndarray]] = {}
    for kind, blob in zip(own.column("kind").to_pylist(), own.column("blob"), strict=True):
        low, *values = unbundle(blob.as_py())
        got[kind] = [ungapped(low), *(opened(x, "i8") for x in values)]

    def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.where(n > 0, as_logs(np.maximum(n - np.array([0, *d])[np.minimum(n, 3)], 1e-3)), 0).astype(np.uint16)

    def context(n: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: tuple[float, float, float]) -> list[np.ndarray]:
        some = n > 0
        rest = (a * d[0] + b * d[1] + c * d[2]) / np.maximum(n, 1)
        return [np.where(some, as_logs(x), 0).astype(np.uint16) for x in (np.maximum(n, 1), np.where(some, rest, 1))]

    none = [np.empty(0, np.uint32), *[np.empty(0, np.int64)] * 5]
    three, ends, two, one = (got.get(k, none[:m]) for k, m in (("3", 2), ("2c", 5), ("2", 2), ("1", 6)))
    keys = np.union1d(ends[0], two[0])
    table = np.zeros((3, len(keys)), np.uint16)
    table[0, np.searchsorted(keys, two[0])] = discounted(two[1], cuts[1])
    table[1:, np.searchsorted(keys, ends[0])] = context(*ends[1:], cuts[2])
    return [(three[0], discounted(three[1], cuts[2])[None, :]), (keys, table), (one[0], np.stack([discounted(one[1], cuts[0]), *context(*one[2:], cuts[1])]))]


def _asked(key: np.ndarray, fresh: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of a block's trigrams, of its bigrams and of its words, the latter two with the bound's first."""
    vw = pair(after(key, fresh, BOUND), key)
    uv = after(vw, fresh, BOUNDS)
    two = place(vw, n)
    return [trigram_place(after(two, fresh, place(BOUNDS, n)), uv, vw), np.concatenate([place(BOUNDS, n), two]), np.concatenate([place(BOUND, n), place(key, n)])]


def _asker(n: int):
    """Documents of one wave to blocks: a row with the texts (part -1), and one with its questions for each shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for table in _held(batches, BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            rows = [(number, -1, sink.getvalue().to_pybytes())]
            asked = [distinct(x) for x in _asked(*_words(table), n)]
            cuts = [dict(by_shard(x, n)) for x in asked]
            for k in sorted({k for cut in cuts for k in cut}):
                rows.append((number, k, bundle([gaps(low(x[cut[k]])) if k in cut else b"" for x, cut in zip(asked, cuts, strict=True)])))
            number += 1
            yield from _by_bytes(rows, BLOBS)
        release()

    return ask


def _answerer(cuts: list[tuple[float, float, float]]):
    """A shard's counts and all blocks' questions to it: the answers, in the order of the questions."""

    def answer(key: tuple, known: pa.Table, asked: pa.Table) -> pa.Table:
        tables, out = known_values(known, cuts), []
        for block, part, blob in zip(*(asked.column(c) for c in BLOBS.names), strict=True):
            blobs = []
            for (keys, values), question in zip(tables, unbundle(blob.as_py()), strict=True):
                wanted = ungapped(question) if question else np.empty(0, np.uint32)
                at = np.searchsorted(keys, wanted)
                found = at < len(keys)
                found[found] = keys[at[found]] == wanted[found]
                got = np.zeros((len(values), len(wanted)), np.uint16)
                got[:, found] = values[:, at[found]]
                blobs.append(squeezed(got.ravel()))
            out.append((block.as_py(), part.as_py(), bundle(blobs)))
        del tables
        release()
        return pa.Table.from_batches(_by_bytes(out, BLOBS), BLOBS)

    return answer


def _judge(n: int, spelling, total: float, empty: float):
    """A block's texts and the answers to its questions: each text's -ln p, in nats."""

    def judge(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(own.column("blob")[0].as_py()).read_all()
        key, fresh = _words(table)
        asked = _asked(key, fresh, n)
        del key
        uvw, vw, w = (ranked(asked.pop(0))[1] for _ in range(3))
        uv, v = after(vw[1:], fresh, vw[0]), after(w[1:], fresh, w[0])
        vw, w = vw[1:], w[1:]
        got: list[list[np.ndarray]] = [[], [], []]
        for blob in answers.sort_by("part").column("blob"):
            for order, (x, width) in enumerate(zip(unbundle(blob.as_py()), (1, 3, 3), strict=True)):
                got[order].append(opened(x, "u2").reshape(width, -1))
        three, two, one = (np.concatenate([np.zeros((width, 0), np.uint16), *x], 1) for x, width in zip(got, (1, 3, 3), strict=True))
        three, two, one = from_logs(three[0], 0.0), (from_logs(two[0], 0.0), from_logs(two[1], 1.0), from_logs(two[2], 1.0)), (from_logs(one[0], 0.0) / total, from_logs(one[1], 1.0), from_logs(one[2], 1.0))
        del got
        logs = np.frombuffer(spelling.value, np.uint8)
        lengths, nll, at = [], [], 0
        for texts, (begin, end, doc, _) in _split(table):  # split again rather than kept
            code, size = codes(texts, symbol_table())
            sums = np.concatenate([[0.0], np.cumsum(logs[code] / STEPS)])
            spelled = sums[end] - sums[begin]
            s = slice(at, at + len(begin))
            left = two[2][uv[s]] * one[2][v[s]]
            with np.errstate(divide="ignore"):
                known = np.log(three[uvw[s]] / two[1][uv[s]] + two[2][uv[s]] * two[0][vw[s]] / one[1][v[s]] + left * one[0][w[s]])
                left = np.log(left * empty)
            ends = np.cumsum(size)
            spaces = sums[ends] - sums[ends - size] - np.bincount(doc, spelled, len(texts))
            nll.append(np.maximum(spaces, 0) - np.bincount(doc, np.logaddexp(known, left - spelled), len(texts)))
            lengths.append(size)
            at += len(begin)
        columns = {c: table.column(c) for c in ("doc_id", "lang", "hash")}
        del uvw, uv, vw, v, w, three, two, one
        release()
        return pa.table({**columns, "n_chars": pa.array(np.concatenate(lengths)), "nll": pa.array(np.concatenate(nll))})

    return judge


SCORED = "doc_id long, lang string, hash long, n_chars long, nll double"


def score(docs: DataFrame, of: int, spelled: bytes, words: WordModel, path: str) -> None:
    """Judges the documents of one fold by another fold's models and appends them (SCORED) to a table."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spelling = spark.sparkContext.broadcast(spelled)  # 16 MB, however large the corpus
    for wave in range(WAVES // FOLDS):
        mine = d.where((fold() == of) & (F.pmod(F.xxhash64("doc_id", "hash"), F.lit(WAVES // FOLDS)) == wave))
        asked, own = written(mine.mapInArrow(_asker(words.shards), "block long, part int, blob binary"), "asked", blobs=True)
        answers = words.table.groupBy("part").cogroup(asked.where("part >= 0").groupBy("part")).applyInArrow(_answerer(words.cuts), "block long, part int, blob binary")
        s = asked.where("part < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_judge(words.shards, spelling, words.total, words.rest), SCORED)
        with cleaning(spark):
            s.write.mode("append").parquet(path)
        discard(spark, own)
    spelling.destroy()


def drawn(typical: Column) -> Column:
    """nll a character, drawn towards the typical one."""
    return (F.col("nll") + PSEUDO * typical) / (F.col("n_chars") + PSEUDO)


def thresholds(known: DataFrame) -> DataFrame:
    """Per language (and, with every = true, for all): the typical nll a character, the median, the highest that is kept, and the number of documents."""
    text = known.where("n_chars > 0").select("lang", "n_chars", "nll")
    both = text.withColumn("every", F.lit(False)).unionByName(text.withColumns({"every": F.lit(True), "lang": F.lit(None).cast("string")}))
    typical = both.groupBy("every", "lang").agg((F.sum("nll") / F.sum("n_chars")).alias("typical"))
    key = lambda d: d.withColumn("_k", F.concat_ws("|", F.col("every").cast("string"), "lang"))
    each = key(both).drop("every", "lang").join(F.broadcast(key(typical)), "_k")  # a row a language
    q = F.percentile_approx(drawn(F.col("typical")), F.lit([0.5, QUANTILE]), F.lit(10_000))
    return each.groupBy("every", "lang", "typical").agg(q.alias("q"), F.count("*").alias("n")).select("every", "lang", "typical", F.col("q")[0].alias("middle"), F.col("q")[1].alias("most"), "n")


def pooled(known: DataFrame, limits: DataFrame) -> float | None:
    """How far above its language's median a trusted document may lie: the quantile over all languages."""
    own = limits.where("not every").select(F.col("lang").alias("_lang"), "typical", "middle")
    d = known.where("n_chars > 0").join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("_lang")))  # a row a language
    return d.agg(F.percentile_approx(drawn(F.col("typical")) - F.col("middle"), QUANTILE, F.lit(10_000))).first()[0]


def scored(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, lang, text): doc_id, lang, hash (of the text), n_chars, nll (of the whole text), perplexity.

    ids: the trusted doc_ids. One fold's models are made, judge the other fold's documents and go before the next are made.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trusted = text.join(small(ids), "doc_id", "left_semi").where("text <> ''").withColumn("fold", fold())
    c, ngrams = written(counts(trusted), "ngrams")
    every = docs.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    chars = {r["fold"]: r["n"] for r in trusted.groupBy("fold").agg(F.sum(F.length("text")).alias("n")).collect()}  # two rows
    path = new_folder(spark, "scored")
    for k in range(FOLDS):
        spelled = b"".join(model(c.where(F.col("fold") == k).select("code", "n")))
        words = WordModel(trusted.where(F.col("fold") == k).select("text"), 1 + max(chars.get(k, 0), every // 8) // SHARD_CHARS)
        score(docs, FOLDS - 1 - k, spelled, words, path)
        discard(spark, words.path)
    discard(spark, ngrams)
    s = spark.read.schema(SCORED).parquet(path)
    return s.withColumn("perplexity", F.when(F.col("n_chars") > 0, F.exp(F.col("nll") / F.col("n_chars"))))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, hash, n_chars, nll, perplexity, threshold (a perplexity), kept."""
    ids = stored(trusted_ids(labels), "trusted")
    s = scored(docs, ids)
    known = s.join(small(ids), "doc_id", "left_semi")
    limits = stored(thresholds(known), "limits")
    every = limits.where("every").select("typical", "most", "middle").first() or (None, None, None)
    wide = F.greatest("most", F.greatest(F.col("middle"), F.lit(every[2]).cast("double")) + F.lit(pooled(known, limits)).cast("double"))
    table = limits.where("not every").select(F.col("lang").alias("_lang"), "typical", F.when(F.col("n") < LEAST, wide).otherwise(F.col("most")).alias("most"))
    j = s.join(small(table), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    typical, most = F.coalesce("typical", F.lit(every[0]).cast("double")), F.coalesce("most", F.lit(every[1]).cast("double"))
    kept = (F.col("n_chars") > 0) & F.coalesce(drawn(typical) <= most, F.lit(True))
    return j.select("doc_id", "lang", "hash", "n_chars", "nll", "perplexity", F.exp(most).alias("threshold"), kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept. Rows that agree in doc_id, lang and text are judged as one; a null doc_id is no exception."""
    gone = stored(judged(docs, labels).where("not kept").select("doc_id", "lang", "hash").distinct(), "gone")
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("lang").alias("_gone_lang"), F.col("hash").alias("_gone_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & docs["lang"].cast("string").eqNullSafe(gone["_gone_lang"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_hash"])
    return docs.join(small(gone), same, "left_anti")
