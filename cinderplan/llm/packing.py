"""Cost-balanced packing of token ids into sequences.

A document's cost is estimated as ``LINEAR * n + QUADRATIC * n * n`` (attention stays within a piece). Documents are cut
at the sequence length; whole pieces fill sequences of their own. Of the rest, in blocks of ``BLOCK_TOKENS`` tokens, as
many sequences are opened as their tokens need; pieces go, longest first, to the sequence of least cost among those with
room; what fits nowhere whole is cut over the sequences with most room. A block so leaves at most one sequence short.

Blocks are runs of rows within an input partition: nothing is shuffled, memory is bounded by a block (or by one
document), and a retried task gives the same sequences. sequence_id is the input partition's number and a counter.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; any order of rows is fine, and
an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import pieces, release

LENGTH = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_TOKENS = 1 << 20
# Fixed value: how byte-level BPE vocabularies of this family split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the ``tokenizers`` library.

    special: the file's added tokens are cut out of texts first and give their own ids, as is the library's default;
    otherwise they are ordinary text (the library's ``encode_special_tokens``).

    Texts are cut before each space that a non-space follows: such places are always boundaries of the vocabulary's
    own pre-tokens, so that the ids of the chunks are the ids of the text. Each distinct chunk of a batch is merged
    once, by tiktoken over the file's vocabulary, in which a token's id is its merge rank (checked on loading).
    """

    def __init__(self, path: str, special: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or [] if special else []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("the vocabulary's added tokens depend on what is around them")
        self._added = {t["content"]: t["id"] for t in added}
        # of those that begin at one place the longest is taken
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)) + ")") if added else None
        letters = _byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        if any(b <= a for a, b in zip(ids, ids[1:])):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        ranks = {k: v for k, v in ranks.items() if v <= ids[-1]}  # special tokens come after the merges
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        self._size = size  # bytes of each token

    def one(self, text: str) -> list[int]:
        if self._cut is None:
            return self._bpe.encode_ordinary(text)
        # every second part is an added token
        return [i for k, part in enumerate(self._cut.split(text)) for i in ([self._added[part]] if k % 2 else self._bpe.encode_ordinary(part))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) as uint32, one text after the other, and where each begins (and the end)."""
        texts = pa.compute.fill_null(texts.cast(pa.string()), "")
        split = pa.compute.split_pattern(texts, " ")
        first = np.asarray(split.offsets)
        first = first - first[0]
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary
        # such a part belongs to the chunk before it: it is empty or starts with white space
        odd = np.asarray(pa.compute.or_(pa.compute.equal(known, ""), pa.compute.not_equal(pa.compute.utf8_ltrim_whitespace(known), known)), bool)
        plain = known.filter(pa.array(~odd))
        joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
        joined = " " + joined if len(plain) else ""
        ids = np.array(self._bpe.encode_ordinary(joined), np.uint32)
        width = np.where(odd, 0, np.asarray(pa.compute.binary_length(known), np.int64) + 1)
        begin = np.searchsorted(np.cumsum(self._size[ids]) - self._size[ids], np.cumsum(width) - width)
        count = np.diff(begin, append=len(ids))
        # the first part of a text has no space before it; a text with odd parts or added tokens is taken whole
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        whole = np.zeros(len(texts), bool)
        later = np.ones(len(code), bool)
        later[first[:-1]] = False
        whole[doc[odd[code] & later]] = True
        for token in self._added:
            whole |= np.asarray(pa.compute.match_substring(texts, token), bool)
        own = [self.one(texts[i].as_py() if w else known[c].as_py()) for i, (w, c) in enumerate(zip(whole.tolist(), code[first[:-1]].tolist(), strict=True))]
        own_size = np.array([len(x) for x in own], np.int64)
        own_begin = len(ids) + np.cumsum(own_size) - own_size
        ids = np.concatenate([ids, np.array([i for x in own for i in x], np.uint32)])
        at, n = begin[code], np.where(whole[doc], 0, count[code])
        at[first[:-1]], n[first[:-1]] = own_begin, own_size
        ends = np.cumsum(n)
        place = np.repeat((at - (ends - n)).astype(np.int32 if int(ends[-1]) < 1 << 30 else np.int64), n)
        place += np.arange(len(place), dtype=place.dtype)
        got = ids[place].astype("<u4", copy=False)
        return got, np.concatenate([[0], ends])[first]


def assign(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of a block of documents of these sizes."""
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int]] = []
    s = 0
    for d, n in enumerate(sizes.tolist()):
        whole = n // length
        for k in range(whole):
            out.append((d, k * length, length, s, 0))
            s += 1
        if n % length:
            rest.append((n % length, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    opened = -(-sum(n for n, _ in rest) // length)
    used, cost = np.zeros(opened, np.int64), np.zeros(opened)
    over: list[tuple[int, int]] = []
    for n, d in rest:
        k = int(np.where(used <= length - n, cost, np.inf).argmin())  # of all with room the one of least cost
        if used[k] > length - n:
            over.append((n, d))
            continue
        out.append((d, int(sizes[d]) - n, n, s + k, int(used[k])))
        used[k] += n
        cost[k] += LINEAR * n + QUADRATIC * n * n
    used = used.tolist()
    room = sorted((k for k in range(opened) if used[k] < length), key=lambda k: (used[k], k))
    for n, d in over:
        at = int(sizes[d]) - n
        while n:
            k = room[0]
            take = min(n, length - used[k])
            out.append((d, at, take, s + k, used[k]))
            used[k] += take
            at, n = at + take, n - take
            if used[k] == length:
                room.pop(0)
    return out


def _packer(path: str, length: int, block_tokens: int, special: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, special)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40

        def flush(held: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            nonlocal sequence
            found = assign(np.array([len(x) for _, x in held], np.int64), length)
            rows = [(held[d][0], at, n, held[d][1][at : at + n].tobytes(), len(held[d][1]), sequence + s, o) for d, at, n, s, o in found]
            sequence += max((s for _, _, _, s, _ in found), default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids, first = encode(batch.column("text"))
                ids, first = np.insert(ids, first[1:], END_ID), first + np.arange(len(first))
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    held.append((doc_id, ids[a:b]))
                    tokens += b - a
                    if tokens >= block_tokens:
                        yield flush(held)
                        held, tokens = [], 0
        if held:
            yield flush(held)
            held.clear()
        release()

    return pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, special: bool = False) -> DataFrame:
    """One row per piece of ``docs(doc_id, text, ...)``: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    path: a byte-level BPE vocabulary file, readable on every executor; special: as for ``Encoder``.
    """
    pack, schema = _packer(path, length, block_tokens, special)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)
