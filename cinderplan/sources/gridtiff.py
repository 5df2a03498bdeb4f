"""A Python data source for one-band rasters in TIFF files: rows (r, c, value), and their georeference.

Files are listed and read by Spark's binaryFile source, so that any storage Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cinderplan.sources.grids import GridMeta

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Tags by their names in the format's description.
WIDTH, HEIGHT, BITS, PACKING, STRIPS, BANDS, STRIP_ROWS, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SCALE, TIE, KEYS, PROJECTED = 33550, 33922, 34735, 3072


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(order + "H", data, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, entry, inline, head = ("I", "HHI", 4, 2) if version == 42 else ("Q", "HHQ", 8, 8)
    (at,) = struct.unpack_from(order + word, data, 4 if version == 42 else 8)
    (number,) = struct.unpack_from(order + ("H" if version == 42 else "Q"), data, at)
    step = struct.calcsize("<" + entry) + inline
    out = {}
    for k in range(number):
        begin = at + head + step * k
        tag, kind, n = struct.unpack_from(order + entry, data, begin)
        field = begin + step - inline
        where = field if SIZES.get(kind, 0) * n <= inline else struct.unpack_from(order + word, data, field)[0]
        if kind == 2:
            out[tag] = (data[where : where + n].rstrip(b"\0").decode("latin-1"),)
        elif kind in CODES:
            out[tag] = struct.unpack_from(f"{order}{n}{CODES[kind]}", data, where)
    return order, out


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bits, 256 begins anew, 257 ends, a code grows one entry early."""
    known = [bytes([i]) for i in range(256)] + [b"", b""]
    out, last, held, bits, width = [], b"", 0, 0, 9
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del known[258:]
            last, width = b"", 9
            continue
        if code > len(known) or code == len(known) and not last:
            raise ValueError("a damaged LZW strip")
        found = known[code] if code < len(known) else last + last[:1]
        if last:
            known.append(last + found[:1])
            width = min(12, max(9, (len(known) + 1).bit_length()))
        out.append(found)
        last = found
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32773: unpackbits, 32946: zlib.decompress}


def image(data: bytes) -> np.ndarray:
    """Band 1 as an array; strips or tiles, plain, LZW, deflated or PackBits, with or without differences along rows."""
    order, t = tags(data)
    rows, cols, bits = t[HEIGHT][0], t[WIDTH][0], t[BITS][0]
    kind = {1: "u", 2: "i", 3: "f"}[t.get(FORMAT, (1,))[0]]
    bands, packing, predictor = (t.get(k, (1,))[0] for k in (BANDS, PACKING, PREDICTOR))
    if packing not in UNPACK or bits % 8 or t.get(284, (1,))[0] != 1 and bands > 1:
        raise ValueError(f"TIFF compression {packing}, {bits} bits or separate bands are not supported")
    if TILES in t:
        high, wide, places, sizes = t[TILE_HEIGHT][0], t[TILE_WIDTH][0], t[TILES], t[TILE_SIZES]
    else:
        high, wide, places, sizes = min(rows, t.get(STRIP_ROWS, (rows,))[0]), cols, t[STRIPS], t[STRIP_SIZES]
    across = -(-cols // wide)
    out = np.zeros((rows, cols), f"{kind}{bits // 8}")
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        r, c = k // across * high, k % across * wide
        if size and r < rows:
            n = high if TILES in t else min(high, rows - r)
            raw = UNPACK[packing](data[place : place + size])[: n * wide * bands * bits // 8]
            if predictor == 3:  # differences of bytes, the high bytes of a row first
                planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(n, -1, bands), axis=1, dtype=np.uint8)
                a = np.ascontiguousarray(planes.reshape(n, bits // 8, wide * bands).transpose(0, 2, 1)).view(f">{kind}{bits // 8}").reshape(n, wide, bands)
            else:
                a = np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}")).reshape(n, wide, bands)
                a = np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a
            out[r : r + n, c : c + wide] = a[: rows - r, : cols - c, 0]
    return out


def meta(data: bytes, zone: int = 0) -> GridMeta:
    """The georeference. UTM zone and hemisphere are those of the file's EPSG code; zone is for files without one."""
    _, t = tags(data)
    (sx, sy, *_), (i, j, _, x, y, *_) = t[SCALE], t[TIE]
    keys = t.get(KEYS, ())
    crs = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] == PROJECTED), 0)
    half, own = divmod(crs - 32600, 100)
    if half in (0, 1) and 1 <= own <= 60:
        zone = own
    return GridMeta(x - i * sx, y + j * sy, sx, sy, t[HEIGHT][0], t[WIDTH][0], zone, half == 1 and 1 <= own <= 60, crs)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, value double) of every raster under path."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                a = image(content.as_py())
                for r in range(0, a.shape[0], 256):  # rows at a time
                    part = a[r : r + 256]
                    rr, cc = np.indices(part.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array((rr + np.int32(r)).ravel()), pa.array(cc.ravel()), pa.array(part.astype(np.float64).ravel())], names=["path", "r", "c", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cells, "path string, r int, c int, value double")


def read_meta(spark: SparkSession, path: str, zone: int = 0) -> GridMeta:
    return meta(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]), zone)
