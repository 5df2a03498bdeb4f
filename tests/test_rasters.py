"""Drawing, morphology, rings, rasters in files, conditions and parameters."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderplan import sinks
from cinderplan.functions import geodesy
from cinderplan.operators import conditions, drawing, raster
from cinderplan.sources import grids, gridtiff, params


def test_segments(spark):
    for ends, want in (((0, 0, 5, 2), [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]), ((3, 1, 0, 4), [(1, 3), (2, 2), (3, 1), (4, 0)]), ((2, 2, 2, 2), [(2, 2)])):
        got = spark.range(1).select(drawing.segment(*map(F.lit, ends)).alias("p")).first().p
        assert [(x.r, x.c) for x in got] == want


def test_triangle(spark):
    path = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for c, r in ((1, 1), (6, 1), (1, 6))))
    d = drawing.cells_of(spark.range(1), ["id"], drawing.outline(path), 8, 8)
    assert d.count() == 16 and d.select("r", "c").distinct().count() == 15
    assert drawing.filled(d, ["id"]).count() == 21


def test_morphology(spark):
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[0, 0] = True
    d = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(m)], "r int, c int")
    assert raster.eroded(d).count() == 9
    assert raster.opened(d, 9, 9).count() == 21
    rings = raster.rings(raster.boundary(d).withColumn("g", F.lit(1)), "g").collect()
    assert sorted(len(r.path) for r in rings) == [5, 21] and all(r.outer for r in rings)
    hole = d.where("r <> 4 or c <> 4")
    assert sorted(r.outer for r in raster.rings(raster.boundary(hole).withColumn("g", F.lit(1)), "g").collect()) == [False, True, True]


def test_smoothing_keeps_constants(spark):
    got = spark.range(1).select(raster.smooth(F.array(*[F.lit(2.0)] * 5), 0.8).alias("v")).first().v
    assert np.allclose(got, 2.0)


def test_trim_of_nothing(spark):
    empty = spark.createDataFrame([(1, 1, 0.0)], "r int, c int, value double")
    assert raster.trimmed(empty, 40, 40).count() == 0


def test_tiff_round_trip(spark, tmp_path):
    a = (np.arange(35).reshape(5, 7) % 8).astype(np.uint8)
    (tmp_path / "veg.tif").write_bytes(sinks.geotiff(a, 500000.0, 4600000.0, 20.0, 20.0))
    (tmp_path / "dem.tif").write_bytes(sinks.geotiff(a.astype(np.float64) * 10, 500000.0, 4600000.0, 20.0, 20.0))
    d = {(r.r, r.c): r.value for r in gridtiff.read(spark, f"file://{tmp_path}/veg.tif").collect()}
    assert len(d) == 35 and all(d[k] == a[k] for k in d)
    m = gridtiff.read_meta(spark, f"file://{tmp_path}/dem.tif", 32)
    assert (m.west, m.north, m.step_x, m.rows, m.cols, m.east, m.south) == (500000.0, 4600000.0, 20.0, 5, 7, 500140.0, 4599900.0)
    assert grids.consistent(m, m)


def tiff(a, packing, pack, tile=None, big=False, order="<", predictor=1):
    """A raster in a TIFF file, written apart from the library's own writer."""
    import struct

    rows, cols = a.shape
    a = a.astype(a.dtype.newbyteorder(order))
    if tile:
        padded = np.zeros((-(-rows // tile) * tile, -(-cols // tile) * tile), a.dtype)
        padded[:rows, :cols] = a
        parts = [padded[r : r + tile, c : c + tile] for r in range(0, rows, tile) for c in range(0, cols, tile)]
    else:
        parts = [a[r : r + 2] for r in range(0, rows, 2)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], 1).astype(a.dtype) for p in parts]
    if predictor == 3:
        planes = [p.astype(p.dtype.newbyteorder(">")).view(np.uint8).reshape(p.shape[0], p.shape[1], -1).transpose(0, 2, 1).reshape(p.shape[0], -1) for p in parts]
        parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], 1) for p in planes]
    packed = [pack(np.ascontiguousarray(p).tobytes()) for p in parts]
    head = 16 if big else 8
    places = np.cumsum([head, *map(len, packed)])[:-1]
    body = b"".join(packed)
    word, size = ("Q", 8) if big else ("I", 4)
    lists = struct.pack(f"{order}{len(packed)}{word}", *places) + struct.pack(f"{order}{len(packed)}{word}", *map(len, packed))
    at = head + len(body)
    number = len(packed)
    where = [at, at + number * size] if number > 1 else [int(places[0]), len(packed[0])]
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    long = 16 if big else 4
    tags = {256: (3, 1, cols), 257: (3, 1, rows), 258: (3, 1, a.dtype.itemsize * 8), 259: (3, 1, packing), 317: (3, 1, predictor), 339: (3, 1, kind)}
    tags |= {322: (3, 1, tile), 323: (3, 1, tile), 324: (long, number, where[0]), 325: (long, number, where[1])} if tile else {273: (long, number, where[0]), 278: (3, 1, 2), 279: (long, number, where[1])}
    value = lambda k, v: struct.pack(order + "H", v).ljust(size, b"\0") if k == 3 else struct.pack(order + word, v)
    ifd = struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(struct.pack(order + "HH" + word, t, k, n) + value(k, v) for t, (k, n, v) in sorted(tags.items())) + b"\0" * size
    mark = b"II" if order == "<" else b"MM"
    begin = at + len(lists)
    return mark + (struct.pack(order + "HHHQ", 43, 8, 0, begin) if big else struct.pack(order + "HI", 42, begin)) + body + lists + ifd


def lzw(data):
    """Codes of nine bits and more, begun anew before the table is full."""
    codes, known, word = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    size = 258
    width = lambda: min(12, max(9, (size + 1).bit_length()))
    for x in data:
        if word + bytes([x]) in known:
            word += bytes([x])
            continue
        codes.append((known[word], max(9, size.bit_length()) if size > 258 else 9))
        known[word + bytes([x])] = size
        size += 1
        word = bytes([x])
        if size >= 4094:
            codes.append((known[word], size.bit_length()))
            codes.append((256, (size + 1).bit_length() if size < 4095 else 12))
            known, size, word = {bytes([i]): i for i in range(256)}, 258, b""
    if word:
        codes.append((known[word], max(9, size.bit_length()) if size > 258 else 9))
        size += 1
    codes.append((257, max(9, size.bit_length())))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def packbits(data):
    return b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("packing", "pack"), [(1, bytes), (5, lzw), (8, zlib.compress), (32773, packbits)])
@pytest.mark.parametrize(("tile", "big"), [(None, False), (16, False), (16, True)])
def test_tiff_layouts(packing, pack, tile, big, order):
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 9, (37, 45)).astype(np.uint8), rng.integers(-3000, 3000, (20, 33)).astype(np.int16), rng.normal(0, 500, (19, 18)).astype(np.float32)):
        for predictor in (1, 2, 3) if a.dtype.kind == "f" else (1, 2):
            if predictor == 2 and a.dtype.kind == "f":
                continue
            assert (gridtiff.image(tiff(a, packing, pack, tile, big, order, predictor)) == a).all(), (a.dtype, predictor)


def test_unlzw_of_known_bytes():
    assert gridtiff.unlzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_reference_system_of_files():
    a = np.zeros((3, 4), np.uint8)
    m = gridtiff.meta(sinks.geotiff(a, 5e5, 7e6, 20.0, 20.0, crs=32733))
    assert (m.zone, m.south_half, m.crs) == (33, True, 32733)
    north = gridtiff.meta(sinks.geotiff(a, 5e5, 7e6, 20.0, 20.0, crs=32633))
    assert not north.south_half and not grids.consistent(m, north)


def test_conditions(spark, tmp_path):
    job = {"time_limit": 60, "ignitions": ["POINT: 1;2"], "canadair": ["LINE:[1];[2]"], "boundary_conditions": [{"time": 30, "w_dir": 10, "w_speed": 30, "moisture": 5, "canadair": ["x"], "ignitions": None}, {"time": 10, "w_dir": 1}]}
    (tmp_path / "p.json").write_text(json.dumps(job, indent=1))
    p = params.read(spark, f"file://{tmp_path}/p.json")
    assert p.first().n_threads == 10 and p.first().ros_model == "wang"
    bc = params.conditions(p).orderBy("bc_id").collect()
    assert [(r.bc_id, r.time, r.w_speed, r.canadair) for r in bc] == [(0, 0.0, 0.0, []), (1, 10.0, 0.0, ["LINE:[1];[2]"]), (2, 30.0, 30.0, ["x", "LINE:[1];[2]"])]
    without = params.with_defaults(spark.createDataFrame([(None, None)], params.schema().split(", boundary")[0].split(", ")[0] + ", n_threads int"))
    assert without.first().n_threads == 10
    assert params.time_limit(None, 2) == 120 and params.time_limit(0, None) is None and params.spotting(None, True)


def test_as_of_both_ways(spark):
    states = spark.createDataFrame([(0.0, "a"), (5.0, "b"), (5.0, "c"), (9.0, "d")], "time double, s string").withColumn("bc_id", F.monotonically_increasing_id())
    events = spark.createDataFrame([(float(t),) for t in (-1, 0, 4, 5, 8, 100)], "t double")
    few = conditions.as_of_few(events, conditions.intervals(states), "t", ["s"])
    got = {r.t: r.s for r in few.collect()}
    assert got == {-1: None, 0: "a", 4: "a", 5: "c", 8: "c", 100: "d"}
    many = conditions.as_of(events, states.where("s <> 'b'"), "t", "time", ["s"])
    assert {r.t: r.s for r in many.collect()} == got


def test_overlays_from_literals(spark):
    """Waterlines, Canadair drops and helicopters leave their moisture on the cells they draw and beside them; heavy lines block."""
    meta = grids.GridMeta(455976.0, 4908176.0, 20.0, 20.0, 21, 21, 32)
    at = lambda r, c: (F.lit(meta.west + (c + 0.5) * 20), F.lit(meta.north - (r + 0.5) * 20), F.lit(32))
    ends = [(5, 3), (5, 6), (10, 3), (10, 6), (15, 15), (18, 2), (18, 4)]
    row = spark.range(1).select(*(F.concat_ws(" ", *(x.cast("string") for x in geodesy.inverse(*at(*e)))).alias(f"p{k}") for k, e in enumerate(ends))).first()
    p = [x.split() for x in row]
    line = lambda a, b: f"LINE:[{a[0]} {b[0]}];[{a[1]} {b[1]}]"
    schema = "bc_id int, time double, waterline_action array<string>, canadair array<string>, helicopter array<string>, heavy_action array<string>"
    bc = spark.createDataFrame([(0, 0.0, [line(p[0], p[1])], [line(p[2], p[3])], [f"POINT:{p[4][0]};{p[4][1]}"], []), (1, 30.0, [], [], [], [line(p[5], p[6])])], schema)
    got = {(r.r, r.c): r.moist for r in drawing.moisture_overlays(bc, meta).where("bc_id = 0").collect()}
    cross = lambda cells: {(r + a, c + b) for r, c in cells for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    water, drop = {(5, c) for c in range(3, 7)}, {(10, c) for c in range(3, 7)}
    heli = [k for k, v in got.items() if v == drawing.HELICOPTER and k[0] > 12]  # a buffer has the same value
    assert len(heli) == 1 and max(abs(heli[0][0] - 15), abs(heli[0][1] - 15)) <= 2
    want = {k: drawing.WATERLINE for k in cross(water)} | {k: drawing.CANADAIR_BUFFER for k in cross(drop)} | {k: drawing.CANADAIR for k in drop}
    want |= {k: drawing.HELICOPTER_BUFFER for k in cross(heli)} | {k: drawing.HELICOPTER for k in heli}
    assert got == want
    blocked = {(r.r, r.c): r.heavy_t10 for r in drawing.heavy_cells(bc, meta).collect()}
    assert blocked == {k: 300 for k in cross({(18, c) for c in (2, 3, 4)})}
    with pytest.raises(Exception, match="must be a LINE"):
        drawing.moisture_overlays(bc.withColumn("canadair", F.array(F.lit("POINT:1;2"))), meta).collect()
