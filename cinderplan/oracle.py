"""SQL for DuckDB that states what the queries mean, written apart from the Spark code."""

from __future__ import annotations

import math

from cinderplan import tables
from cinderplan.functions import geodesy

SQL: dict[str, str] = {}
TAU = "(2 * pi())"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000 + 0.5) / 1000000 + 0.0)"


def norm(x: str) -> str:
    return f"(({x}) + pi() - {TAU} * floor((({x}) + pi()) / {TAU}) - pi())"


def clip(x: str, lo: float, hi: float) -> str:
    return f"greatest({float(lo)}::DOUBLE, least({float(hi)}::DOUBLE, {x}))"


def uniform(*parts: str) -> str:
    return "(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT / 4294967296.0)"


def u(tag: str) -> str:
    return uniform("42", "l_orderkey", "l_partkey", "l_linenumber", f"'{tag}'")


def values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) + ("::DOUBLE" if isinstance(x, float) else "") for x in r) + ")" for r in rows) + f") t({names})"


WDIR = norm("(180 - deg + 90) * pi() / 180")
TRIALS = f"""SELECT *, {WDIR} AS wdir FROM (SELECT l_orderkey, l_partkey, l_linenumber, (l_linenumber % 8) * (pi() / 4) AS angle,
 CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 1.414::DOUBLE END AS dist, l_quantity - 25.0::DOUBLE AS dh, l_tax + 0.0 AS moist,
 (l_partkey % 360)::DOUBLE AS deg, (l_suppkey % 70)::DOUBLE AS speed, 1 + l_suppkey % 7 AS veg_from, 1 + l_orderkey % 7 AS veg_to, l_discount * 100 + 1.0 AS ros FROM lineitem)"""
VEG = values(tables.veg_rows(), "veg, v0, d0, d1, hhv, hum")
SPREAD = values(tables.spread_rows(), "t, f, p")
NEIGHBOURS = values(tables.neighbour_rows(), "k, dr, dc, dist, angle")


def wind_module(ws: str) -> str:
    return f"(1 - 0.5 * 1.4 * tanh(-2.0) + 0.5 * 1.4 * tanh({ws} / 8.2 - 2.0) + {ws} / 50.0)"


def wind_effect(ws: str) -> str:
    a = f"(({wind_module(ws)} - 1) / 4)"
    return f"(({a} + 1) * (1 - {a} * {a}) / (1 - {a} * cos({norm('wdir - angle')})))"


SLOPE = "pow(2.0, tanh(pow(dh / (20 * dist) * 3, 2) * sign(dh / (20 * dist))))"


def wh(ws: str) -> str:
    return f"({SLOPE} * {wind_effect(ws)})"


_X = f"({wh(clip('speed', 0, 60))} - 1)"
WH_P = f"(CASE WHEN {_X} > 0 THEN {_X} / 2.13 WHEN {_X} < 0 THEN {_X} / 1.12 ELSE 0 END + 1)"


def pm1(m: str) -> str:
    x = f"({clip(m, 0, 1)} / 0.3)"
    return clip(f"(((((-11.507 * {x} + 22.963) * {x} - 17.331) * {x} + 6.598) * {x} - 1.7211) * {x} + 1.0003)", 0, 1)


def pm2(m: str) -> str:
    return f"(((-3.5995 * ({m}) + 5.2389) * ({m}) - 2.6355) * ({m}) + 1.019)"


def p(moisture: str) -> str:
    return clip(f"((1 - pow(1 - p, {WH_P})) * {clip(moisture, 0, 1)})", 0, 1)


DAMP = "exp(-0.014 * moist)"
ROS_DEFAULT = clip(f"v0 / 60 * {wh('speed')} * {DAMP}", 0.01, 100)
ROS_WANG = clip(f"v0 / 60 * {clip('exp(0.1783 * speed * cos(wdir - angle) / 3.6)', 0.01, 10)} * {clip('exp(sign(dh) * 3.533 * pow(tan(abs(atan(dh / 20 * dist))), 1.2))', 0.01, 10)} * {DAMP}", 0.01, 100)
ROS_ROTHERMEL = clip(f"v0 / 60 * {clip('exp(0.0576 * degrees(atan(0.4226 * speed * cos(wdir - angle) / 3.6))) / 13', 1, 20)} * {clip('exp(0.0693 * degrees(atan(dh / 20 * dist)))', 0.01, 10)} * {DAMP}", 0.01, 100)


def travel(ros: str) -> str:
    t = f"(sqrt(pow(20 * dist, 2) + pow(dh, 2)) / {ros})"
    return f"greatest(CASE WHEN {t} >= 1 THEN round_even({t}, 0) ELSE {t} END, 0.1)"


DEAD = "(hhv * (1 - moist / 100) - 2442.0 * (moist / 100))"
CANOPY = "(hhv * (1 - hum / 100) - 2442.0 * (hum / 100))"


def normal() -> str:
    return f"(100.0 + 25.0 * sqrt(-2 * ln(1 - {u('n1')})) * cos({2 * math.pi!r} * {u('n2')}))"


def poisson(x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in tables.poisson_cdf()) + ")"


CELLS = "SELECT l_orderkey % 40 AS r, l_partkey % 40 AS c, l_linenumber AS rz, 1 + l_suppkey % 7 AS veg, l_quantity AS dem, l_discount * 100 AS ros FROM lineitem"
GRID = f"SELECT r, c, CASE WHEN r < 1 OR r >= 39 OR c < 1 OR c >= 39 THEN 0 ELSE min(veg) END AS veg, max(dem) AS dem FROM ({CELLS}) GROUP BY r, c"
PROB = f"SELECT r, c, count(DISTINCT rz) / 7.0 AS value FROM ({CELLS}) WHERE ros >= 5 GROUP BY r, c"
MASK = f"SELECT r, c FROM ({PROB}) WHERE value >= 0.4"
MINUTES = "SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 60000000 AS t FROM events"
BC = f"SELECT event_id AS bc_id, t AS time, least(value, 60.0) AS w_speed, user_id * 7 % 360 AS w_dir FROM ({MINUTES}) WHERE event_type = 'signup'"
_CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc)"


def dilated(mask: str) -> str:
    return f"SELECT DISTINCT r + dr AS r, c + dc AS c FROM ({mask}) m, {_CROSS} WHERE r + dr BETWEEN 0 AND 39 AND c + dc BETWEEN 0 AND 39"


def eroded(mask: str) -> str:
    return f"SELECT r + dr AS r, c + dc AS c FROM ({mask}) m, {_CROSS} GROUP BY ALL HAVING count(*) = 5"


DILATED, ERODED = dilated(MASK), eroded(MASK)
OPENED = dilated(ERODED)
MEDIAN = f"SELECT r, c, {r6('list_sort(list_concat(v, list_resize([0.0::DOUBLE], 81 - len(v), 0.0::DOUBLE)))[41]')} AS value FROM (SELECT r + a AS r, c + b AS c, list(value) AS v FROM ({PROB}), (SELECT unnest(range(-4, 5)) AS a), (SELECT unnest(range(-4, 5)) AS b) WHERE value <> 0 AND r + a BETWEEN 0 AND 39 AND c + b BETWEEN 0 AND 39 GROUP BY ALL)"


def boundary(mask: str) -> str:
    return f"WITH m AS ({mask}) SELECT r + a AS r0, c + b AS c0, r + x AS r1, c + y AS c1 FROM m, (VALUES (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)) s(dr, dc, a, b, x, y) WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.r = m.r + dr AND n.c = m.c + dc)"


def gaussian(weights: list[float]) -> str:
    half = len(weights) // 2
    terms = " + ".join(f"{w!r}::DOUBLE * v[CASE WHEN {j} < n THEN {j} + 1 ELSE 2 * n - {j} END]" for w, j in ((w, f"((i + {k - half} + 2 * n) % (2 * n))") for k, w in enumerate(weights)))
    return f"SELECT vec_id, CAST(i AS INTEGER) AS pos, {r6('0.0 + ' + terms)} AS value FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings)"


EDGES = f"""WITH g AS (SELECT * FROM ({GRID}) WHERE veg > 0)
SELECT s.r, s.c, d.r AS nr, d.c AS nc, k, dist, {r6('angle')} AS angle, d.dem - s.dem AS dh, s.veg AS veg_from, d.veg AS veg_to, p, f.v0, v.d0, v.d1, v.hhv, v.hum
FROM g s CROSS JOIN ({NEIGHBOURS}) n JOIN g d ON d.r = s.r + dr AND d.c = s.c + dc JOIN ({SPREAD}) q ON q.t = d.veg AND q.f = s.veg JOIN ({VEG}) f ON f.veg = s.veg JOIN ({VEG}) v ON v.veg = d.veg"""


def _draw(*tag: str) -> str:
    return uniform("42", "rz", "r", "c", *tag)


def opened(certain: bool, realizations: str) -> str:
    """Open edges of every source in every condition: (epoch, rz, r, c, nr, nc, k, dt10, ros, fli)."""
    bc = "(VALUES (0, 335.0::DOUBLE, 9.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 30.0, 0.05)) b(epoch, deg, speed0, moist)"
    noisy = f"""SELECT e.*, rz, epoch, moist, {'w' if certain else f"w + pi() / 16 * (0.5 - {_draw('0', repr('wdir'))})"} AS wdir, {'speed0' if certain else f"speed0 * (1.2 - 0.4 * {_draw('0', repr('wspeed'))})"} AS speed
 FROM (SELECT r, c, nr, nc, k, dist, dh, p, v0, d0, d1, hhv, hum, a AS angle FROM (SELECT x.*, n.angle AS a FROM ({EDGES}) x JOIN ({NEIGHBOURS}) n USING (k))) e, ({realizations}) z, (SELECT epoch, moist, speed0, {norm('(180 - deg + 90) * pi() / 180')} AS w FROM {bc})"""
    trial = "" if certain else f" WHERE {p(pm1('moist'))} > {_draw('k', '0', repr('open'))}"
    return f"SELECT epoch, rz, r, c, nr, nc, k, CAST(round_even({travel('v')} * 10, 0) AS BIGINT) AS dt10, v AS ros, v * ({DEAD} * d0 + {CANOPY} * d1) / 60 AS fli FROM (SELECT *, {ROS_WANG} AS v FROM ({noisy}){trial})"


ONE_TICK = f"SELECT rz, r, c, nr, nc, k, dt10 AS t_arr, {r6('ros')} AS ros, {r6('fli')} AS fli FROM ({opened(False, 'SELECT unnest([0, 1]) AS rz')}) WHERE epoch = 0"


def fixpoint(certain: bool, limit: int) -> str:
    """Earliest arrivals; sources before minute 18 burn under the first condition, later ones under the second."""

    def phase(name: str, start: str, epoch: int, when: str) -> str:
        return f"""{name}(rz, r, c, t) USING KEY (rz, r, c) AS ({start} UNION
 SELECT o.rz, o.nr, o.nc, min(q.t + o.dt10) FROM {name} q JOIN o ON o.rz = q.rz AND o.r = q.r AND o.c = q.c AND o.epoch = {epoch}
 LEFT JOIN recurring.{name} b ON b.rz = o.rz AND b.r = o.nr AND b.c = o.nc
 WHERE q.{when} AND q.t + o.dt10 <= {limit} AND (b.t IS NULL OR q.t + o.dt10 < b.t) GROUP BY o.rz, o.nr, o.nc)"""

    return f"""WITH RECURSIVE o AS MATERIALIZED ({opened(certain, 'SELECT unnest(range(4))::INTEGER AS rz')}),
 {phase('early', 'SELECT rz::INTEGER, 20::BIGINT, 20::BIGINT, 0::BIGINT FROM (SELECT unnest(range(4)) AS rz)', 0, 't < 180')},
 {phase('late', 'SELECT * FROM early', 1, 't >= 180')}
SELECT rz, r, c, t AS t_burn FROM late"""


def statistics(burned: str) -> str:
    p = f"SELECT s10, r, c, count(*) / 4.0 AS value FROM b JOIN (SELECT unnest([0, 100, 200, 300])::BIGINT AS s10) s ON t_burn <= s10 GROUP BY s10, r, c"
    shares = ", ".join(f"{r6(f'count(*) FILTER (WHERE value >= {q}) * 0.04')} AS area_{round(q * 100)}" for q in (0.5, 0.75, 0.9))
    return f"WITH b AS ({burned}) SELECT s10, {r6('sum(value) * 0.04')} AS area_mean, {shares} FROM ({p}) GROUP BY s10"


def _walk(start: str) -> str:
    """Segments (id, c0, r0, c1, r1) cell by cell."""
    return f"""w(id, pos, c, r, e, c1, r1, dc, dr, sc, sr) AS (
 SELECT id, 0, c0, r0, abs(c1 - c0) - abs(r1 - r0), c1, r1, abs(c1 - c0), abs(r1 - r0), CASE WHEN c0 < c1 THEN 1 ELSE -1 END, CASE WHEN r0 < r1 THEN 1 ELSE -1 END FROM ({start})
 UNION ALL SELECT id, pos + 1, c + CASE WHEN 2 * e > -dr THEN sc ELSE 0 END, r + CASE WHEN 2 * e < dc THEN sr ELSE 0 END,
 e - CASE WHEN 2 * e > -dr THEN dr ELSE 0 END + CASE WHEN 2 * e < dc THEN dc ELSE 0 END, c1, r1, dc, dr, sc, sr FROM w WHERE c <> c1 OR r <> r1)"""


SEGMENTS = f"WITH RECURSIVE {_walk('SELECT s_suppkey AS id, s_suppkey * 7 % 23 AS c0, s_suppkey * 5 % 23 AS r0, s_suppkey * 11 % 23 AS c1, s_suppkey * 3 % 23 AS r1 FROM supplier')} SELECT id AS s_suppkey, pos, r, c FROM w"
_CORNERS = "SELECT s_suppkey AS s, s_suppkey * 3 % 17 + 1 AS ar, s_suppkey * 5 % 17 + 1 AS ac, s_suppkey * 7 % 17 + 1 AS br, s_suppkey * 2 % 17 + 12 AS bc, s_suppkey * 11 % 17 + 12 AS cr, s_suppkey * 13 % 17 + 3 AS cc FROM supplier"
_SIDES = f"SELECT s * 3 AS id, ac AS c0, ar AS r0, bc AS c1, br AS r1 FROM ({_CORNERS}) UNION ALL SELECT s * 3 + 1, bc, br, cc, cr FROM ({_CORNERS}) UNION ALL SELECT s * 3 + 2, cc, cr, ac, ar FROM ({_CORNERS})"
OUTLINES = f"WITH RECURSIVE {_walk(_SIDES)} SELECT id // 3 AS s_suppkey, count(*) AS n, count(DISTINCT r * 100 + c) AS distinct_n FROM w WHERE pos > 0 OR id % 3 = 0 GROUP BY id // 3"
FILLED = f"""WITH RECURSIVE {_walk(_SIDES)}, wall AS (SELECT DISTINCT id // 3 AS s, r, c FROM w),
 out(s, r, c) AS (SELECT s_suppkey, 0, 0 FROM supplier UNION SELECT o.s, o.r + dr, o.c + dc FROM out o, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dr, dc)
 WHERE o.r + dr BETWEEN 0 AND 39 AND o.c + dc BETWEEN 0 AND 39 AND NOT EXISTS (SELECT 1 FROM wall x WHERE x.s = o.s AND x.r = o.r + dr AND x.c = o.c + dc))
SELECT s AS s_suppkey, 1600 - count(*) AS n, 31200 - CAST(sum(r) AS BIGINT) AS sum_r, 31200 - CAST(sum(c) AS BIGINT) AS sum_c FROM out GROUP BY s"""


IGNITIONS = FILLED.split("SELECT s AS s_suppkey")[0] + """, inside AS (SELECT DISTINCT g.r, g.c FROM (SELECT s_suppkey AS s, r, c FROM supplier, (SELECT unnest(range(40)) AS r), (SELECT unnest(range(40)) AS c)) g
 WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.s = g.s AND o.r = g.r AND o.c = g.c) AND NOT EXISTS (SELECT 1 FROM wall w WHERE w.r = g.r AND w.c = g.c))
SELECT 'queued' AS state, rz, r, c FROM (SELECT DISTINCT r, c FROM wall), (SELECT unnest(range(3)) AS rz) UNION ALL SELECT 'burned', -1, r, c FROM inside"""


def ring(weights: list[float]) -> str:
    half = len(weights) // 2
    j = [f"((i + {k - half} + 2 * h) % (2 * h))" for k in range(len(weights))]
    at = lambda x, start: f"v[CASE WHEN {x} < h THEN {x} + 1 ELSE 2 * h - {x} END + {start}]"
    sums = [" + ".join(f"{w!r}::DOUBLE * {at(x, start)}" for w, x in zip(weights, j, strict=True)) for start in ("0", "h")]
    d = f"SELECT vec_id, i, h, {sums[0]} AS r, {sums[1]} AS c FROM (SELECT *, unnest(range(h)) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) // 2 AS h FROM embeddings))"
    return f"SELECT vec_id, CAST(i AS INTEGER) AS pos, {r6('CASE WHEN i = h - 1 THEN first_value(r) OVER p ELSE r END')} AS r, {r6('CASE WHEN i = h - 1 THEN first_value(c) OVER p ELSE c END')} AS c FROM ({d}) WINDOW p AS (PARTITION BY vec_id ORDER BY i)"


def _forward(a: str, zone: str, keep: str) -> str:
    """keep, e and n from rows with lat and lon."""
    g = geodesy
    th = lambda x: f"(0.5 * ln((1 + {x}) / (1 - {x})))"
    e = g.ECCENTRICITY
    east = " + ".join(["eta", *(f"{v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(g.ALPHA, 1))])
    north = " + ".join(["xi", *(f"{v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(g.ALPHA, 1))])
    k = f"SELECT *, sin(radians(lat)) AS s, radians(lon - ({zone} * 6 - 183)) AS lam FROM ({a})"
    t = f"SELECT *, sinh({th('s')} - {e!r} * {th(f'({e!r} * s)')}) AS t FROM ({k})"
    x = f"SELECT *, atan2(t, cos(lam)) AS xi, {th('(sin(lam) / sqrt(1 + t * t))')} AS eta FROM ({t})"
    return f"SELECT {keep}, 500000.0 + {g.SCALE * g.RADIUS!r} * ({east}) AS e, {g.SCALE * g.RADIUS!r} * ({north}) + CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END AS n FROM ({x})"


def project_back(meta, to) -> str:
    """Cells (r, c) of a longitude-latitude grid with the UTM cell (br, bc) of their middles."""
    a = f"SELECT r, c, {to.north!r}::DOUBLE - (r + 0.5::DOUBLE) * {to.step_lat!r}::DOUBLE AS lat, {to.west!r}::DOUBLE + (c + 0.5::DOUBLE) * {to.step_lon!r}::DOUBLE AS lon FROM (SELECT unnest(range({to.rows})) AS r), (SELECT unnest(range({to.cols})) AS c)"
    return f"SELECT r, c, CAST(floor(({meta.north} - n) / {meta.step_y}) AS BIGINT) AS br, CAST(floor((e - {meta.west}) / {meta.step_x}) AS BIGINT) AS bc FROM ({_forward(a, str(meta.zone), 'r, c')})"


def _utm() -> str:
    zone = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 END"
    a = "SELECT c_custkey, (c_custkey % 130 - 60)::DOUBLE AS lat, c_custkey % 359 - 179.5::DOUBLE AS lon FROM customer"
    f = _forward(f"SELECT *, {zone} AS zone FROM ({a})", "zone", "c_custkey, zone")
    return f"SELECT c_custkey, zone, floor(e * 1000 + 0.5) / 1000 AS easting, floor(n * 1000 + 0.5) / 1000 AS northing, CAST(floor((10000000.0 - n) / 20) AS BIGINT) AS r, CAST(floor((e - 100000.0) / 20) AS BIGINT) AS c FROM ({f})"


UTM = _utm()
