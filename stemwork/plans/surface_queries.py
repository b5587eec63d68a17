"""Queries over triangulated surfaces, nearest neighbours, layers of the canopy and the sweep of densities, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.functions.scalars import window_size
from stemwork.operators import detections, hulls, pooling, spatial, sweep, tin, trees

from .fixtures import ctes, fixture
from .spatial_queries import D2, plots_of, sides, walk_sql

RADIUS, KEYS = 12.0, ["cell"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "points").select("cell", "point", "x", "y", "z", F.when(F.col("point") % 4 == 0, 2).otherwise(5).alias("class"), (F.col("point") % 3).alias("ret"))


def ground_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tin.triangles(_points(spark, sf_dir).where("class = 2"), KEYS, RADIUS, tile=20.0).select("cell", "a", "b", "c")


def tin_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return tin.ground_heights(p, p.where("class = 2"), KEYS, RADIUS, 3.0, 50.0).select("cell", "point", F.round("ground", 6).alias("ground"))


def tin_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tin.canopy(_points(spark, sf_dir).where("ret = 1"), KEYS, 2.0, RADIUS).withColumn("value", F.round("value", 6))


def pit_free_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tin.pit_free(_points(spark, sf_dir), KEYS, 2.0, (0.0, 9.0, 12.0), (0.0, 9.0), radius=RADIUS).withColumn("value", F.round("value", 6))


def tin_clip_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = detections.prepared_clips(_points(spark, sf_dir), plots_of(spark, sf_dir), KEYS, 0.04, 2.0, 20, 3, 3.0, by="tin", radius=RADIUS)
    return rows.select("cell", "point", F.round("z", 6).alias("z"))


def nearest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = (df.withColumnRenamed(c, "point") for df, c in zip(sides(spark, sf_dir), ("stem", "det")))
    return spatial.nearest_k(dets, stems.select("cell", "point", "x", "y"), KEYS, 3, 1.0).select("cell", "point", "place", "r_point", "d2")


def canopy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.canopy_layers(_points(spark, sf_dir), KEYS, 4.0, (0.0, 0.0), 1.5)


def layered_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.layered_maxima(_points(spark, sf_dir), KEYS, window_size("z", 0.3, 4.0, 9.0), 9.0, 2.0, (0.0, 0.0), 1.5, 5.0, 7.0).select("cell", "layer", "row", "col", "z")


def auto_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.auto_maxima(_points(spark, sf_dir), KEYS, first=5.0, around=10.0, low=2.0, high=9.0).select("cell", "point", "n_around")


def point_tree_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.point_trees(_points(spark, sf_dir), KEYS, (12, 5), 4.0)


RUNG, RESOLUTIONS, SLOPES, DENSE = 0.04, (2.0, 4.0), (0.1, 0.3), 0.02


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, _ = sides(spark, sf_dir)
    return sweep.ladder(_points(spark, sf_dir), stems, plots_of(spark, sf_dir), "cell", (RUNG,), RESOLUTIONS, SLOPES, 2.0, 20, 3, 3.0, RADIUS, DENSE, 4.0, 9.0)


def ladder_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ladder(spark, sf_dir)
    return rows.select("cell", "rung", "chm_res", "vwf_a", F.round("pdens", 9).alias("pdens"), F.round("frdens", 9).alias("frdens"), "n_ref", "n_det", "TP", "tp_core", "recall", "precision", "F1", F.round("height_rmse", 6).alias("height_rmse"), "fp_near", "fp_isolated")


def ladder_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _ladder(spark, sf_dir).withColumns({"site": F.lit("all"), "plot": F.col("cell").cast("string")})
    return pooling.pool(cells, ["rung", "chm_res", "vwf_a"]).select("rung", "chm_res", "vwf_a", "n_plots", "n_ref", "n_det", "TP", "tp_core", "recall", "precision", "F1")


def site_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the hull of each cell's points, with its area."""
    found = hulls.convex_hulls(_points(spark, sf_dir), KEYS)
    area = hulls.hull_area(found, KEYS).select(F.col("cell").alias("_cell"), "corners", F.round("area", 6).alias("area"))
    return found.join(area, F.col("cell").eqNullSafe(F.col("_cell"))).select("cell", "point", "corners", "area")


QUERIES = {f.__name__: f for f in (ground_triangles, tin_heights, tin_surface, pit_free_surface, tin_clip_points, nearest_three, canopy_layers, layered_tops, auto_tops, point_tree_scales, ladder_sweep, ladder_pooled, site_hulls)}

_P = ctes("points") + ", p AS (SELECT cell, point, x, y, z, CASE WHEN point % 4 = 0 THEN 2 ELSE 5 END AS class, point % 3 AS ret FROM f_points)"


def _turned(a: float, b: float) -> str:
    v = f"sin(x * {a} + y * {b}) * 43758.5453"
    return f"({v} - floor({v}) - 0.5) * 1e-6"


def tri_sql(name: str, source: str) -> str:
    """Triangles (cell, a, b, c, ax, ...) of a table of points by trying all threes against all points."""
    return f"""{name}_j AS (SELECT cell, point, x, y, z, x + {_turned(12.9898, 78.233)} AS jx, y + {_turned(39.3468, 11.1351)} AS jy FROM {source}),
{name}_t AS (SELECT a.cell, a.point AS a, b.point AS b, c.point AS c, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, a.jx AS ox, a.jy AS oy, b.jx - a.jx AS ux, b.jy - a.jy AS uy, c.jx - a.jx AS vx, c.jy - a.jy AS vy
FROM {name}_j a JOIN {name}_j b ON a.cell = b.cell AND a.point < b.point JOIN {name}_j c ON c.cell = a.cell AND b.point < c.point),
{name}_q AS (SELECT *, (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / (2 * (ux * vy - uy * vx)) AS mx, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / (2 * (ux * vy - uy * vx)) AS my FROM {name}_t),
{name} AS (SELECT * FROM {name}_q q WHERE mx * mx + my * my <= {RADIUS * RADIUS} AND NOT EXISTS (SELECT 1 FROM {name}_j p WHERE p.cell = q.cell AND p.point NOT IN (q.a, q.b, q.c) AND (p.jx - ox - mx) * (p.jx - ox - mx) + (p.jy - oy - my) * (p.jy - oy - my) < mx * mx + my * my))"""


def _at_sql(name: str, places: str, on: str, tri: str, keys: str) -> str:
    """(keys, v): the height of the triangles at places (x, y), of the first triangle."""
    whole = '(("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy))'
    return f"""{name}_u AS (SELECT {keys}, t.a, t.b, t.c, az, bz, cz, (("by" - cy) * (g.x - cx) + (cx - bx) * (g.y - cy)) / {whole} AS u, ((cy - ay) * (g.x - cx) + (ax - cx) * (g.y - cy)) / {whole} AS v FROM {places} g JOIN {tri} t ON {on}),
{name} AS (SELECT {keys.replace('g.', '')}, arg_min(u * az + v * bz + (1 - u - v) * cz, (a, b, c)) AS v FROM {name}_u WHERE least(u, v, 1 - u - v) >= -1e-9 GROUP BY {keys.replace('g.', '')})"""


def ground_sql(points: str, ground: str) -> str:
    """gh: (cell, point, g), the height of the triangulated ground at points, or of the three nearest ground points."""
    return f"""{tri_sql('gt', ground)}, {_at_sql('gi', points, 'g.cell = t.cell', 'gt', 'g.cell, g.point')},
gn AS (SELECT a.cell, a.point, b.point AS o, b.z, {D2} AS d2 FROM {points} a ANTI JOIN gi ON a.cell = gi.cell AND a.point = gi.point JOIN {ground} b ON a.cell = b.cell AND {D2} <= 2500 QUALIFY row_number() OVER (PARTITION BY a.cell, a.point ORDER BY {D2}, b.point) <= 3),
gf AS (SELECT cell, point, coalesce(arg_min(z, o) FILTER (d2 = 0), sum(z / sqrt(d2)) FILTER (d2 > 0) / sum(1 / sqrt(d2)) FILTER (d2 > 0)) AS g FROM gn GROUP BY ALL),
gh AS (SELECT q.cell, q.point, coalesce(gi.v, gf.g) AS g FROM {points} q LEFT JOIN gi ON q.cell = gi.cell AND q.point = gi.point LEFT JOIN gf ON q.cell = gf.cell AND q.point = gf.point)"""


def raster_sql(name: str, tri: str, res: float) -> str:
    """(cell, row, col, v) of triangles at the centres of cells."""
    grid = f"""{name}_g AS (SELECT r + 1 AS "row", c + 1 AS col, (c + 0.5) * {res} AS x, -(r + 0.5) * {res} AS y FROM range(-40, 40) a(r), range(-40, 40) b(c))"""
    near = f"g.x BETWEEN least(ax, bx, cx) - 1e-6 AND greatest(ax, bx, cx) + 1e-6 AND g.y BETWEEN least(ay, \"by\", cy) - 1e-6 AND greatest(ay, \"by\", cy) + 1e-6"
    return f'{grid}, {_at_sql(name, f"{name}_g", near, tri, "cell, g.row, g.col")}'.replace("g.row", 'g."row"').replace('cell, row, col', 'cell, "row", col')


_CLIP = f"""pl AS (SELECT DISTINCT cell, CASE WHEN cell % 2 = 0 THEN 10.0 ELSE 6.0 END AS half FROM f_points), i AS (SELECT p.*, half + 2 AS wide FROM p JOIN pl USING (cell) WHERE abs(x) <= half + 2 AND abs(y) <= half + 2 QUALIFY count(*) OVER (PARTITION BY cell) >= 20),
dc AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY cell, floor(x / 5), floor(y / 5) ORDER BY CAST(CAST('0x' || substr(md5('0|' || point), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0, point) <= 1)"""
_LONGEST = 'greatest((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by"), (bx - cx) * (bx - cx) + ("by" - cy) * ("by" - cy), (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))'
_LAYERS = """h AS (SELECT cell, CAST(floor(-y / {r}) + 1 AS INT) AS "row", CAST(floor(x / {r}) + 1 AS INT) AS col, z FROM p WHERE z >= 2),
ly AS (SELECT cell, "row", col, 1 AS layer, max(z) AS value FROM h GROUP BY cell, "row", col UNION ALL SELECT h.cell, h."row", h.col, any_value(ly.layer) + 1, max(h.z) FROM ly JOIN h ON h.cell = ly.cell AND h."row" = ly."row" AND h.col = ly.col AND h.z <= ly.value - 1.5 GROUP BY h.cell, h."row", h.col)"""


def _picked_sql(rows: str, near: str) -> str:
    """kp: (cell, k) of the rows that stay when they are taken in the order of k, each if no kept one is near."""
    return f"""nb AS (SELECT a.cell, a.k, list(b.k) AS bad FROM {rows} a JOIN {rows} b ON a.cell = b.cell AND b.k < a.k AND {near} GROUP BY a.cell, a.k), od AS (SELECT r.cell, r.k, coalesce(bad, []) AS bad FROM {rows} r LEFT JOIN nb ON r.cell = nb.cell AND r.k = nb.k),
wk AS (SELECT cell, k, [k] AS kept FROM od WHERE k = 1 UNION ALL SELECT od.cell, od.k, CASE WHEN list_has_any(kept, bad) THEN kept ELSE list_append(kept, od.k) END FROM wk JOIN od ON od.cell = wk.cell AND od.k = wk.k + 1), kp AS (SELECT cell, unnest(arg_max(kept, k)) AS k FROM wk GROUP BY cell)"""


def _forest_sql(k: int) -> str:
    return f"""n{k} AS (SELECT * FROM nn WHERE place <= {k}), u{k} AS (SELECT a.cell, a.point, arg_min(o, place) FILTER (oz > z OR (oz = z AND o < a.point)) AS parent FROM n{k} a GROUP BY ALL),
f{k} AS (SELECT e.cell, e.point, u.parent FROM en e LEFT JOIN u{k} u ON e.cell = u.cell AND e.point = u.point),
w{k} AS (SELECT cell, point, point AS tree FROM f{k} WHERE parent IS NULL UNION ALL SELECT f.cell, f.point, w.tree FROM w{k} w JOIN f{k} f ON f.cell = w.cell AND f.parent = w.point)"""


def _shape_sql(name: str, rows: str) -> str:
    return f"""{name}_s AS (SELECT r.cell, r.tree, count(*) AS n, avg(e.x) AS mx, avg(e.y) AS my, var_pop(e.x) AS vx, var_pop(e.y) AS vy, covar_pop(e.x, e.y) AS c FROM {rows} r JOIN en e ON r.cell = e.cell AND r.point = e.point GROUP BY ALL),
{name} AS (SELECT s.cell, s.tree, n, CASE WHEN vx + vy > 0 THEN sqrt(greatest(0, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + c * c)) / ((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + c * c))) * greatest(0, 1 - sqrt(((e.x - mx) * (e.x - mx) + (e.y - my) * (e.y - my)) / (vx + vy))) ELSE 0 END AS score
FROM {name}_s s JOIN en e ON s.cell = e.cell AND s.tree = e.point)"""


def _maxima_sql(n: int, res: float) -> str:
    """Surfaces of one resolution of the sweep, with pits filled, smoothed where they are to be: x{n} (cell, row, col, value)."""
    some = f"tf{n} AS (SELECT t.* FROM ft t JOIN dn d ON t.cell = d.cell{f' WHERE frdens >= {DENSE}' if res == min(RESOLUTIONS) else ''})"
    near = f'FROM r{n} a LEFT JOIN r{n} b ON a.cell = b.cell AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1'
    return f"""{some}, {raster_sql(f'r{n}', f'tf{n}', res)}, m{n} AS (SELECT a.cell, a."row", a.col, median(b.v) FILTER (a."row" <> b."row" OR a.col <> b.col) AS m, any_value(a.v) AS v {near} GROUP BY ALL),
l{n} AS (SELECT cell, "row", col, CASE WHEN m - v > 1 THEN m ELSE v END AS v FROM m{n}), s{n} AS (SELECT a.cell, a."row", a.col, avg(b.v) AS v {near.replace(f'r{n} ', f'l{n} ')} GROUP BY ALL),
x{n} AS (SELECT l.cell, l."row", l.col, CASE WHEN frdens < {DENSE} THEN s.v ELSE l.v END AS z, (l.col - 0.5) * {res} AS x, -(l."row" - 0.5) * {res} AS y, {n} AS n FROM l{n} l JOIN s{n} s ON l.cell = s.cell AND l."row" = s."row" AND l.col = s.col JOIN dn d ON l.cell = d.cell)"""


_GATE = "(b.z >= 0.5 * a.z AND b.z <= a.z + 8)"
_LADDER = f"""WITH RECURSIVE {_P}, {_CLIP}, e AS (SELECT cell * 10 AS cell, cell AS base, point, x, y, z, class, ret, wide FROM i UNION ALL SELECT cell * 10 + 1, cell, point, x, y, z, class, ret, wide FROM dc),
eg AS (SELECT * FROM e QUALIFY count(*) FILTER (class = 2) OVER (PARTITION BY cell) >= 3), g2 AS (SELECT * FROM eg WHERE class = 2), {ground_sql('eg', 'g2')},
nz AS (SELECT eg.* REPLACE (eg.z - g AS z) FROM eg JOIN gh ON eg.cell = gh.cell AND eg.point = gh.point WHERE eg.z - g >= -1 AND eg.z - g < 80),
da AS (SELECT cell, any_value(base) AS base, count(*) / (4.0 * any_value(wide) * any_value(wide)) AS pdens, count_if(ret = 1) / (4.0 * any_value(wide) * any_value(wide)) AS frdens FROM nz GROUP BY cell),
dn AS (SELECT * FROM da WHERE cell % 10 = 0 OR EXISTS (SELECT 1 FROM da b WHERE b.cell = da.base * 10 AND {RUNG} < b.pdens)), fr AS (SELECT nz.* FROM nz SEMI JOIN dn ON nz.cell = dn.cell WHERE ret = 1), {tri_sql('ft', 'fr')},
{_maxima_sql(0, RESOLUTIONS[0])}, {_maxima_sql(1, RESOLUTIONS[1])},
xa AS (SELECT cell * 100 + n * 10 + k AS cell, (CAST("row" AS BIGINT) + 1073741824) * 2147483648 + col + 1073741824 AS det, x, y, z, least(greatest(a * z + 4.0, 4.0), 9.0) / 2 AS h FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1), (VALUES (0, CAST({SLOPES[0]} AS DOUBLE)), (1, CAST({SLOPES[1]} AS DOUBLE))) v(k, a) WHERE z >= 2),
tp AS (SELECT cell, det, x, y, z FROM xa a WHERE NOT EXISTS (SELECT 1 FROM xa b WHERE a.cell = b.cell AND (b.z > a.z OR (b.z = a.z AND b.det < a.det)) AND {D2} <= a.h * a.h)),
st AS (SELECT dn.cell * 100 + n * 10 + k AS cell, base, CASE WHEN dn.cell % 10 = 1 THEN CAST({RUNG} AS DOUBLE) END AS rung, CASE n WHEN 0 THEN CAST({RESOLUTIONS[0]} AS DOUBLE) ELSE CAST({RESOLUTIONS[1]} AS DOUBLE) END AS chm_res, CASE k WHEN 0 THEN CAST({SLOPES[0]} AS DOUBLE) ELSE CAST({SLOPES[1]} AS DOUBLE) END AS vwf_a, pdens, frdens FROM dn, range(2) a(n), range(2) b(k) WHERE n = 1 OR frdens >= {DENSE}),
s AS (SELECT st.cell, point, x, y, z FROM f_points p JOIN st ON p.cell = st.base WHERE point % 2 = 0), d AS (SELECT tp.*, abs(x) <= half AND abs(y) <= half AS core FROM tp JOIN st ON tp.cell = st.cell JOIN pl ON pl.cell = st.base WHERE abs(x) <= half + 4 AND abs(y) <= half + 4),
c AS (SELECT a.cell, a.point AS stem, b.det, sqrt({D2}) AS dist FROM s a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= 4 AND {_GATE}), {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
m AS (SELECT o.cell, stem, det FROM o JOIN w USING (cell, k) WHERE take), sm AS (SELECT s.*, d.core, d.z AS dz, m.det FROM s LEFT JOIN m ON s.cell = m.cell AND s.point = m.stem LEFT JOIN d ON d.cell = m.cell AND d.det = m.det),
l AS (SELECT cell, count(*) AS n_ref, count(det) AS TP, count_if(coalesce(core, false)) AS tp_core, sqrt(avg((dz - z) * (dz - z))) AS height_rmse FROM sm GROUP BY cell), nd AS (SELECT cell, count_if(core) AS n_det FROM d GROUP BY cell),
fp AS (SELECT d.cell, d.x, d.y FROM d LEFT JOIN m ON d.cell = m.cell AND d.det = m.det WHERE core AND m.det IS NULL),
fk AS (SELECT cell, count_if(near) AS fp_near, count_if(NOT near) AS fp_isolated FROM (SELECT a.cell, EXISTS (SELECT 1 FROM sm b WHERE b.cell = a.cell AND b.det IS NOT NULL AND {D2} <= 16) AS near FROM fp a) GROUP BY cell),
q AS (SELECT base AS cell, rung, chm_res, vwf_a, pdens, frdens, coalesce(n_ref, 0) AS n_ref, coalesce(n_det, 0) AS n_det, coalesce(TP, 0) AS TP, coalesce(tp_core, 0) AS tp_core, height_rmse, coalesce(fp_near, 0) AS fp_near, coalesce(fp_isolated, 0) AS fp_isolated FROM st LEFT JOIN l ON st.cell = l.cell LEFT JOIN nd ON st.cell = nd.cell LEFT JOIN fk ON st.cell = fk.cell)"""
_RATES = """CASE WHEN n_ref > 0 THEN CAST(TP AS DOUBLE) / n_ref END AS recall, CASE WHEN n_det > 0 THEN CAST(tp_core AS DOUBLE) / n_det END AS "precision\""""
_F1 = 'CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") END AS F1'

ORACLE_SQL = {
    "ground_triangles": f"WITH {_P}, g2 AS (SELECT * FROM p WHERE class = 2), {tri_sql('t', 'g2')} SELECT cell, a, b, c FROM t",
    "tin_heights": f"WITH {_P}, g2 AS (SELECT * FROM p WHERE class = 2), {ground_sql('p', 'g2')} SELECT cell, point, round(g, 6) AS ground FROM gh",
    "tin_surface": f"""WITH {_P}, fr AS (SELECT * FROM p WHERE ret = 1), {tri_sql('t', 'fr')}, {raster_sql('r', 't', 2.0)} SELECT cell, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, round(v, 6) AS value FROM r""",
    "pit_free_surface": f"""WITH {_P}, {', '.join(f"p{n} AS (SELECT * FROM p WHERE z >= {least}), {tri_sql(f't{n}', f'p{n}')}, k{n} AS (SELECT * FROM t{n}{f' WHERE {_LONGEST} <= 81' if n else ''}), {raster_sql(f'r{n}', f'k{n}', 2.0)}" for n, least in enumerate((0, 9, 12)))}
SELECT cell, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, round(max(v), 6) AS value FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL""",
    "tin_clip_points": f"WITH {_P}, {_CLIP}, e AS (SELECT * FROM dc QUALIFY count(*) FILTER (class = 2) OVER (PARTITION BY cell) >= 3), g2 AS (SELECT * FROM e WHERE class = 2), {ground_sql('e', 'g2')} SELECT e.cell, e.point, round(e.z - g, 6) AS z FROM e JOIN gh ON e.cell = gh.cell AND e.point = gh.point WHERE e.z - g >= -1 AND e.z - g < 80",
    "nearest_three": f"WITH {_P} SELECT a.cell, a.point, CAST(row_number() OVER o AS INT) AS place, b.point AS r_point, {D2} AS d2 FROM p a JOIN p b ON a.cell = b.cell AND a.point % 2 = 1 AND b.point % 2 = 0 WINDOW o AS (PARTITION BY a.cell, a.point ORDER BY {D2}, b.point) QUALIFY row_number() OVER o <= 3",
    "canopy_layers": f"WITH RECURSIVE {_P}, {_LAYERS.format(r=4.0)} SELECT cell, CAST(layer AS INT) AS layer, \"row\", col, value FROM ly",
    "layered_tops": f"""WITH RECURSIVE {_P}, {_LAYERS.format(r=2.0)}, ac AS (SELECT *, (col - 0.5) * 2.0 AS x, -("row" - 0.5) * 2.0 AS y, value AS z, least(greatest(0.3 * value + 4.0, 4.0), 9.0) / 2 AS h FROM ly),
lm AS (SELECT * FROM ac a WHERE NOT EXISTS (SELECT 1 FROM ac b WHERE a.cell = b.cell AND a.layer = b.layer AND (b.z > a.z OR (b.z = a.z AND (b."row", b.col) < (a."row", a.col))) AND {D2} <= a.h * a.h)), tk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY z DESC, layer, "row", col) AS k FROM lm),
{_picked_sql('tk', f'{D2} <= 25 AND {D2} + (a.z - b.z) * (a.z - b.z) <= 49')} SELECT cell, CAST(layer AS INT) AS layer, "row", col, z FROM tk JOIN kp USING (cell, k)""",
    "auto_tops": f"""WITH {_P}, h AS (SELECT * FROM p WHERE z >= 2), ro AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.cell = b.cell AND (b.z > a.z OR (b.z = a.z AND b.point < a.point)) AND {D2} <= 6.25)),
n AS (SELECT a.*, (SELECT count(*) FROM ro b WHERE a.cell = b.cell AND {D2} <= 100) AS n_around FROM h a), v AS (SELECT *, CASE WHEN n_around > 0 THEN least(greatest(sqrt(3.141592653589793 * 100 / n_around) * 0.75, 2.0), 9.0) ELSE 9.0 END / 2 AS s FROM n)
SELECT cell, point, n_around FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.cell = b.cell AND (b.z > a.z OR (b.z = a.z AND b.point < a.point)) AND {D2} <= a.s * a.s)""",
    "point_tree_scales": f"""WITH RECURSIVE {_P}, en AS (SELECT * FROM p WHERE z >= 2 QUALIFY count(*) OVER (PARTITION BY cell) >= 5), nn AS (SELECT a.cell, a.point, a.z, b.point AS o, b.z AS oz, row_number() OVER (PARTITION BY a.cell, a.point ORDER BY {D2}, b.point) AS place FROM en a JOIN en b ON a.cell = b.cell AND a.point <> b.point),
{_forest_sql(5)}, {_forest_sql(12)}, {_shape_sql('a5', 'w5')}, {_shape_sql('a12', 'w12')}, av AS (SELECT a.cell, w.tree AS whole, sum(n * score) / sum(n) AS average FROM a5 a JOIN w12 w ON a.cell = w.cell AND a.tree = w.point GROUP BY ALL),
tk AS (SELECT a.cell, a.tree AS whole FROM a12 a JOIN av ON a.cell = av.cell AND a.tree = av.whole WHERE score >= average) SELECT f.cell, f.point, coalesce(tk.whole, f.tree) AS tree FROM w5 f JOIN w12 c ON f.cell = c.cell AND f.point = c.point LEFT JOIN tk ON tk.cell = c.cell AND tk.whole = c.tree""",
    "ladder_sweep": f"""{_LADDER} SELECT cell, rung, chm_res, vwf_a, round(pdens, 9) AS pdens, round(frdens, 9) AS frdens, n_ref, n_det, TP, tp_core, recall, "precision", {_F1}, round(height_rmse, 6) AS height_rmse, fp_near, fp_isolated FROM (SELECT *, {_RATES} FROM q)""",
    "site_hulls": f"""WITH {_P}, e AS (SELECT a.cell, a.point, a.x, a.y, b.x AS bx, b.y AS "by" FROM p a JOIN p b ON a.cell = b.cell AND a.point <> b.point WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.cell = a.cell AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT cell, point, count(*) OVER (PARTITION BY cell) AS corners, round(sum(x * "by" - bx * y) OVER (PARTITION BY cell) / 2, 6) AS area FROM e""",
    "ladder_pooled": f"""{_LADDER} SELECT *, {_F1} FROM (SELECT *, {_RATES} FROM (SELECT rung, chm_res, vwf_a, count(DISTINCT cell) AS n_plots, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(tp_core) AS BIGINT) AS tp_core FROM q GROUP BY ALL))""",
}
