"""Queries of the spatial family: range joins, matching, scores of cells, fusion, overlaps, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stemwork.functions.scalars import in_box, match_tolerance, rate
from stemwork.operators import clustering, matching, rasters, scoring, selection, spatial, statistics
from stemwork.sources.scratch import checkpoints
from stemwork.sources.tables import geojson_features

from .fixtures import ctes, fixture

TOL = 4.0


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stems, detections) of the points fixture."""
    p = fixture(spark, sf_dir, "points")
    stems = p.where("point % 2 = 0").select("cell", F.col("point").alias("stem"), "x", "y", "z", "crown_class")
    return stems, p.where("point % 2 = 1").select("cell", F.col("point").alias("det"), "x", "y", "z", "arm")


def plots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "points").select("cell").distinct().select("cell", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.when(F.col("cell") % 2 == 0, 10.0).otherwise(6.0).alias("half"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    return spatial.candidates(stems, dets, ["cell"], TOL)


def scaled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a tolerance of each stem, of its crown diameter and position error."""
    stems, dets = sides(spark, sf_dir)
    stems = stems.withColumn("tol", match_tolerance((F.col("stem") % 13).cast("double"), (F.col("stem") % 7).cast("double"), 2.0, 1.0, 5.0))
    return spatial.candidates(stems, dets, ["cell"], "tol", most=5.0)


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_first(*sides(spark, sf_dir), ["cell"], TOL)


def greedy_match_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return matching.nearest_first(*sides(spark, sf_dir), ["cell"], TOL, method=matching.greedy_rounds)


def optimal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.optimal_points(*sides(spark, sf_dir), ["cell"], TOL)


def soft_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.optimal_points(*sides(spark, sf_dir), ["cell"], TOL, weight=0.5)


def match_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    return matching.nearest_in_turn(stems, dets, ["cell"], 3.0)


def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    out = matching.agreement(greedy_match(spark, sf_dir), stems, dets, ["cell"])
    return out.withColumns({c: F.round(c, 9) for c in ("dz_mean", "dz_sd")})


def score_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    out = scoring.score_plots(stems, dets, plots_of(spark, sf_dir), ["cell"], TOL)
    return out.withColumn("height_rmse", F.round("height_rmse", 9))


def near_or_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    return spatial.isolated(dets, stems, 2.0, ["cell"]).select("cell", "det", "near")


def voronoi_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    stems = stems.withColumn("radius", (F.col("stem") % 5).cast("double"))
    return spatial.assign(dets.withColumnRenamed("det", "point"), stems, ["cell"], 4.0)


def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems, dets = sides(spark, sf_dir)
    sources = stems.select("cell", F.col("stem").alias("src"), "x", "y", (F.col("stem") % 9).alias("label"))
    return spatial.nearest(dets.withColumnRenamed("det", "point"), sources, 3.0, ["cell"], "point", "src", "label")


def witness_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points").withColumnRenamed("arm", "fam")
    return spatial.witnesses(p, p, 2.0, ["cell"], "point")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of one family's isolated detections by grid of radius and number of families."""
    p = fixture(spark, sf_dir, "points")
    fps = p.select("cell", "point", F.col("arm").alias("fam"), "x", "y", (F.col("point") % 5 != 0).alias("eligible"))
    out = None
    for r in (1.5, 2.0, 3.0):
        for k in (1, 2):
            rows = clustering.credits(fps, ["cell"], "chm_vwf", r, k).select("cell", F.lit(r).alias("radius"), F.lit(k).alias("families"), "credited")
            out = rows if out is None else out.union(rows)
    return out


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return clustering.fuse(fixture(spark, sf_dir, "points"), ["cell"])


def fusion_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return clustering.operating_points(fixture(spark, sf_dir, "points"), ["cell"], 3).groupBy("cell", "mode").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"), F.round(F.sum("z"), 6).alias("z"))


def votes_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.frontier(fused(spark, sf_dir), ["cell"], 3)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "points").select("cell", "point", (F.col("point") % 4).cast("int").alias("block"), (F.floor(F.col("point") / 4) % 15).cast("int").alias("inst"), "x", "y", "z")


def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    return clustering.merge_blocks(blocks(spark, sf_dir), ["cell"], 3.0).select("cell", "point", "block", "inst", "global_id")


def instance_apexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.instance_apexes(blocks(spark, sf_dir), ["cell", "block"])


def crown_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.diameters(blocks(spark, sf_dir).drop("block"), ["cell"])


def point_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.point_set_iou(fixture(spark, sf_dir, "labelled"), ["cell"])


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.coverage(fixture(spark, sf_dir, "labelled"), ["cell"])


def overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.iou_match(point_overlaps(spark, sf_dir), ["cell"], 0.25)


def instance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixture(spark, sf_dir, "labelled")
    kinds = F.when(F.col("ref_id") % 4 == 0, "dominant").when(F.col("ref_id") % 4 == 1, "codominant").when(F.col("ref_id") % 4 == 2, "intermediate").otherwise("suppressed")
    classes = points.where("ref is not null").select("cell", F.col("ref").alias("ref_id")).distinct().withColumn("crown_class", kinds)
    out = scoring.instance_cells(points, classes, ["cell"], 0.25)
    sums = [c for c in out.columns if c.startswith("sum") or c in ("SQ", "PQ", "coverage")]
    return out.withColumns({c: F.round(c, 9) for c in sums})


def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.density(fixture(spark, sf_dir, "points").withColumn("ret", F.col("point") % 2), ["cell"], "ret")


def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.decimate(fixture(spark, sf_dir, "points"), ["cell"], 0.04).select("cell", "point")


def tiles_with_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.halo(fixture(spark, sf_dir, "points"), 8.0, 2.0).select("cell", "point", "tx", "ty", "core")


def treetops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemwork.functions.scalars import window_size

    return rasters.local_maxima(fixture(spark, sf_dir, "points"), ["cell"], "point", window_size("z", 0.1, 2.0, 6.0), 6.0).select("cell", "point")


def cloud_treetops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treetops of a cloud of as many points as there are line items."""
    from stemwork.functions.scalars import window_size

    return rasters.local_maxima(fixture(spark, sf_dir, "cloud"), ["cell"], "point", window_size("z", 0.1, 2.0, 6.0), 6.0).select("cell", "point")


def canopy_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.surface(fixture(spark, sf_dir, "points"), ["cell"], 2.0)


def smooth_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rasters.smoothed(rasters.filled(canopy_surface(spark, sf_dir), ["cell"]), ["cell"])
    return out.withColumn("value", F.round("value", 9))


def _seeds(raster: DataFrame) -> DataFrame:
    """All treetops of a raster: cells from 2 up without a higher one (of equal ones, an earlier one) among their neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = raster.withColumn("_o", F.explode(steps)).select(F.col("cell").alias("n_cell"), (F.col("row") + F.col("_o.i")).alias("n_row"), (F.col("col") + F.col("_o.j")).alias("n_col"), F.struct("value", -F.col("row"), -F.col("col")).alias("n"))
    above = near.groupBy("n_cell", "n_row", "n_col").agg(F.max("n").alias("n"))
    same = (F.col("cell") == F.col("n_cell")) & (F.col("row") == F.col("n_row")) & (F.col("col") == F.col("n_col"))
    top = raster.where("value >= 2").join(above, same & (F.col("n") > F.struct("value", -F.col("row"), -F.col("col"))), "left_anti")
    return top.withColumn("tree", F.row_number().over(W.partitionBy("cell").orderBy(F.col("value").desc(), "row", "col"))).select("cell", "row", "col", "tree")


def _segments(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raster = canopy_surface(spark, sf_dir)
        labels = rasters.segment(raster, _seeds(raster), ["cell"], method)
        tops = labels.where("label > 0").groupBy("cell", F.col("label").alias("tree")).agg(F.max("value").alias("z"))
        return rasters.crowns(rasters.truncated(labels, tops, ["cell"], 0.55), ["cell"], 2.0)

    return query


def li_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.trees(fixture(spark, sf_dir, "points"), ["cell"])


def shifted_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.mean_shift(fixture(spark, sf_dir, "points"), ["cell"]).groupBy("cell").agg(F.count_distinct("mode").alias("modes"), F.count("*").alias("points"))


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points").select("cell", "point", "x", "y", "z")
    return rasters.snap(p.where("point % 2 = 0"), p.where("point % 2 = 1"), ["cell"])


def in_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of a cell each of three polygons covers."""
    shapes = [("square", [(-5, -5), (5, -5), (5, 5), (-5, 5)]), ("kite", [(0, -9), (4, 0), (0, 9), (-4, 0)]), ("arrow", [(-8, -8), (0, -2), (8, -8), (0, 8)])]
    rings = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in shapes], "name string, ring array<struct<x:double,y:double>>")
    rows = fixture(spark, sf_dir, "points").crossJoin(F.broadcast(rings))  # three rows of parameters
    return rows.groupBy("cell", "name").agg(F.count_if(spatial.in_polygon("x", "y", "ring")).alias("covered"))


def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "points").where(in_box("x", "y", F.lit(0.0), F.lit(0.0), F.lit(10.0)))
    text = lambda path: F.get_json_object("feature", path)
    return geojson_features(p, "x", "y", ["cell", "point", "arm"]).select(
        text("$.type").alias("kind"), text("$.geometry.type").alias("shape"), text("$.geometry.coordinates[0]").cast("double").alias("lon"), text("$.geometry.coordinates[1]").cast("double").alias("lat"),
        text("$.properties.cell").cast("int").alias("cell"), text("$.properties.point").cast("long").alias("point"), text("$.properties.arm").alias("arm"),
    )


def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of recall by cell under 10 draws of the stems' positions, in one plan."""
    stems, dets = sides(spark, sf_dir)
    drawn = selection.draws(stems.withColumn("sigma", 0.5 + (F.col("stem") % 3) / 2), 10, 42, "sigma", "stem")
    ks = spark.range(1, 11).select(F.col("id").cast("int").alias("draw"))
    found = matching.nearest_first(drawn, dets.crossJoin(F.broadcast(ks)), ["cell", "draw"], TOL)  # ten rows of parameters
    hits = found.groupBy("cell", "draw").agg(F.count("*").alias("TP"))
    n = drawn.groupBy("cell", "draw").agg(F.count("*").alias("n_ref"))
    recall = n.join(hits, ["cell", "draw"], "left").na.fill(0, ["TP"]).withColumn("recall", rate("TP", "n_ref"))
    return statistics.bands(recall, ["cell"], "recall").withColumns({c: F.round(c, 9) for c in ("p05", "p50", "p95")})


QUERIES = {
    "candidate_pairs": candidate_pairs, "scaled_candidates": scaled_candidates, "greedy_match": greedy_match, "greedy_match_rounds": greedy_match_rounds, "optimal_match": optimal_match, "soft_match": soft_match,
    "match_in_turn": match_in_turn, "set_agreement": set_agreement, "score_plots": score_plots, "near_or_isolated": near_or_isolated, "voronoi_stems": voronoi_stems, "label_transfer": label_transfer,
    "witness_families": witness_families, "credited": credited, "fused": fused, "fusion_modes": fusion_modes, "votes_frontier": votes_frontier, "merged_blocks": merged_blocks, "instance_apexes": instance_apexes,
    "crown_diameters": crown_diameters, "point_overlaps": point_overlaps, "label_coverage": label_coverage, "overlap_match": overlap_match, "instance_cells": instance_cells, "point_density": point_density, "decimated": decimated,
    "tiles_with_halo": tiles_with_halo, "treetops": treetops, "cloud_treetops": cloud_treetops, "canopy_surface": canopy_surface, "smooth_surface": smooth_surface, "watershed_crowns": _segments("watershed"), "random_walker_crowns": _segments("random_walker"),
    "grown_crowns": _segments("region_growing"), "voronoi_crowns": _segments("voronoi"), "li_trees": li_trees, "shifted_modes": shifted_modes, "snapped": snapped, "in_footprints": in_footprints, "geojson": geojson, "monte_carlo": monte_carlo,
}

_P = ctes("points")
_S = f"{_P}, s AS (SELECT * FROM f_points WHERE point % 2 = 0), d AS (SELECT * FROM f_points WHERE point % 2 = 1)"
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
GATE = "(b.z >= 0.5 * a.z AND b.z <= a.z + 8)"
_CAND = f"c AS (SELECT a.cell, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM s a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= 4 AND {GATE})"


def walk_sql(source: str, a: str, b: str, order: str) -> str:
    """Recursive greedy walk over ranked pairs of a cell: w holds each step with `take`."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {order}) AS k FROM {source}),
w AS (SELECT cell, k, true AS take, [{a}] AS ua, [{b}] AS ub FROM o WHERE k = 1 UNION ALL
SELECT o.cell, o.k, NOT list_contains(ua, {a}) AND NOT list_contains(ub, {b}), CASE WHEN list_contains(ua, {a}) OR list_contains(ub, {b}) THEN ua ELSE list_append(ua, {a}) END,
CASE WHEN list_contains(ua, {a}) OR list_contains(ub, {b}) THEN ub ELSE list_append(ub, {b}) END FROM w JOIN o ON o.cell = w.cell AND o.k = w.k + 1)"""


_GREEDY = f"WITH RECURSIVE {_S}, {_CAND}, {walk_sql('c', 'stem', 'det', 'dist, stem, det')} SELECT o.cell, stem, det, dist FROM o JOIN w USING (cell, k) WHERE take"
_LAB = ctes("labelled")
_IOU = f"""{_LAB}, i AS (SELECT cell, pred AS pred_id, ref AS ref_id, count(*) AS inter FROM f_labelled WHERE pred IS NOT NULL AND ref IS NOT NULL GROUP BY ALL),
ps AS (SELECT cell, pred AS pred_id, count(*) AS pred_size FROM f_labelled WHERE pred IS NOT NULL GROUP BY ALL), rs AS (SELECT cell, ref AS ref_id, count(*) AS ref_size FROM f_labelled WHERE ref IS NOT NULL GROUP BY ALL),
u AS (SELECT cell, pred_id, ref_id, inter, pred_size, ref_size, pred_size + ref_size - inter AS "union", CAST(inter AS DOUBLE) / (pred_size + ref_size - inter) AS iou FROM i JOIN ps USING (cell, pred_id) JOIN rs USING (cell, ref_id)),
cv AS (SELECT r.cell, r.ref_id, coalesce(max(iou), 0) AS max_iou FROM rs r LEFT JOIN u USING (cell, ref_id) GROUP BY ALL)"""
_UM = f"g AS (SELECT cell, pred_id, ref_id, iou FROM u WHERE iou >= 0.25), {walk_sql('g', 'pred_id', 'ref_id', '-iou, pred_id, ref_id')}, m AS (SELECT o.cell, pred_id, ref_id, iou FROM o JOIN w USING (cell, k) WHERE take)"


def reach_sql(nodes: str, edges: str) -> str:
    """Recursive reachability: r holds (cell, point, cluster), the least point that edges lead to."""
    return f"""ed AS ({edges}), e2 AS (SELECT cell, a, b FROM ed UNION SELECT cell, b, a FROM ed),
rr AS (SELECT cell, point, point AS l FROM {nodes} UNION SELECT rr.cell, e2.b, rr.l FROM rr JOIN e2 ON rr.cell = e2.cell AND rr.point = e2.a),
r AS (SELECT cell, point, min(l) AS cluster FROM rr GROUP BY cell, point)"""


def fuse_sql(nodes: str) -> str:
    edge = f"SELECT a.cell, a.point AS a, b.point AS b FROM {nodes} a JOIN {nodes} b ON a.cell = b.cell AND a.point < b.point AND a.arm <> b.arm AND {D2} <= 4 AND abs(a.z - b.z) <= 5"
    return f"""{reach_sql(nodes, edge)}, fz AS (SELECT cell, cluster, arg_max(x, (z, -point)) AS x, arg_max(y, (z, -point)) AS y, max(z) AS z, count(DISTINCT arm) AS votes, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms
FROM r JOIN {nodes} USING (cell, point) GROUP BY cell, cluster)"""


_FUSED = f"WITH RECURSIVE {_P}, {fuse_sql('f_points')}"
_CLASSES = ["dominant", "codominant", "intermediate", "suppressed"]
_BANDS = {"h_short": "s.z <= 8", "h_mid": "s.z > 8 AND s.z <= 15", "h_tall": "s.z > 15"}
_TESTS = {c: f"s.crown_class = '{c}'" for c in _CLASSES} | _BANDS
_SCORE = f"""WITH RECURSIVE {_P}, pl AS (SELECT DISTINCT cell, CASE WHEN cell % 2 = 0 THEN 10.0 ELSE 6.0 END AS half FROM f_points), s AS (SELECT * FROM f_points WHERE point % 2 = 0),
d AS (SELECT p.*, abs(x) <= half AND abs(y) <= half AS core FROM f_points p JOIN pl USING (cell) WHERE point % 2 = 1 AND abs(x) <= half + 4 AND abs(y) <= half + 4), {_CAND}, {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
m AS (SELECT o.cell, stem, det FROM o JOIN w USING (cell, k) WHERE take), sm AS (SELECT s.*, d.core, d.z AS dz, m.det FROM s LEFT JOIN m ON s.cell = m.cell AND s.point = m.stem LEFT JOIN d ON d.cell = m.cell AND d.point = m.det),
l AS (SELECT cell, count(*) AS n_ref, count(det) AS TP, count_if(coalesce(core, false)) AS tp_core, round(sqrt(avg((dz - z) * (dz - z))), 9) AS height_rmse, {', '.join(f'count_if({t}) AS n_{g}, count_if({t} AND det IS NOT NULL) AS t_{g}' for g, t in _TESTS.items())} FROM sm s GROUP BY cell),
n AS (SELECT cell, count_if(core) AS n_det FROM d GROUP BY cell), fp AS (SELECT d.cell, d.x, d.y FROM d LEFT JOIN m ON d.cell = m.cell AND d.point = m.det WHERE core AND m.det IS NULL),
fk AS (SELECT cell, count_if(near) AS fp_near, count_if(NOT near) AS fp_isolated FROM (SELECT a.cell, EXISTS (SELECT 1 FROM sm b WHERE b.cell = a.cell AND b.det IS NOT NULL AND {D2} <= 16) AS near FROM fp a) GROUP BY cell),
q AS (SELECT cell, coalesce(n_ref, 0) AS n_ref, coalesce(n_det, 0) AS n_det, coalesce(TP, 0) AS TP, coalesce(tp_core, 0) AS tp_core, height_rmse, coalesce(fp_near, 0) AS fp_near, coalesce(fp_isolated, 0) AS fp_isolated,
{', '.join(f'coalesce(n_{g}, 0) AS n_{g}, CASE WHEN n_{g} > 0 THEN CAST(t_{g} AS DOUBLE) / n_{g} END AS rec_{g}' for g in _TESTS)}, CASE WHEN n_ref > 0 THEN CAST(TP AS DOUBLE) / n_ref END AS recall, CASE WHEN n_det > 0 THEN CAST(tp_core AS DOUBLE) / n_det END AS "precision"
FROM pl LEFT JOIN l USING (cell) LEFT JOIN n USING (cell) LEFT JOIN fk USING (cell)) SELECT * EXCLUDE (half), CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") END AS F1 FROM (SELECT q.*, 0 AS half FROM q)"""
_UNIT = "CAST(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
_RASTER = "rs AS (SELECT p.cell, CAST(floor((y1 - y) / 2.0) + 1 AS INT) AS \"row\", CAST(floor((x - x0) / 2.0) + 1 AS INT) AS col, max(z) AS value FROM f_points p JOIN (SELECT cell, min(x) AS x0, max(y) AS y1 FROM f_points GROUP BY cell) USING (cell) GROUP BY ALL)"
_NEXT = 'FROM rs a LEFT JOIN rs b ON a.cell = b.cell AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1'
_SHAPES = {"square": "abs(x) <= 5 AND abs(y) <= 5"}
_BLOCKS = "bl AS (SELECT cell, point, CAST(point % 4 AS INT) AS block, CAST((point // 4) % 15 AS INT) AS inst, x, y, z FROM f_points)"
def suppressed_sql(rows: str, keys: str) -> str:
    """Recursive suppression in the order of (x, y): kp holds (keys, x, y) of the points that are kept; rows have keys, radius, x and y."""
    return f"""so AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, y) AS k FROM {rows}),
sw AS (SELECT {keys}, k, true AS take, [{{'x': x, 'y': y}}] AS kept FROM so WHERE k = 1 UNION ALL
SELECT {', '.join('so.' + c.strip() for c in keys.split(','))}, so.k, len(list_filter(kept, lambda t: (t.x - so.x) * (t.x - so.x) + (t.y - so.y) * (t.y - so.y) <= so.radius * so.radius)) = 0,
CASE WHEN len(list_filter(kept, lambda t: (t.x - so.x) * (t.x - so.x) + (t.y - so.y) * (t.y - so.y) <= so.radius * so.radius)) = 0 THEN list_append(kept, {{'x': so.x, 'y': so.y}}) ELSE kept END
FROM sw JOIN so ON {' AND '.join(f'so.{c.strip()} = sw.{c.strip()}' for c in keys.split(','))} AND so.k = sw.k + 1),
kp AS (SELECT {keys}, k FROM sw WHERE take)"""


CREDIT_GRID = f"""g AS (SELECT r AS radius, f AS families FROM (VALUES (CAST(1.5 AS DOUBLE)), (CAST(2 AS DOUBLE)), (CAST(3 AS DOUBLE))) a(r), (VALUES (1), (2)) b(f)), e AS (SELECT * FROM f_points WHERE point % 5 <> 0),
n AS (SELECT a.cell, g.radius, g.families, a.point, a.x, a.y FROM e a CROSS JOIN g JOIN e b ON a.cell = b.cell AND b.arm <> a.arm AND {D2} <= g.radius * g.radius WHERE a.arm = 'chm_vwf' GROUP BY ALL HAVING count(DISTINCT b.arm) >= g.families),
{suppressed_sql('n', 'cell, radius, families')}"""

_RINGS = {"square": [(-5, -5), (5, -5), (5, 5), (-5, 5)], "kite": [(0, -9), (4, 0), (0, 9), (-4, 0)], "arrow": [(-8, -8), (0, -2), (8, -8), (0, 8)]}
_EDGES = ", ".join(f"('{n}', CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for n, r in _RINGS.items() for a, b in zip(r, r[1:] + r[:1]))
_DRAWN = "".join(f", {c} + sqrt(-2 * ln(1 - {_UNIT.format(f'(42 + draw) || {chr(39)}|{chr(39)} || point || {chr(39)}|{c}|u{chr(39)}')})) * cos(2 * pi() * {_UNIT.format(f'(42 + draw) || {chr(39)}|{chr(39)} || point || {chr(39)}|{c}|v{chr(39)}')}) * (0.5 + (point % 3) / 2) AS {c}" for c in "xy")
ORACLE_SQL = {
    "candidate_pairs": f"WITH {_S}, {_CAND} SELECT * FROM c",
    "scaled_candidates": f"WITH {_S}, t AS (SELECT *, least(5.0, greatest(2.0, (point % 13) / 2.0, CAST(point % 7 AS DOUBLE))) AS tol FROM s) SELECT a.cell, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM t a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= a.tol AND {GATE}",
    "greedy_match": _GREEDY,
    "greedy_match_rounds": _GREEDY,
    "set_agreement": f"""{_GREEDY.replace(' SELECT o.cell, stem, det, dist FROM', ', m AS (SELECT o.cell, stem, det FROM')}), ns AS (SELECT cell, count(*) AS n_left FROM s GROUP BY cell), nd AS (SELECT cell, count(*) AS n_right FROM d GROUP BY cell),
nm AS (SELECT m.cell, count(*) AS matched, round(avg(d.z - s.z), 9) AS dz_mean, round(stddev_samp(d.z - s.z), 9) AS dz_sd FROM m JOIN s ON m.cell = s.cell AND m.stem = s.point JOIN d ON m.cell = d.cell AND m.det = d.point GROUP BY m.cell)
SELECT cell, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, coalesce(n_left, 0) - coalesce(n_right, 0) AS diff, coalesce(matched, 0) AS matched, dz_mean, dz_sd, CAST(coalesce(matched, 0) AS DOUBLE) / (coalesce(n_left, 0) + coalesce(n_right, 0) - coalesce(matched, 0)) AS jaccard FROM ns FULL JOIN nd USING (cell) FULL JOIN nm USING (cell)""",
    "score_plots": _SCORE,
    "near_or_isolated": f"WITH {_S} SELECT a.cell, a.point AS det, EXISTS (SELECT 1 FROM s b WHERE b.cell = a.cell AND {D2} <= 4) AS near FROM d a",
    "voronoi_stems": f"""WITH {_S}, n AS (SELECT a.cell, a.point, arg_min(b.point, ({D2}, b.point)) AS stem, min({D2}) AS d2 FROM d a JOIN s b ON a.cell = b.cell GROUP BY ALL)
SELECT a.cell, a.point, CASE WHEN d2 <= (stem % 5) * (stem % 5) THEN stem END AS stem FROM d a LEFT JOIN n USING (cell, point)""",
    "label_transfer": f"""WITH {_S}, n AS (SELECT a.cell, a.point, arg_min(b.point % 9, ({D2}, b.point)) AS label FROM d a JOIN s b ON a.cell = b.cell AND {D2} <= 9 GROUP BY ALL) SELECT a.cell, a.point, label FROM d a LEFT JOIN n USING (cell, point)""",
    "witness_families": f"WITH {_P} SELECT a.cell, a.point, count(DISTINCT b.arm) AS families FROM f_points a LEFT JOIN f_points b ON a.cell = b.cell AND a.arm <> b.arm AND {D2} <= 4 GROUP BY ALL",
    "fused": f"{_FUSED} SELECT * FROM fz",
    "votes_frontier": f"{_FUSED} SELECT cell, CAST(k AS INT) AS k, count_if(votes >= k) AS n FROM fz CROSS JOIN range(1, 4) AS ks(k) GROUP BY cell, k",
    "merged_blocks": f"""WITH RECURSIVE {_P}, {_BLOCKS}, ap AS (SELECT cell, block, inst, arg_max(x, (z, -point)) AS x, arg_max(y, (z, -point)) AS y FROM bl WHERE inst <> 0 GROUP BY ALL), nd AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY block, inst) AS point FROM ap),
{reach_sql('nd', f'SELECT a.cell, a.point AS a, b.point AS b FROM nd a JOIN nd b ON a.cell = b.cell AND a.point < b.point AND a.block <> b.block AND {D2} <= 9')}, ids AS (SELECT cell, block, inst, CAST(dense_rank() OVER (PARTITION BY cell ORDER BY cluster) AS INT) AS global_id FROM nd JOIN r USING (cell, point))
SELECT bl.cell, bl.point, bl.block, bl.inst, global_id FROM bl JOIN ids USING (cell, block, inst)""",
    "instance_apexes": f"WITH {_P}, {_BLOCKS} SELECT cell, block, inst, arg_max(x, (z, -point)) AS x, arg_max(y, (z, -point)) AS y, max(z) AS z FROM bl WHERE inst <> 0 GROUP BY ALL",
    "point_overlaps": f"WITH {_IOU} SELECT * FROM u",
    "label_coverage": f"WITH {_IOU} SELECT * FROM cv",
    "overlap_match": f"WITH RECURSIVE {_IOU}, {_UM} SELECT * FROM m",
    "instance_cells": f"""WITH RECURSIVE {_IOU}, {_UM}, k AS (SELECT cv.cell, cv.ref_id, max_iou, m.iou AS m_iou, ['dominant', 'codominant', 'intermediate', 'suppressed'][cv.ref_id % 4 + 1] AS cls FROM cv LEFT JOIN m ON cv.cell = m.cell AND cv.ref_id = m.ref_id),
a AS (SELECT cell, count(*) AS n_ref, count(m_iou) AS TP, coalesce(sum(m_iou), 0) AS sum_iou, sum(max_iou) AS sum_maxiou, {', '.join(f"count_if(cls = '{c}') AS n_{c}, count(m_iou) FILTER (cls = '{c}') AS tp_{c}, count_if(cls = '{c}') - count(m_iou) FILTER (cls = '{c}') AS fn_{c}, round(coalesce(sum(m_iou) FILTER (cls = '{c}'), 0), 9) AS sumiou_{c}, round(coalesce(sum(max_iou) FILTER (cls = '{c}'), 0), 9) AS sumcov_{c}" for c in _CLASSES)} FROM k GROUP BY cell),
b AS (SELECT *, n_pred - TP AS FP, n_ref - TP AS FN, CASE WHEN TP > 0 THEN sum_iou / TP END AS sq, TP / (TP + 0.5 * (n_pred - TP) + 0.5 * (n_ref - TP)) AS RQ, CAST(TP AS DOUBLE) / n_pred AS "precision", CAST(TP AS DOUBLE) / n_ref AS recall FROM a JOIN (SELECT cell, count(DISTINCT pred) AS n_pred FROM f_labelled GROUP BY cell) USING (cell))
SELECT * EXCLUDE (sq, sum_iou, sum_maxiou), round(sum_iou, 9) AS sum_iou, round(sum_maxiou, 9) AS sum_maxiou, round(sq, 9) AS SQ, round(coalesce(sq * RQ, 0), 9) AS PQ, CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") END AS F1, round(sum_maxiou / n_ref, 9) AS coverage FROM b""",
    "point_density": f"WITH {_P}, c AS (SELECT cell, floor(x) AS gx, floor(y) AS gy, count(*) AS n, count_if(point % 2 = 1) AS f FROM f_points GROUP BY ALL) SELECT cell, avg(n) AS pdens, avg(f) AS frdens FROM c GROUP BY cell",
    "decimated": f"WITH {_P} SELECT cell, point FROM f_points QUALIFY row_number() OVER (PARTITION BY cell, floor(x / 5), floor(y / 5) ORDER BY {_UNIT.format(chr(39) + '0|' + chr(39) + ' || point')}, point) <= 1",
    "tiles_with_halo": f"""WITH {_P}, o AS (SELECT p.*, i, j, CAST(floor(x / 8) AS BIGINT) + i AS tx, CAST(floor(y / 8) AS BIGINT) + j AS ty FROM f_points p, range(-1, 2) AS a(i), range(-1, 2) AS b(j))
SELECT cell, point, tx, ty, i = 0 AND j = 0 AS core FROM o WHERE x >= tx * 8 - 2 AND x < (tx + 1) * 8 + 2 AND y >= ty * 8 - 2 AND y < (ty + 1) * 8 + 2""",
    "treetops": f"WITH {_P}, p AS (SELECT *, least(greatest(0.1 * z + 2, 2), 6) / 2 AS h FROM f_points WHERE z >= 2) SELECT cell, point FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.cell = b.cell AND (b.z > a.z OR (b.z = a.z AND b.point < a.point)) AND {D2} <= a.h * a.h AND {D2} <= 9)",
    "cloud_treetops": f"WITH {ctes('cloud')}, p AS (SELECT *, least(greatest(0.1 * z + 2, 2), 6) / 2 AS h, floor(x / 3) AS gx, floor(y / 3) AS gy FROM f_cloud WHERE z >= 2), v AS (SELECT p.*, gx + i AS vx, gy + j AS vy FROM p, range(-1, 2) a(i), range(-1, 2) b(j)), n AS (SELECT DISTINCT a.cell, a.point, a.x, a.y, a.z FROM p a JOIN v b ON a.cell = b.cell AND a.gx = b.vx AND a.gy = b.vy AND (b.z > a.z OR (b.z = a.z AND b.point < a.point)) AND {D2} <= a.h * a.h AND {D2} <= 9) SELECT cell, point FROM p ANTI JOIN n USING (cell, point, x, y, z)",
    "canopy_surface": f"WITH {_P}, {_RASTER} SELECT * FROM rs",
    "smooth_surface": f"""WITH {_P}, {_RASTER}, md AS (SELECT a.cell, a."row", a.col, median(b.value) FILTER (a."row" <> b."row" OR a.col <> b.col) AS m, any_value(a.value) AS v {_NEXT} GROUP BY ALL), f AS (SELECT cell, "row", col, CASE WHEN m - v > 1 THEN m ELSE v END AS value FROM md)
SELECT a.cell, a."row", a.col, round(avg(b.value), 9) AS value {_NEXT.replace('rs ', 'f ')} GROUP BY ALL""",
    "geojson": f"WITH {_P} SELECT 'Feature' AS kind, 'Point' AS shape, round(x, 7) AS lon, round(y, 7) AS lat, cell, point, arm FROM f_points WHERE abs(x) <= 10 AND abs(y) <= 10",
    "in_footprints": f"""WITH {_P}, ed AS (SELECT * FROM (VALUES {_EDGES}) v(name, x1, y1, x2, y2)), c AS (SELECT cell, point, name, count_if((y1 > y) <> (y2 > y) AND x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1) % 2 = 1 AS ins FROM f_points CROSS JOIN ed GROUP BY ALL)
SELECT cell, name, count_if(ins) AS covered FROM c GROUP BY ALL""",
    "snapped": f"""WITH {_S}, b AS (SELECT a.cell, a.point, arg_max(b.x, (b.z, -b.point)) AS bx, arg_max(b.y, (b.z, -b.point)) AS y, max(b.z) AS z FROM s a JOIN d b ON a.cell = b.cell AND {D2} <= 4 GROUP BY ALL)
SELECT s.cell, s.point, coalesce(bx, s.x) AS x, coalesce(b.y, s.y) AS y, coalesce(b.z, s.z) AS z FROM s LEFT JOIN b USING (cell, point)""",
    "credited": f"WITH RECURSIVE {_P}, {CREDIT_GRID} SELECT cell, radius, families, count(*) AS credited FROM kp GROUP BY ALL",
    "fusion_modes": f"""WITH RECURSIVE {_P}, mz AS (SELECT cell, 0.5 * max(z) AS h FROM f_points GROUP BY cell), ly AS (SELECT f_points.* FROM f_points JOIN mz USING (cell) WHERE (arm IN ('chm_vwf', 'multichm') AND z >= h) OR (arm NOT IN ('chm_vwf', 'multichm') AND z < h)),
x AS (SELECT * FROM (WITH RECURSIVE {fuse_sql('f_points')} SELECT cell, votes, z FROM fz)), y AS (SELECT * FROM (WITH RECURSIVE {fuse_sql('ly')} SELECT cell, votes, z FROM fz)),
a AS (SELECT cell, 'union' AS mode, votes, z FROM x UNION ALL SELECT cell, 'majority', votes, z FROM x WHERE votes >= 2 UNION ALL SELECT cell, 'layered', votes, z FROM y) SELECT cell, mode, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes, round(sum(z), 6) AS z FROM a GROUP BY ALL""",
    "match_in_turn": f"""WITH RECURSIVE {_S}, c AS (SELECT a.cell, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM s a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= 3),
o AS (SELECT cell, stem, list({{'det': det, 'dist': dist}} ORDER BY dist, det) AS cs, row_number() OVER (PARTITION BY cell ORDER BY stem) AS k FROM c GROUP BY cell, stem),
w AS (SELECT cell, k, stem, cs[1] AS pick, [cs[1].det] AS used FROM o WHERE k = 1 UNION ALL SELECT o.cell, o.k, o.stem, list_filter(o.cs, lambda t: NOT list_contains(used, t.det))[1], list_concat(used, list_transform(list_filter(o.cs, lambda t: NOT list_contains(used, t.det))[1:1], lambda t: t.det)) FROM w JOIN o ON o.cell = w.cell AND o.k = w.k + 1)
SELECT cell, stem, pick.det AS det, pick.dist AS dist FROM w WHERE pick IS NOT NULL""",
    "monte_carlo": f"""WITH RECURSIVE {_P}, k AS (SELECT * FROM range(1, 11) r(draw)), s AS (SELECT cell * 100 + draw AS cell, point, z{_DRAWN} FROM f_points CROSS JOIN k WHERE point % 2 = 0), d AS (SELECT cell * 100 + draw AS cell, point, x, y, z FROM f_points CROSS JOIN k WHERE point % 2 = 1), {_CAND}, {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
h AS (SELECT cell, count(*) AS tp FROM w WHERE take GROUP BY cell), n AS (SELECT cell, count(*) AS n FROM s GROUP BY cell), r AS (SELECT CAST(cell // 100 AS INT) AS cell, CAST(coalesce(tp, 0) AS DOUBLE) / n AS recall FROM n LEFT JOIN h USING (cell))
SELECT cell, count(recall) AS n, round(quantile_cont(recall, 0.05), 9) AS p05, round(quantile_cont(recall, 0.5), 9) AS p50, round(quantile_cont(recall, 0.95), 9) AS p95 FROM r GROUP BY cell""",
}
