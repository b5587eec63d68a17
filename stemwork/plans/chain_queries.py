"""Whole studies as one plan each: from points to pooled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.functions.scalars import f1, rate
from stemwork.operators import clustering, matching, statistics
from stemwork.operators.keys import joined

from .fixtures import ctes, fixture
from .spatial_queries import D2, GATE, TOL, fuse_sql, sides, walk_sql

ARMS = ("chm_vwf", "deepforest", "li2012")


def height_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of matched detections' heights against their stems by crown class, and the line through them."""
    stems, dets = sides(spark, sf_dir)
    match = matching.nearest_first(stems, dets, ["cell"], TOL)
    pairs = joined(match, stems.select("cell", "stem", "crown_class", F.col("z").alias("field")), ["cell", "stem"])
    pairs = joined(pairs, dets.select("cell", "det", F.col("z").alias("lidar")), ["cell", "det"])
    errors = statistics.error_stats(pairs, ["crown_class"], "lidar", "field").withColumnRenamed("r2", "r2_identity")
    line = statistics.line(pairs, ["crown_class"], "lidar", "field").drop("n")
    out = joined(errors, line, ["crown_class"])
    return out.select("crown_class", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias", "r2_identity", "slope", "intercept", "r2")])


def fusion_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single arms and fusions by least votes, scored twice: over all cells, and over those where every configuration has detections."""
    p = fixture(spark, sf_dir, "points")
    stems = p.where("point % 7 = 0").select("cell", F.col("point").alias("stem"), "x", "y", "z")
    dets = p.where("point % 7 <> 0").select("cell", "point", "x", "y", "z", "arm")
    fused = clustering.fuse(dets, ["cell"])
    one = [dets.where(F.col("arm") == a).select("cell", F.lit(a).alias("config"), F.col("point").alias("det"), "x", "y", "z") for a in ARMS]
    votes = [fused.where(F.col("votes") >= k).select("cell", F.lit(f"votes_{k}").alias("config"), F.col("cluster").alias("det"), "x", "y", "z") for k in (1, 2)]
    every = one[0]
    for df in (*one[1:], *votes):
        every = every.unionByName(df)
    configs = [*ARMS, "votes_1", "votes_2"]
    spread = stems.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    keys = ["cell", "config"]
    match = matching.nearest_first(spread, every, keys, TOL)
    counts = joined(joined(spread.groupBy(*keys).agg(F.count("*").alias("n_ref")), every.groupBy(*keys).agg(F.count("*").alias("n_det")), keys, "full"), match.groupBy(*keys).agg(F.count("*").alias("TP")), keys, "left")
    counts = counts.na.fill(0, ["n_ref", "n_det", "TP"])
    full = counts.groupBy("cell").agg(F.count_if(F.col("n_det") > 0).alias("_k")).where(F.col("_k") == len(configs)).select("cell")
    both = counts.withColumn("scope", F.lit("all")).unionByName(joined(counts, full, ["cell"], "left_semi").withColumn("scope", F.lit("common")))
    pooled = both.groupBy("scope", "config").agg(F.count_distinct("cell").alias("n_cells"), *[F.sum(c).cast("long").alias(c) for c in ("n_ref", "n_det", "TP")])
    return pooled.withColumns({"recall": rate("TP", "n_ref"), "precision": rate("TP", "n_det")}).withColumn("F1", f1("recall", "precision"))


QUERIES = {f.__name__: f for f in (height_validation, fusion_board)}

_P = ctes("points")
_CANDIDATES = f"c AS (SELECT a.cell, a.point AS stem, b.point AS det, sqrt({D2}) AS dist FROM s a JOIN d b ON a.cell = b.cell AND sqrt({D2}) <= 4 AND {GATE})"
ORACLE_SQL = {
    "height_validation": f"""WITH RECURSIVE {_P}, s AS (SELECT * FROM f_points WHERE point % 2 = 0), d AS (SELECT * FROM f_points WHERE point % 2 = 1), {_CANDIDATES}, {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
m AS (SELECT s.crown_class, s.z AS f, d.z AS l FROM o JOIN w USING (cell, k) JOIN s ON s.cell = o.cell AND s.point = stem JOIN d ON d.cell = o.cell AND d.point = det WHERE take)
SELECT crown_class, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(sqrt(avg((l - f) * (l - f))), 6) END AS rmse, CASE WHEN count(*) >= 2 THEN round(avg(abs(l - f)), 6) END AS mae, CASE WHEN count(*) >= 2 THEN round(avg(l - f), 6) END AS bias, CASE WHEN count(*) >= 2 THEN round(1 - sum((l - f) * (l - f)) / (var_pop(f) * count(*)), 6) END AS r2_identity,
CASE WHEN count(*) >= 5 THEN round(regr_slope(l, f), 6) END AS slope, CASE WHEN count(*) >= 5 THEN round(regr_intercept(l, f), 6) END AS intercept, CASE WHEN count(*) >= 5 THEN round(regr_r2(l, f), 6) END AS r2 FROM m GROUP BY crown_class""",
    "fusion_board": f"""WITH RECURSIVE {_P}, dt AS (SELECT * FROM f_points WHERE point % 7 <> 0), {fuse_sql('dt')}, cf AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate((*ARMS, 'votes_1', 'votes_2')))}) v(n, config)),
s AS (SELECT cell * 10 + n AS cell, point, x, y, z FROM f_points, cf WHERE point % 7 = 0), d AS (SELECT dt.cell * 10 + n AS cell, point, x, y, z FROM dt JOIN cf ON arm = config UNION ALL SELECT cell * 10 + 2 + v, cluster, x, y, z FROM fz, range(1, 3) t(v) WHERE votes >= v), {_CANDIDATES}, {walk_sql('c', 'stem', 'det', 'dist, stem, det')},
m AS (SELECT o.cell, count(*) AS TP FROM o JOIN w USING (cell, k) WHERE take GROUP BY o.cell), nr AS (SELECT cell, count(*) AS n_ref FROM s GROUP BY cell), q AS (SELECT cell, count(*) AS n_det FROM d GROUP BY cell),
n AS (SELECT cell // 10 AS base, cell % 10 AS n, coalesce(n_ref, 0) AS n_ref, coalesce(n_det, 0) AS n_det, coalesce(TP, 0) AS TP FROM nr FULL JOIN q USING (cell) LEFT JOIN m USING (cell)), g AS (SELECT base FROM n GROUP BY base HAVING count_if(n_det > 0) = 5),
b AS (SELECT 'all' AS scope, * FROM n UNION ALL SELECT 'common', n.* FROM n SEMI JOIN g ON n.base = g.base), t AS (SELECT scope, config, count(DISTINCT base) AS n_cells, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(TP) AS BIGINT) AS TP FROM b JOIN cf ON b.n = cf.n GROUP BY scope, config)
SELECT *, CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") END AS F1 FROM (SELECT *, CAST(TP AS DOUBLE) / n_ref AS recall, CAST(TP AS DOUBLE) / n_det AS "precision" FROM t)""",
}
