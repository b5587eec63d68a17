"""Queries of the statistics family: calibration, errors, regressions, dedups, splits, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.functions import scalars as S
from stemwork.operators import calibration, selection, statistics
from stemwork.sources.tables import cached_keys, upsert

from .fixtures import ctes, fixture


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.reliability(fixture(spark, sf_dir, "scored"), ["arm"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_prob", "obs_acc")})


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibration_error(fixture(spark, sf_dir, "scored"), ["arm"]).withColumn("ece", F.round("ece", 9))


def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in (0.5, 0.7, 0.9):
        rows = calibration.precision_at_recall(fixture(spark, sf_dir, "scored"), ["arm"], t).withColumn("target", F.lit(t))
        out = rows if out is None else out.union(rows)
    return out


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "scored")
    return calibration.isotonic(rows, rows, ["arm"]).select("arm", "row", F.round("cal", 9).alias("cal"))


def out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.out_of_sample(fixture(spark, sf_dir, "scored"), ["arm"])
    return out.select("arm", "row", F.round("cal", 9).alias("cal"))


def unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.unit_range(fixture(spark, sf_dir, "scored"), ["arm"], "raw", "scaled").select("arm", "row", "scaled")


def crown_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.crown_errors(fixture(spark, sf_dir, "crowns"), [("d_eq", "ninety_cd", "d_eq vs ninety"), ("d_caliper", "max_cd", "d_caliper vs max")])
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "bias", "r2")})


def height_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.line(fixture(spark, sf_dir, "crowns"), ["algo"], "ninety_cd", "d_eq")
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


def two_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.plane(fixture(spark, sf_dir, "crowns"), ["algo"], "ninety_cd", "d_eq", "d_caliper")
    return out.withColumns({c: F.round(c, 6) for c in ("b0", "b1", "b2", "r2")})


def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.bands(fixture(spark, sf_dir, "crowns"), ["algo"], "d_eq")
    return out.withColumns({c: F.round(c, 6) for c in ("p05", "p50", "p95")})


def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.modal(fixture(spark, sf_dir, "part"), ["p_brand"], "p_size")


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events")
    users = e.select("user_id", "event_type").distinct()
    return selection.nearest_date(users, e.select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], "ts", "2024-01-15", "event_id").select("user_id", "event_type", "event_id", "value")


def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "items").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.when(F.col("l_tax") > 0.03, F.col("l_tax")).alias("tax"), F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("discount"))
    return selection.most_complete(rows, ["l_partkey"], ["tax", "discount"], "row").select("l_partkey", "row")


def height_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.height_classes(fixture(spark, sf_dir, "items"), ["l_partkey"], "l_quantity")
    return rows.groupBy("l_partkey", "height_class").agg(F.count("*").alias("n"))


def strata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split(fixture(spark, sf_dir, "plots"), ["stratum"], "plot", 42, 0.6).select("stratum", "plot", "split")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metric (in hundredths) of the held-out part by stratum over 20 seeds: least, median and greatest."""
    p = fixture(spark, sf_dir, "plots").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(20))))
    from pyspark.sql import Window as W

    w = W.partitionBy("seed", "stratum")
    place = F.row_number().over(w.orderBy(S.unit("seed", "plot"), "plot"))
    held = p.withColumn("held", place > F.ceil(0.6 * F.count("*").over(w))).where("held")
    means = held.groupBy("stratum", "seed").agg(F.avg(F.round(F.col("metric") * 100).cast("long")).alias("m"))
    return means.groupBy("stratum").agg(*[F.round(f, 2).alias(n) for f, n in ((F.min("m"), "low"), (F.median("m"), "mid"), (F.max("m"), "high"))])


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.folds(fixture(spark, sf_dir, "plots").withColumn("plot", F.col("plot") % 50)).select("plot", "fold").distinct()


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "plots").select("plot", "sigma", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = selection.jitter(rows, 7, "sigma", "plot")
    return out.select("plot", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "items")
    return rows.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count("l_quantity")).na.fill(0).withColumnsRenamed({"A": "n_a", "N": "n_n", "R": "n_r"})


def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "nation")
    k = cached_keys(F.concat(F.lit("arm__"), F.regexp_replace("n_name", " ", "_"), F.lit("__p"), F.col("n_nationkey"), F.lit("__native.csv")))
    return n.select(
        "n_nationkey", F.concat_ws("::", "n_name", "n_regionkey").alias("key"), F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]+", "_")).alias("clean"), F.upper(F.substring("n_name", 1, 2)).alias("genus"), k["plot"].alias("plot"), k["rung"].alias("rung"),
        S.functional_type("n_name").alias("type"), S.tile_name(F.col("n_nationkey") * 1234.5, F.col("n_regionkey") * 2000.0).alias("tile"), S.reasons((F.col("n_nationkey") % 2 == 0, "even"), (F.col("n_regionkey") == 1, "region")).alias("why"),
    )


def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "part")
    e, n = S.polar(F.lit(500000.0), F.lit(4100000.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 360).cast("double"))
    kind = F.when(F.col("p_size") % 2 == 0, "conifer").otherwise("broadleaf")
    d = F.col("p_size").cast("double")
    return p.select(
        "p_partkey", F.round(S.biomass(d, kind), 6).alias("agb"), F.round(e, 6).alias("e"), F.round(n, 6).alias("n"), S.match_tolerance(d, (F.col("p_partkey") % 9).cast("double")).alias("tol"), S.window_size(d, 0.1, 2.0, 5.0).alias("window"),
        S.height_band(d).alias("band"), S.resolution(d).alias("res"), S.area_resolution(d).alias("aoi_res"), S.half_even(d / 2).alias("half"), S.rung_order(F.when(F.col("p_size") < 10, F.col("p_size").cast("string")).otherwise("native")).alias("place"),
    )


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count_if(S.finite("value")).alias("n"))


QUERIES = {
    "reliability": reliability, "calibration_error": calibration_error, "precision_at_recall": precision_at_recall, "isotonic": isotonic, "out_of_sample": out_of_sample, "unit_range": unit_range, "crown_errors": crown_errors, "height_line": height_line,
    "two_predictors": two_predictors, "error_bands": error_bands, "modal_size": modal_size, "nearest_event": nearest_event, "last_write": last_write, "most_complete": most_complete, "height_classes": height_classes, "strata_split": strata_split,
    "seeds": seeds, "folds": folds, "jittered": jittered, "contingency": contingency, "scalar_strings": scalar_strings, "scalar_numbers": scalar_numbers, "json_props": json_props,
}

_SC = ctes("scored")
_CR = ctes("crowns")
_BIN = "1 + " + " + ".join(f"CASE WHEN prob >= {i} * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10))
_U = "(CAST(CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0)"
_ERR = """count(*) AS n, CASE WHEN count(*) >= 2 THEN round(sqrt(avg((d - f) * (d - f))), 6) END AS rmse, CASE WHEN count(*) >= 2 THEN round(avg(abs(d - f)), 6) END AS mae, CASE WHEN count(*) >= 2 THEN round(avg(d - f), 6) END AS bias,
CASE WHEN count(*) >= 2 AND var_pop(f) > 0 THEN round(1 - sum((d - f) * (d - f)) / (var_pop(f) * count(*)), 6) END AS r2"""
_PAR = """, s AS (SELECT arm, label, row_number() OVER (PARTITION BY arm ORDER BY prob DESC, "row") AS k, sum(label) OVER (PARTITION BY arm ORDER BY prob DESC, "row" ROWS UNBOUNDED PRECEDING) AS tp, sum(label) OVER (PARTITION BY arm) AS p FROM f_scored)"""


def _gauss(axis: str) -> str:
    u, v = (_U.format(f"'7|' || plot || '|{axis}|{k}'") for k in "uv")
    return f"round(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}) * sigma, 9)"


_PLACE = "CASE rung WHEN 'native' THEN 1 WHEN '8' THEN 2 WHEN '4' THEN 3 WHEN '2' THEN 4 WHEN '1' THEN 5 ELSE 6 END"
ORACLE_SQL = {
    "reliability": f"""WITH {_SC}, b AS (SELECT arm, {_BIN} AS bin, count(*) AS n, avg(prob) AS p, avg(label) AS o FROM f_scored GROUP BY ALL)
SELECT a.arm, CAST(k AS INT) AS bin, coalesce(n, 0) AS n, round(p, 9) AS mean_prob, round(o, 9) AS obs_acc FROM (SELECT DISTINCT arm FROM f_scored) a CROSS JOIN range(1, 11) AS ks(k) LEFT JOIN b ON a.arm = b.arm AND b.bin = k""",
    "calibration_error": f"WITH {_SC}, b AS (SELECT arm, {_BIN} AS bin, count(*) AS n, avg(prob) AS p, avg(label) AS o FROM f_scored GROUP BY ALL) SELECT arm, round(sum(n * abs(o - p)) / sum(n), 9) AS ece FROM b GROUP BY arm",
    "precision_at_recall": f"WITH {_SC}{_PAR} SELECT arm, arg_min(CAST(tp AS DOUBLE) / k, k) AS \"precision\", t AS target FROM s CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) v(t) WHERE p > 0 AND CAST(tp AS DOUBLE) / p >= t GROUP BY arm, t",
    "unit_range": f"WITH {_SC} SELECT arm, \"row\", CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 0.5 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS scaled FROM f_scored WINDOW w AS (PARTITION BY arm)",
    "isotonic": f"""WITH {_SC}, o AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY raw, "row") AS k FROM f_scored), c AS (SELECT *, sum(label) OVER (PARTITION BY arm ORDER BY k) AS s FROM o UNION ALL SELECT NULL, arm, NULL, NULL, NULL, 0, 0 FROM (SELECT DISTINCT arm FROM o)),
t AS (SELECT b.arm, b.k, max(m) AS fit FROM (SELECT a.arm, a.k AS lo, min(CAST(b.s - a.s AS DOUBLE) / (b.k - a.k)) OVER (PARTITION BY a.arm, a.k ORDER BY b.k DESC ROWS UNBOUNDED PRECEDING) AS m, b.k AS k FROM c a JOIN c b ON a.arm = b.arm AND a.k < b.k) b GROUP BY b.arm, b.k),
l AS (SELECT o.arm, o.raw, max(o.k) AS k FROM o GROUP BY o.arm, o.raw) SELECT o.arm, o."row", round(least(greatest(t.fit, 0), 1), 9) AS cal FROM o JOIN l ON o.arm = l.arm AND o.raw = l.raw JOIN t ON t.arm = l.arm AND t.k = l.k""",
    "out_of_sample": f"""WITH {_SC}, z AS (SELECT *, CAST(floor({_U.format("'42|' || " + '"row"')} * 5) AS INT) AS f FROM f_scored), tr AS (SELECT z.arm, h.f AS held, z."row", z.raw, z.label FROM z JOIN range(0, 5) h(f) ON h.f <> z.f),
o AS (SELECT *, row_number() OVER (PARTITION BY arm, held ORDER BY raw, "row") AS k FROM tr), c AS (SELECT arm, held, k, sum(label) OVER (PARTITION BY arm, held ORDER BY k) AS s FROM o UNION ALL SELECT DISTINCT arm, held, 0, 0 FROM o),
t AS (SELECT b.arm, b.held, b.k, max(m) AS fit FROM (SELECT a.arm, a.held, min(CAST(b.s - a.s AS DOUBLE) / (b.k - a.k)) OVER (PARTITION BY a.arm, a.held, a.k ORDER BY b.k DESC ROWS UNBOUNDED PRECEDING) AS m, b.k AS k FROM c a JOIN c b ON a.arm = b.arm AND a.held = b.held AND a.k < b.k) b GROUP BY ALL),
kn AS (SELECT l.arm, l.held, l.raw AS kx, t.fit AS ky FROM (SELECT arm, held, raw, max(k) AS k FROM o GROUP BY ALL) l JOIN t USING (arm, held, k)), lo AS (SELECT z.arm, z."row", max(kx) AS x0, arg_max(ky, kx) AS y0 FROM z JOIN kn ON z.arm = kn.arm AND z.f = kn.held AND kx <= z.raw GROUP BY ALL), hi AS (SELECT z.arm, z."row", min(kx) AS x1, arg_min(ky, kx) AS y1 FROM z JOIN kn ON z.arm = kn.arm AND z.f = kn.held AND kx > z.raw GROUP BY ALL)
SELECT z.arm, z."row", round(CASE WHEN count(*) OVER (PARTITION BY z.arm) < 5 THEN avg(z.label) OVER (PARTITION BY z.arm) ELSE least(greatest(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * ((raw - x0) / (x1 - x0)) END, 0), 1) END, 9) AS cal FROM z LEFT JOIN lo USING (arm, "row") LEFT JOIN hi USING (arm, "row")""",
    "crown_errors": f"""WITH {_CR}, x AS (SELECT algo, coalesce(rung, 'native') AS rung, 'd_eq vs ninety' AS definition, d_eq AS d, ninety_cd AS f FROM f_crowns UNION ALL SELECT algo, coalesce(rung, 'native'), 'd_caliper vs max', d_caliper, max_cd FROM f_crowns)
SELECT algo, rung, definition, {_ERR}, {_PLACE} AS rung_place FROM x GROUP BY algo, rung, definition""",
    "height_line": f"WITH {_CR} SELECT algo, count(*) AS n, round(regr_slope(ninety_cd, d_eq), 6) AS slope, round(regr_intercept(ninety_cd, d_eq), 6) AS intercept, round(regr_r2(ninety_cd, d_eq), 6) AS r2 FROM f_crowns GROUP BY algo",
    "two_predictors": f"""WITH {_CR}, s AS (SELECT algo, count(*) AS n, avg(ninety_cd) AS my, avg(d_eq) AS m1, avg(d_caliper) AS m2, var_pop(ninety_cd) AS yy, var_pop(d_eq) AS v1, var_pop(d_caliper) AS v2, covar_pop(d_eq, d_caliper) AS c12, covar_pop(ninety_cd, d_eq) AS c1, covar_pop(ninety_cd, d_caliper) AS c2 FROM f_crowns GROUP BY algo),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s) SELECT algo, n, round(my - b1 * m1 - b2 * m2, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round((b1 * c1 + b2 * c2) / yy, 6) AS r2 FROM b""",
    "error_bands": f"WITH {_CR} SELECT algo, count(d_eq) AS n, " + ", ".join(f"round(quantile_cont(d_eq, {q}), 6) AS {n}" for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))) + " FROM f_crowns GROUP BY algo",
    "modal_size": "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_size, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY p_brand) AS share FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1",
    "nearest_event": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), event_id) = 1",
    "last_write": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "most_complete": "SELECT l_partkey, l_orderkey * 8 + l_linenumber AS \"row\" FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_tax > 0.03 THEN 0 ELSE 1 END + CASE WHEN l_discount > 0.03 THEN 0 ELSE 1 END, l_orderkey * 8 + l_linenumber) = 1",
    "height_classes": """WITH q AS (SELECT l_partkey, count(*) AS k, quantile_cont(l_quantity, 0.33) AS a, quantile_cont(l_quantity, 0.66) AS b, quantile_cont(l_quantity, 0.9) AS c FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN k < 4 THEN NULL WHEN l_quantity <= a THEN 'suppressed' WHEN l_quantity <= b THEN 'intermediate' WHEN l_quantity <= c THEN 'codominant' ELSE 'dominant' END AS height_class, count(*) AS n FROM lineitem JOIN q USING (l_partkey) GROUP BY ALL""",
    "strata_split": f"WITH {ctes('plots')} SELECT stratum, plot, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY {_U.format(chr(39) + '42|' + chr(39) + ' || plot')}, plot) <= greatest(1, ceil(CAST(0.6 AS DOUBLE) * count(*) OVER (PARTITION BY stratum))) THEN 'calib' ELSE 'valid' END AS split FROM f_plots",
    "seeds": f"""WITH {ctes('plots')}, p AS (SELECT stratum, plot, metric, seed, row_number() OVER (PARTITION BY seed, stratum ORDER BY {_U.format("seed || '|' || plot")}, plot) AS k, count(*) OVER (PARTITION BY seed, stratum) AS n FROM f_plots CROSS JOIN range(1, 21) AS s(seed)),
m AS (SELECT stratum, seed, avg(CAST(round(metric * 100) AS BIGINT)) AS m FROM p WHERE k > ceil(CAST(0.6 AS DOUBLE) * n) GROUP BY ALL) SELECT stratum, round(min(m), 2) AS low, round(median(m), 2) AS mid, round(max(m), 2) AS high FROM m GROUP BY stratum""",
    "folds": f"WITH {ctes('plots')} SELECT DISTINCT plot % 50 AS plot, CAST(dense_rank() OVER (ORDER BY plot % 50) AS INT) AS fold FROM f_plots",
    "jittered": f"WITH {ctes('plots')} SELECT plot, {_gauss('x')} AS x, {_gauss('y')} AS y FROM f_plots",
    "contingency": "SELECT l_linestatus, count_if(l_returnflag = 'A') AS n_a, count_if(l_returnflag = 'N') AS n_n, count_if(l_returnflag = 'R') AS n_r FROM lineitem GROUP BY l_linestatus",
    "scalar_strings": """SELECT n_nationkey, n_name || '::' || n_regionkey AS key, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) AS clean, upper(substr(n_name, 1, 2)) AS genus, 'p' || n_nationkey AS plot, 'native' AS rung,
CASE WHEN upper(substr(n_name, 1, 2)) IN ('PI', 'AB', 'CA', 'PS', 'SE', 'TS', 'JU', 'CU') THEN 'conifer' ELSE 'broadleaf' END AS type, CAST(floor(n_nationkey * CAST(1234.5 AS DOUBLE) / 1000) * 1000 AS BIGINT) || '_' || CAST(floor(n_regionkey * 2000.0 / 1000) * 1000 AS BIGINT) AS tile,
CASE WHEN n_nationkey % 2 = 0 AND n_regionkey = 1 THEN 'even;region' WHEN n_nationkey % 2 = 0 THEN 'even' WHEN n_regionkey = 1 THEN 'region' ELSE '' END AS why FROM nation""",
    "scalar_numbers": """SELECT p_partkey, round(CASE WHEN p_size > 0 THEN CASE WHEN p_size % 2 = 0 THEN exp(-2.5356 + 2.4349 * ln(p_size)) ELSE exp(-2.48 + 2.4835 * ln(p_size)) END END, 6) AS agb, round(500000 + p_size * sin(radians(p_partkey % 360)), 6) AS e, round(4100000 + p_size * cos(radians(p_partkey % 360)), 6) AS n,
greatest(4.0::DOUBLE, p_size / 2.0::DOUBLE, CAST(p_partkey % 9 AS DOUBLE)) AS tol, least(greatest(0.1::DOUBLE * p_size + 2, 2), 5) AS "window", CASE WHEN p_size <= 8 THEN 'short' WHEN p_size <= 15 THEN 'mid' ELSE 'tall' END AS band, CASE WHEN p_size >= 8 THEN 0.25::DOUBLE ELSE 0.5 END AS res,
CASE WHEN p_size >= 8 THEN 0.25::DOUBLE WHEN p_size >= 4 THEN 0.5 WHEN p_size >= 1 THEN 1.0 END AS aoi_res, CAST(round_even(p_size / 2.0::DOUBLE, 0) AS BIGINT) AS half, CASE WHEN p_size >= 10 THEN 1 WHEN p_size = 8 THEN 2 WHEN p_size = 4 THEN 3 WHEN p_size = 2 THEN 4 WHEN p_size = 1 THEN 5 ELSE 6 END AS place FROM part""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count_if(isfinite(value)) AS n FROM events GROUP BY event_type",
}
