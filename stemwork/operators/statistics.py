"""Error statistics, regressions, rank agreement and robustness over seeds, from sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stemwork.functions.scalars import finite, normal_rung, rate, rung_order


def error_stats(rows: DataFrame, by: list[str], det: str, fld: str) -> DataFrame:
    """(by, n, rmse, mae, bias, r2) over rows with both values; NULL for fewer than two, r2 also without variance."""
    ok = finite(det) & finite(fld)
    d, f = F.when(ok, F.col(det)), F.when(ok, F.col(fld))
    e = d - f
    sums = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("_mae"), F.avg(e).alias("_bias"), F.sum(e * e).alias("_res"), F.var_pop(f).alias("_var"))
    two = lambda c: F.when(F.col("n") >= 2, c)
    return sums.select(*by, "n", two(F.sqrt("_mse")).alias("rmse"), two(F.col("_mae")).alias("mae"), two(F.col("_bias")).alias("bias"), two(F.when(F.col("_var") > 0, 1 - rate("_res", F.col("_var") * F.col("n")))).alias("r2"))


def crown_errors(rows: DataFrame, definitions: list[tuple[str, str, str]]) -> DataFrame:
    """error_stats by algo, rung and definition (detected, field, name), with the rung's place; no rung is native."""
    if "rung" not in rows.columns:
        rows = rows.withColumn("rung", F.lit("native"))
    parts = F.array(*[F.struct(F.lit(name).alias("definition"), F.col(d).cast("double").alias("d"), F.col(f).cast("double").alias("f")) for d, f, name in definitions])
    long = rows.select("algo", normal_rung("rung").alias("rung"), F.explode(parts).alias("_p")).select("algo", "rung", "_p.definition", F.col("_p.d").alias("_d"), F.col("_p.f").alias("_f"))
    return error_stats(long, ["algo", "rung", "definition"], "_d", "_f").withColumn("rung_place", rung_order("rung"))


def line(rows: DataFrame, by: list[str], y: str, x: str, least: int = 5) -> DataFrame:
    """(by, n, slope, intercept, r2) of y on x; NULL for fewer than `least` rows."""
    ok = finite(x) & finite(y)
    a, b = F.when(ok, F.col(y).cast("double")), F.when(ok, F.col(x).cast("double"))
    sums = rows.groupBy(*by).agg(F.count(a).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return sums.select(*by, "n", enough("slope"), enough("intercept"), enough("r2"))


def plane(rows: DataFrame, by: list[str], y: str, x1: str, x2: str, least: int = 5) -> DataFrame:
    """(by, n, b0, b1, b2, r2) of y on x1 and x2, by the normal equations of centred sums."""
    ok = finite(y) & finite(x1) & finite(x2)
    a, b, c = (F.when(ok, F.col(v).cast("double")) for v in (y, x1, x2))
    s = rows.groupBy(*by).agg(
        F.count(a).alias("n"), *[F.avg(v).alias(m) for v, m in ((a, "_my"), (b, "_m1"), (c, "_m2"))], F.var_pop(a).alias("_yy"), F.var_pop(b).alias("_11"), F.var_pop(c).alias("_22"),
        F.covar_pop(b, c).alias("_12"), F.covar_pop(a, b).alias("_y1"), F.covar_pop(a, c).alias("_y2"),
    )
    det = F.col("_11") * F.col("_22") - F.col("_12") * F.col("_12")
    s = s.withColumns({"b1": rate(F.col("_y1") * F.col("_22") - F.col("_y2") * F.col("_12"), det), "b2": rate(F.col("_y2") * F.col("_11") - F.col("_y1") * F.col("_12"), det)})
    s = s.withColumns({"b0": F.col("_my") - F.col("b1") * F.col("_m1") - F.col("b2") * F.col("_m2"), "r2": rate(F.col("b1") * F.col("_y1") + F.col("b2") * F.col("_y2"), "_yy")})
    return s.select(*by, "n", *[F.when(F.col("n") >= least, F.col(v)).alias(v) for v in ("b0", "b1", "b2", "r2")])


def ranks(rows: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with rank_<value>, 1 the largest, equal values the smallest rank; NULL values last."""
    for v in values:
        rows = rows.withColumn(f"rank_{v}", F.rank().over(W.partitionBy(*(by or [])).orderBy(F.col(v).desc_nulls_last())))
    return rows


def rank_agreement(rows: DataFrame, a: str, b: str, by: list[str], item: str) -> DataFrame:
    """(by, n, tau, rho): Kendall's tau-b and Spearman's rho of two values over items; NULL for fewer than 3."""
    some = rows.where(finite(a) & finite(b)).select(*by, F.col(item).alias("_i"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    other = some.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[F.col(c).alias(f"_o{c}") for c in ("_i", "_a", "_b")])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    pairs = some.join(other, [*on, F.col("_i") < F.col("_o_i")])
    x, y = F.signum(F.col("_a") - F.col("_o_a")), F.signum(F.col("_b") - F.col("_o_b"))
    tau = pairs.groupBy(*by).agg(F.sum(x * y).alias("_s"), F.sum(F.abs(x)).alias("_x"), F.sum(F.abs(y)).alias("_y"))
    mean = lambda v: F.rank().over(W.partitionBy(*by).orderBy(v)) + (F.count("*").over(W.partitionBy(*by, v)) - 1) / 2.0
    rho = some.withColumns({"_ra": mean("_a"), "_rb": mean("_b")}).groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_ra", "_rb").alias("_c"), F.var_pop("_ra").alias("_va"), F.var_pop("_rb").alias("_vb"))
    out = rho.join(tau, by, "left")
    enough = lambda c: F.when(F.col("n") >= 3, c)
    return out.select(*by, "n", enough(rate("_s", F.sqrt(F.col("_x") * F.col("_y")))).alias("tau"), enough(rate("_c", F.sqrt(F.col("_va") * F.col("_vb")))).alias("rho"))


def bands(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, p05, p50, p95): exact quantiles, linear between values."""
    q = lambda p: F.percentile(F.col(value), p)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def win_rate(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, wins): share of rows in which a is above b."""
    d = F.col(a) - F.col(b)
    return rows.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((d > 0).cast("double")).alias("wins"))


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, share): the commonest value, the smallest of equally common ones."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), value))
    share = rate("n", F.sum("n").over(W.partitionBy(*by)))
    return counts.withColumns({"share": share, "_r": first}).where("_r = 1").drop("_r")


def density(points: DataFrame, keys: list[str], first: str | None = None) -> DataFrame:
    """(keys, pdens, frdens): mean number of points, and of first returns, of the 1 m cells that hold points."""
    fr = F.count_if(F.col(first) == 1) if first else F.count("*")
    cells = points.groupBy(*keys, F.floor("x").alias("_x"), F.floor("y").alias("_y")).agg(F.count("*").alias("_n"), fr.alias("_f"))
    return cells.groupBy(*keys).agg(F.avg("_n").alias("pdens"), F.avg("_f").alias("frdens"))


def structure(points: DataFrame, keys: list[str], floor: float = 2.0, least: int = 20) -> DataFrame:
    """(keys, cover, gap, mean_ht, height_cv): shares of points above and below, heights of those above; NULL for few."""
    high = F.when(F.col("z") > floor, F.col("z"))
    s = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(high).alias("_h"), F.avg(high).alias("_m"), F.stddev(high).alias("_s"))
    some = lambda c: F.when(F.col("_h") >= least, c)
    return s.select(*keys, rate("_h", "_n").alias("cover"), (1 - rate("_h", "_n")).alias("gap"), some(F.col("_m")).alias("mean_ht"), some(rate("_s", "_m")).alias("height_cv"))


def rumple(raster: DataFrame, keys: list[str], res: float) -> DataFrame:
    """(keys, rumple): area of a surface (keys, row, col, value) over the area below it.

    Each 2x2 square of cells is two triangles between their centres; squares that lack a cell don't count.
    """
    near = lambda i, j: raster.select(*[F.col(k).alias(f"_{i}{j}_{n}") for n, k in enumerate(keys)], (F.col("row") - i).alias(f"_r{i}{j}"), (F.col("col") - j).alias(f"_c{i}{j}"), F.col("value").alias(f"_v{i}{j}"))
    rows = raster
    for i, j in ((0, 1), (1, 0), (1, 1)):
        on = [F.col(k).eqNullSafe(F.col(f"_{i}{j}_{n}")) for n, k in enumerate(keys)]
        rows = rows.join(near(i, j), [*on, F.col("row") == F.col(f"_r{i}{j}"), F.col("col") == F.col(f"_c{i}{j}")])
    a, b, c, d = F.col("value"), F.col("_v01"), F.col("_v10"), F.col("_v11")
    half = lambda u, v: 0.5 * res * F.sqrt(u * u + v * v + res * res)
    area = half(b - a, c - a) + half(d - b, d - c)
    return rows.groupBy(*keys).agg((F.sum(area) / (F.count("*") * (res * res))).alias("rumple"))
