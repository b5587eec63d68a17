"""Hand-computed pools, guards and choices."""

import math

from pyspark.sql import functions as F

from stemwork.functions import scalars as S
from stemwork.operators import pooling, selection, statistics

CELL = "site string, plot string, rung string, detector string, n_ref long, n_det long, TP long, tp_core long"


def cells(spark, rows, more=""):
    return spark.createDataFrame(rows, CELL + more)


def test_pool_sums_counts_and_never_averages(spark):
    got = pooling.pool(cells(spark, [("s", "p1", "8", "a", 10, 6, 5, 4), ("s", "p2", "8", "a", 90, 50, 45, 40)]), ["detector"]).first()
    assert (got.n_plots, got.recall) == (2, 0.5)
    assert math.isclose(got.precision, 44 / 56)


def test_pool_without_detections_has_no_precision(spark):
    got = pooling.pool(cells(spark, [("s", "p1", "8", "a", 10, 0, 0, 0)]), ["detector"]).first()
    assert (got.recall, got.precision, got.F1) == (0.0, None, None)


def test_credited_precision_has_a_floor(spark):
    rows = [("s", "p1", "8", "a", 9, 10, 6, 6, 2), ("s", "p2", "8", "a", 9, 5, 3, 3, 1)]
    got = pooling.pool(cells(spark, rows, ", fp_credited long"), ["detector"]).first()
    assert math.isclose(got.precision, 9 / 15) and math.isclose(got.precision_cred, 9 / 12)
    got = pooling.pool(cells(spark, [("s", "p1", "8", "a", 9, 10, 6, 6, 99)], ", fp_credited long"), ["detector"]).first()
    assert got.precision_cred == 1.0


def test_classes_come_back_from_rates_with_halves_to_even(spark):
    more = "".join(f", n_{c} long, rec_{c} double" for c in S.CLASSES)
    got = pooling.pool(cells(spark, [("s", "p", "8", "a", 9, 5, 3, 3, 5, 0.5, 2, 1.0, 0, None, 2, 0.5)], more), ["detector"]).first()
    assert (got.rec_dominant, got.rec_codominant, got.rec_intermediate, got.n_understory, got.rec_understory) == (2 / 5, 1.0, None, 2, 0.5)


def test_guard_keeps_cells_that_all_arms_have(spark):
    rows = [("s", "p1", "8", d, 1, 1, 1, 1) for d in ("ams3d", "foo")] + [("s", "p2", "8", d, 1, 1, 1, 1) for d in ("ams3d", "li2012", "foo")]
    kept, dropped = pooling.equal_set_guard(cells(spark, rows), ["ams3d", "li2012"])
    assert {(r.plot, r.detector) for r in kept.collect()} == {("p2", "ams3d"), ("p2", "li2012"), ("p2", "foo")}
    assert [r.plot for r in dropped.collect()] == ["p1"]


def test_pairs_of_cells(spark):
    rows = [("s", p, "2", "mc", 1, 1, 1, 1) for p in ("p1", "p2", "p3")] + [("s", p, r, "cv", 1, 1, 1, 1) for p, r in (("p1", "2"), ("p2", "2"), ("p3", "1"))]
    kept, dropped = pooling.pair_cells(cells(spark, rows), "mc", "cv")
    assert {r.plot for r in kept.collect()} == {"p1", "p2"} and dropped.first().n_drop == 2


def test_oracle_takes_the_first_of_equal_arms_and_drops_empty_cells(spark):
    rows = [(1, "A", "x", 0.5), (2, "A", "y", 0.8), (3, "B", "x", 0.6), (4, "B", "y", 0.6), (5, "C", "x", None), (6, "C", "y", float("nan"))]
    df = spark.createDataFrame(rows, "row long, plot string, arm string, F1 double")
    assert {(r.plot, r.arm) for r in selection.oracle(df, "F1", ["plot"], "row").collect()} == {("A", "y"), ("B", "x")}


def test_split_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(4, 8)] + [("c", 9)], "stratum string, plot long")
    got = selection.split(df, ["stratum"], "plot", 1, 0.5)
    assert {(r.stratum, r.split): r["count"] for r in got.groupBy("stratum", "split").count().collect()} == {("a", "calib"): 2, ("a", "valid"): 2, ("b", "calib"): 2, ("b", "valid"): 2, ("c", "calib"): 1}
    assert sorted(got.collect()) == sorted(selection.split(df.repartition(7), ["stratum"], "plot", 1, 0.5).collect())


def test_mix_class(spark):
    df = spark.createDataFrame([(10, 0), (10, 3), (10, 2)], "n_over long, n_under long")
    assert [r.crown_mix for r in selection.mix_class(df).collect()] == ["overstory", "understory", "overstory"]


def test_error_stats(spark):
    df = spark.createDataFrame([("a", 5.0, 5.0), ("a", 6.0, 5.0), ("a", 7.0, 5.0), ("a", None, 5.0), ("b", 1.0, 1.0)], "g string, d double, f double")
    got = {r.g: r for r in statistics.error_stats(df, ["g"], "d", "f").collect()}
    assert math.isclose(got["a"].rmse, math.sqrt(5 / 3)) and got["a"].bias == 1.0 and got["a"].r2 is None
    assert (got["b"].n, got["b"].rmse) == (1, None)


def test_plane_fits_exactly(spark):
    df = spark.createDataFrame([("g", float(1 + 2 * a + 3 * b), float(a), float(b)) for a in range(4) for b in range(3)], "g string, y double, a double, b double")
    got = statistics.plane(df, ["g"], "y", "a", "b").first()
    assert [round(v, 9) for v in (got.b0, got.b1, got.b2, got.r2)] == [1, 2, 3, 1]


def test_scalars(spark):
    df = spark.createDataFrame([("PIPO", 30.0, 8.0, 10.0, 0.5), ("QUKE", None, 15.0, 2.0, 0.3), ("", 1.0, 15.1, None, 6.0), ("CANO9", 1.0, None, None, None)], "t string, d double, h double, crown double, unc double")
    got = df.select(S.functional_type("t").alias("k"), S.height_band("h").alias("b"), S.match_tolerance("crown", "unc").alias("tol"), S.biomass("d", S.functional_type("t")).alias("m")).collect()
    assert [r.k for r in got] == ["conifer", "broadleaf", None, "broadleaf"]
    assert [r.b for r in got] == ["short", "mid", "tall", None]
    assert [r.tol for r in got] == [5.0, 4.0, 6.0, 4.0]
    assert round(got[0].m) == 313 and got[1].m is None


def test_utm(spark):
    lon, lat = S.utm_to_wgs84(F.lit(500000.0), F.lit(4649776.22), F.lit(11))
    got = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), S.utm_epsg(F.lit("11N")).alias("a"), S.utm_epsg(F.lit("55S")).alias("b"), S.utm_epsg(F.lit("x")).alias("c")).first()
    assert abs(got.lon + 117) < 1e-9 and abs(got.lat - 42) < 1e-5 and (got.a, got.b, got.c) == (32611, 32755, None)


def test_cells_are_pooled_once_for_their_site_and_for_all(spark):
    from pyspark.sql import functions as F

    from stemwork.operators import pooling

    cells = spark.createDataFrame([("a", "1", "x", "A", 4, 2, 3, 1), ("a", "1", "x", "A", 6, 3, 3, 2), ("a", "2", "x", "A", 5, 5, 5, 4), ("b", "1", "x", "A", 8, 1, 0, 0), (None, "1", "x", "B", 2, 1, 1, 1)], "site string, plot string, rung string, detector string, n_ref int, TP int, n_det int, tp_core int")
    got = pooling.pool_with_all(cells, ["detector"])
    want = pooling.pool(cells.withColumn("scope", F.explode(F.array("site", F.lit("ALL")))), ["scope", "detector"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r.scope, r.n_plots) for r in got.where("detector = 'A'").collect()} == {("a", 2), ("b", 1), ("ALL", 3)}
