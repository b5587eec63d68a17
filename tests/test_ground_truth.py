"""The reference population, false positives by class, learned routing."""

from pyspark.sql import functions as F

from stemwork.operators import ground_truth, routing, scoring


def test_population(spark):
    mapped = spark.createDataFrame([(1, "P", "a", 10.0, 90.0), (2, "P", "a", 50.0, 0.0), (3, "P", "zz", 1.0, 0.0), (4, "P", "a", 1.0, 180.0)], "stem long, plot string, ptloc string, distance double, azimuth double")
    points = spark.createDataFrame([("a", 1000.0, 2000.0, 0.3)], "ptloc string, easting double, northing double, unc double")
    stems, missing = ground_truth.located(mapped, points)
    assert [r.ptloc for r in missing.collect()] == ["zz"]
    m = [(1, 1, "2018-01-01", 9.0, "Full sun", "Live"), (1, 2, "2020-05-05", 11.0, "Full shade", "Live, broken"), (2, 3, "2021-01-01", 5.0, None, "Live"), (4, 4, "2021-02-02", 7.0, None, "Dead")]
    stems = ground_truth.measured(stems, spark.createDataFrame(m, "stem long, row long, date string, height double, position string, status string"), 2021)
    got = ground_truth.population(stems, spark.createDataFrame([("P", "tower", 1000.0, 2000.0)], "plot string, plot_type string, cx double, cy double")).collect()
    assert [(r.stem, round(r.x, 6), round(r.y, 6), r.height, r.crown_class, r.tile, r.off) for r in got] == [(1, 1010.0, 2000.0, 11.0, "suppressed", "1000_2000", 1)]


def test_vintages(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 4.0), ("z", 2.0)], "k string, v double")
    assert {r.k: r.d_v for r in ground_truth.vintages(a, b, ["k"], ["v"]).collect()} == {"x": 3.0, "y": None, "z": None}


def test_wrong_by_class(spark):
    wrong = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 9.0, 0.0), (0, 3, 99.0, 0.0)], "cell int, point int, x double, y double")
    stems = spark.createDataFrame([(0, 1, 1.0, 0.0, "dominant"), (0, 2, 15.0, 0.0, "suppressed")], "cell int, stem int, x double, y double, crown_class string")
    got = {r.crown_class: (r.fp_near, r.fp_isolated) for r in scoring.wrong_by_class(wrong, stems, stems.select("cell", "x", "y"), ["cell"]).collect()}
    assert got == {"dominant": (1, 0), "suppressed": (0, 1), None: (0, 1)}


def test_learned_policy_follows_a_clear_rule(spark):
    cells = spark.range(200).select(F.col("id").cast("string").alias("plot"), (F.col("id") % 10).cast("double").alias("f"), F.when(F.col("id") % 10 < 5, "a").otherwise("b").alias("arm"))
    got = routing.learned(cells, ["f"], ["plot"]).withColumnRenamed("arm", "chosen").join(cells, "plot")
    assert got.count() == 200 and got.where("chosen <> arm").count() == 0


def test_no_plot_is_decided_by_its_own_cells(spark):
    fold = spark.range(60).selectExpr("cast(id as string) AS plot").withColumn("k", F.pmod(F.xxhash64(F.lit(0), "plot"), F.lit(routing.MOST_FOLDS)))
    a, b = [r.plot for r in fold.where("k = 2").sort("plot").limit(2).collect()]
    rows = [(p, k, 1.0, arm) for p, arm in ((a, "x"), (b, "y")) for k in range(10)]
    cells = spark.createDataFrame(rows, "plot string, cell int, f double, arm string")
    got = {(r.plot, r.arm) for r in routing.learned(cells, ["f"], ["plot", "cell"]).collect()}
    assert got == {(a, "y"), (b, "x")}
    assert {r.arm for r in routing.learned(cells.where(F.col("plot") == a), ["f"], ["plot", "cell"]).collect()} == {None}
    assert routing.learned(cells.limit(0), ["f"], ["plot", "cell"]).count() == 0
