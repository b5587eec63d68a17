"""Catalogs of tiles: levels, the curve, and what a scan leaves out."""

import numpy as np
from pyspark.sql import functions as F

from stemwork.sources import tiles


def test_curve(spark):
    rows = [(x, y) for x in (0, 1, 2, 5, 255, 65535) for y in (0, 1, 3, 77, 65535)]
    for r in spark.createDataFrame(rows, "x long, y long").withColumn("m", tiles.morton(F.col("x"), F.col("y"))).collect():
        assert r.m == sum((r.x >> k & 1) << 2 * k | (r.y >> k & 1) << 2 * k + 1 for k in range(16))


def test_levels_and_pruned_scans(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(k, float(x), float(y), k % 3) for k, (x, y) in enumerate(r.uniform(-40, 40, (3000, 2)))] + [(5000, None, 1.0, 0)]
    points = spark.createDataFrame(rows, "point long, x double, y double, other long")
    level = {p.point: p.level for p in tiles.levelled(points, 16.0, 3).collect()}
    assert len(level) == 3001 and level[5000] == 3
    for d in range(3):
        side = 16.0 / 2**d
        cells = lambda keep: {(x // side, y // side) for k, x, y, _ in rows if x is not None and keep(k)}
        some = [k for k, *_ in rows if level[k] <= d]
        assert cells(lambda k: level[k] <= d) == cells(lambda k: True) and len(some) <= sum(4**j * 36 for j in range(d + 1))
    path = str(tmp_path / "cat")
    tiles.write_tiles(points, path, 20.0, 16.0, 3)
    assert tiles.scan_tiles(spark, path).count() == 3000
    found = tiles.scan_tiles(spark, path, (-5.0, 3.0, 12.0, 19.0), 1)
    assert {(p.point, p.level) for p in found.collect()} == {(k, level[k]) for k, x, y, _ in rows if x is not None and -5 <= x <= 12 and 3 <= y <= 19 and level[k] <= 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tx" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(x,-5.0)" in plan
    assert tiles.finest_level(16.0, 2.0) == 3 and tiles.finest_level(1.0, 2.0) == 0
