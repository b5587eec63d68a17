"""Kernels over dense plots against the rules that they follow, one point at a time."""

import math

import numpy as np
import pandas as pd
import pytest

from stemwork.operators import rasters


def one_by_one(left, near, far, tall, reach):
    tops = []
    while left:
        top, mine, other, stay = left[0], [left[0]], [(left[0][0] + 100, left[0][1] + 100, 0)], []
        for q in left[1:]:
            if (q[0] - top[0]) ** 2 + (q[1] - top[1]) ** 2 > reach**2:
                stay.append(q)
                continue
            a, b = (math.sqrt(min((q[0] - m[0]) ** 2 + (q[1] - m[1]) ** 2 for m in ps)) for ps in (mine, other))
            (mine if a <= (far if q[2] > tall else near) and a <= b else other).append(q)
            if mine[-1] is not q:
                stay.append(q)
        tops.append(top)
        left = stay
    return tops


@pytest.mark.parametrize("sd,places,reach", [(6.0, 6, 10.0), (4.0, 6, 3.0), (3.0, 0, 4.0)])
def test_trees_grow_as_one_by_one(sd, places, reach):
    rng = np.random.default_rng(3)
    a = np.c_[rng.normal(0, sd, (300, 2)), rng.uniform(2, 20, 300)].round(places)
    rows = sorted(map(tuple, a.tolist()), key=lambda q: (-q[2], q[0], q[1]))
    assert [rows[k] for k in rasters.grown_tops(np.array(rows), 1.5, 2.0, 15.0, reach)] == one_by_one(rows, 1.5, 2.0, 15.0, reach)


def test_a_dense_plot_of_trees_ends(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame(np.c_[rng.normal(0, 6, (20000, 2)), rng.uniform(2, 20, 20000)], columns=list("xyz")).assign(cell=1)
    assert 50 < rasters.trees(spark.createDataFrame(rows), ["cell"]).count() < 1000  # 20,000 points one by one took minutes


def test_a_shift_meets_points_of_its_cylinder_alone():
    rng = np.random.default_rng(5)
    a = np.c_[rng.normal(0, 6, (400, 2)), rng.uniform(2, 20, 400)]
    want = np.empty_like(a)
    for k, q in enumerate(a):
        d, h = np.hypot(a[:, 0] - q[0], a[:, 1] - q[1]) / (0.4 * q[2] / 2), np.abs(a[:, 2] - q[2]) / (0.8 * q[2] / 2)
        w = np.where((d <= 1) & (h <= 1), np.exp(-5 * d**2) * (1 - h), 0)
        want[k] = (a * w[:, None]).sum(0) / w.sum()
    assert np.allclose(rasters._shifted(a, a.copy(), 0.4, 0.8), want, atol=1e-12)


def test_maxima_of_a_dense_cloud(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(np.c_[rng.uniform(0, 9, (1500, 2)).round(1), rng.integers(1, 30, 1500)])]
    half = lambda z: min(max(0.1 * z + 2, 2.0), 6.0) / 2
    a = np.array(rows)
    want = {k for k, x, y, z in rows if z >= 2 and not (((a[:, 3] > z) | ((a[:, 3] == z) & (a[:, 0] < k))) & ((a[:, 1] - x) ** 2 + (a[:, 2] - y) ** 2 <= half(z) ** 2)).any()}
    df = spark.createDataFrame(rows, "point int, x double, y double, z double").withColumn("cell", F.lit(1))
    size = F.least(F.greatest(F.col("z") * 0.1 + 2, F.lit(2.0)), F.lit(6.0))
    assert {r.point for r in rasters.local_maxima(df, ["cell"], "point", size, 6.0).collect()} == want
