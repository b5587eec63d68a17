"""Triangulations, their surfaces and nearest neighbours against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemwork.operators import spatial, tin

KEYS = ["cell"]
KIND = "cell int, point long, x double, y double, z double"


def circle(p, q, r):
    (ax, ay), (bx, by) = np.subtract(q, p), np.subtract(r, p)
    d = 2 * (ax * by - ay * bx)
    if d == 0:
        return None, np.inf
    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
    c = np.array([by * a2 - ay * b2, ax * b2 - bx * a2]) / d
    return c + p, float(np.hypot(*c))


def brute(x, y, radius):
    points = np.stack([x, y], axis=1)
    out = set()
    for t in itertools.combinations(range(len(x)), 3):
        c, r = circle(*points[list(t)])
        if r <= radius and not (np.hypot(*(np.delete(points, t, axis=0) - c).T) < r * (1 - 1e-9)).any():
            out.add(t)
    return out


@pytest.mark.parametrize("n, radius", [(3, 50.0), (40, 1.0), (40, 3.0), (70, 200.0)])
def test_delaunay_equals_brute_force(n, radius):
    r = np.random.default_rng(n)
    x, y = r.uniform(0, 10, (2, n))
    own = np.ones(n, bool)
    found = tin.delaunay(x, y, own, radius)
    assert set(map(tuple, found.tolist())) == brute(x, y, radius) and len(found) == len(set(map(tuple, found.tolist())))


def test_groups_far_apart_and_lines():
    r = np.random.default_rng(4)
    x, y = np.concatenate([r.uniform(0, 3, (2, 25)), r.uniform(20, 23, (2, 25)), [[10.0], [10.0]]], axis=1)
    for radius in (1.0, 4.0, 60.0):
        assert set(map(tuple, tin.delaunay(x, y, np.ones(51, bool), radius).tolist())) == brute(x, y, radius)
    assert not len(tin.delaunay(np.arange(9.0), np.zeros(9), np.ones(9, bool), 5.0)) and not len(tin.delaunay(np.zeros(2), np.ones(2), np.ones(2, bool), 5.0))


def cloud(spark, n=300, seed=1, extent=30.0):
    r = np.random.default_rng(seed)
    rows = [(k % 2 if k % 7 else None, k, float(x), float(y), float(x / 3 + y / 5)) for k, (x, y) in enumerate(r.uniform(-extent / 2, extent / 2, (n, 2)))]
    return rows, spark.createDataFrame(rows, KIND)


def test_tiles_change_nothing(spark):
    rows, points = cloud(spark)
    want = None
    for tile in (2.5, 7.0, 100.0):
        got = {tuple(r)[:4] for r in tin.triangles(points, KEYS, 3.0, tile=tile).collect()}
        want = want or got
        assert got == want
    for cell in (0, 1, None):
        mine = [r for r in rows if r[0] == cell]
        ids = [r[1] for r in mine]
        assert {tuple(ids[i] for i in t) for t in brute(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 3.0)} == {t[1:] for t in want if t[0] == cell}


def test_grid_points_make_one_triangulation(spark):
    """Four corners of every square lie on one circle: the squares are cut once, without gaps or overlaps."""
    rows = [(0, 20 * i + j, float(i), float(j), float(i)) for i in range(20) for j in range(20)] + [(0, 1000, 3.0, 3.0, -5.0), (0, 1001, 3.0, 3.0, None), (0, 1002, None, 3.0, 1.0)]
    found = None
    for tile in (3.0, 50.0):
        tri = tin.triangles(spark.createDataFrame(rows, KIND), KEYS, 0.8, tile=tile).toPandas()
        area = ((tri.bx - tri.ax) * (tri.cy - tri.ay) - (tri.by - tri.ay) * (tri.cx - tri.ax)).abs() / 2
        assert len(tri) == 2 * 19 * 19 and abs(area - 0.5).max() < 1e-12
        got = set(zip(tri.a, tri.b, tri.c))
        assert 1000 in set(tri.a) | set(tri.b) | set(tri.c) and (found is None or got == found)
        found = got


def test_heights_of_a_plane_inside_and_out(spark):
    rows, points = cloud(spark)
    places = spark.createDataFrame([(0, 1, 0.5, 0.25, 9.0), (0, 2, 14.0, -14.9, 9.0), (0, 3, 500.0, 0.0, 9.0), (7, 4, 0.0, 0.0, 9.0), (0, 5, rows[2][2], rows[2][3], 9.0), (0, 6, None, 1.0, 9.0)], KIND)
    got = {r.point: r for r in tin.ground_heights(places, points, KEYS, 6.0, 0.7, 50.0).collect()}
    assert abs(got[1].ground - (0.5 / 3 + 0.25 / 5)) < 1e-9 and got[3].ground is None and got[4].ground is None and got[6].ground is None and len(got) == 6
    assert abs(got[5].ground - rows[2][4]) < 1e-6 and set(got[1].asDict()) == {"cell", "point", "x", "y", "z", "ground"}
    far = places.where("point = 3").withColumns({"x": F.lit(40.0), "y": F.lit(0.0)})
    near = sorted((np.hypot(40 - r[2], r[3]), r[4]) for r in rows if r[0] == 0)[:3]
    want = sum(z / d for d, z in near) / sum(1 / d for d, _ in near)
    assert abs(tin.ground_heights(far, points, KEYS, 6.0, 0.7, 50.0).first().ground - want) < 1e-9


def test_surfaces(spark):
    rows, points = cloud(spark, 400, 2, 12.0)
    tri = tin.triangles(points, KEYS, 3.0, top=True)
    got = tin.raster(tri, KEYS, 0.5, (-6.0, 6.0)).collect()
    assert len({(r.cell, r.row, r.col) for r in got}) == len(got) > 1000
    assert all(abs(r.value - ((-6 + (r.col - 0.5) / 2) / 3 + (6 - (r.row - 0.5) / 2) / 5)) < 1e-9 for r in got)
    inside = [(a, b, c) for a, b, c in brute(*(np.array([r[i] for r in rows if r[0] == 1]) for i in (2, 3)), 3.0)]
    mine = [r for r in rows if r[0] == 1]
    count = 0
    for i in range(24):
        for j in range(24):
            p = np.array([-6 + (j + 0.5) / 2, 6 - (i + 0.5) / 2])
            for t in inside:
                a, b, c = (np.array(mine[k][2:4]) for k in t)
                s = [(v - u)[0] * (p - u)[1] - (v - u)[1] * (p - u)[0] for u, v in ((a, b), (b, c), (c, a))]
                if min(s) >= 0 or max(s) <= 0:
                    count += 1
                    break
    assert count == sum(r.cell == 1 for r in got)


def test_pit_free_covers_pits_and_keeps_gaps(spark):
    """A dense crown at 15 with one low return in it, on a ground of zeros."""
    rows = [(0, 1000 + k, float(i), float(j), 0.0) for k, (i, j) in enumerate(itertools.product(range(0, 21, 2), range(0, 21, 2))) if not (6 <= i <= 14 and 6 <= j <= 14)]
    rows += [(0, k, 7 + i / 2, 7 + j / 2, 15.0 if (i, j) != (6, 6) else 1.0) for k, (i, j) in enumerate(itertools.product(range(13), range(13)))]
    points = spark.createDataFrame(rows, KIND)
    plain = {(r.row, r.col): r.value for r in tin.canopy(points, KEYS, 0.25, 6.0, (0.0, 20.0)).collect()}
    free = {(r.row, r.col): r.value for r in tin.pit_free(points, KEYS, 0.25, radius=6.0, corner=(0.0, 20.0)).collect()}
    assert set(plain) == set(free) and all(free[k] >= plain[k] - 1e-9 for k in plain)
    hole = (40, 40)  # beside (10, 10)
    assert plain[hole] < 9 and abs(free[hole] - 15) < 1e-9 and free[2, 2] == 0
    disc = tin.pit_free(points, KEYS, 0.25, subcircle=0.2, radius=6.0, corner=(0.0, 20.0))
    assert disc.count() >= len(free) and tin.pit_free(points.where("false"), KEYS, 0.5).count() == 0


@pytest.mark.parametrize("side, beyond, same", [(0.3, None, True), (50.0, None, False), (1.0, 3.0, False)])
def test_nearest_k(spark, side, beyond, same):
    rows, points = cloud(spark, 90, 6)
    rows.append((5, 1, 0.0, 0.0, 1.0))
    points = spark.createDataFrame(rows, KIND)
    got = sorted((r.cell is not None, r.cell or 0, r.point, r.place, r.r_point) for r in spatial.nearest_k(points, points, KEYS, 4, side, beyond, same).collect())
    want = []
    for a in rows:
        near = sorted((((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), b[1]) for b in rows if b[0] == a[0] and (same or b[1] != a[1]))
        near = [x for x in near if beyond is None or x[0] <= beyond * beyond][:4]
        want += [(a[0] is not None, a[0] or 0, a[1], k + 1, b) for k, (_, b) in enumerate(near)]
    assert got == sorted(want)
