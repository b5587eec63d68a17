"""Hulls of groups against all points, on lines, and of few places."""

import numpy as np

from stemwork.operators import hulls


def test_ring():
    assert [p[2] for p in hulls.ring([(0, 0, 1), (2, 0, 2), (1, 0, 3), (2, 2, 4), (0, 2, 5), (1, 1, 6), (0, 0, 0)])] == [0, 2, 4, 5]
    assert hulls.ring([(1, 1, 5), (1, 1, 3)]) == [(1, 1, 3)] and hulls.ring([]) == []
    assert [p[2] for p in hulls.ring([(float(k), float(k), k) for k in range(5)])] == [0, 4]


def test_hulls_of_groups(spark):
    r = np.random.default_rng(2)
    rows = [(k % 3 if k % 11 else None, k, float(x), float(y)) for k, (x, y) in enumerate(r.normal(size=(400, 2)))] + [(9, 1000, 1.0, 2.0), (9, 1001, None, 2.0)]
    d = spark.createDataFrame(rows, "cell int, point long, x double, y double").repartition(5)
    found = hulls.convex_hulls(d, ["cell"])
    got = {}
    for p in sorted(found.collect(), key=lambda p: p.corner):
        got.setdefault(p.cell, []).append((p.x, p.y, p.point))
    for cell in (0, 1, 2, None, 9):
        mine = [(x, y, k) for c, k, x, y in rows if c == cell and x is not None]
        corners = got[cell]
        assert len({p[2] for p in corners}) == len(corners)
        for a, b in zip(corners, corners[1:] + corners[:1]):
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for p in mine)
    area = {a.cell: a for a in hulls.hull_area(found, ["cell"]).collect()}
    assert area[9].area == 0 and area[0].corners == len(got[0]) and 4 < area[0].area < 40
    assert hulls.convex_hulls(d.where("false"), ["cell"]).count() == 0 and hulls.convex_hulls(d, []).count() >= 3
