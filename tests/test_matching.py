"""Matching, spatial joins, overlaps, fusion: hand-computed cases and rules that hold for random ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemwork.operators import clustering, matching, rasters, scoring, spatial


def stems(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "cell int, stem int, x double, y double, z double")


def dets(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "cell int, det int, x double, y double, z double")


def pairs(df):
    return {(r.stem, r.det) for r in df.collect()}


def test_greedy_takes_the_nearest_pair_and_optimal_the_most_pairs(spark):
    c = spatial.candidates(stems(spark, [(1, 0.0, 0.0, None), (2, 1.0, 0.0, None)]), dets(spark, [(1, 0.6, 0.0, 1.0), (2, 1.8, 0.0, 1.0)]), ["cell"], 1.0)
    assert pairs(matching.greedy(c, ["cell"])) == {(2, 1)}
    assert pairs(matching.optimal(c, ["cell"])) == {(1, 1), (2, 2)}


def test_height_gate(spark):
    c = spatial.candidates(stems(spark, [(1, 0.0, 0.0, 20.0)]), dets(spark, [(1, 0.5, 0.0, 2.0), (2, 1.0, 0.0, 18.0)]), ["cell"], 3.0)
    assert pairs(matching.greedy(c, ["cell"])) == {(1, 2)}


def test_soft_heights(spark):
    s = stems(spark, [(1, 0.0, 0.0, 10.0)])
    assert pairs(matching.soft_candidates(s, dets(spark, [(1, 0.3, 0.0, 50.0)]), ["cell"])) == set()
    assert pairs(matching.soft_candidates(s, dets(spark, [(1, 0.3, 0.0, 4.5)]), ["cell"])) == {(1, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_random_cells(spark, seed):
    rng = np.random.default_rng(seed)
    place = lambda n: [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(np.round(rng.uniform(0, 12, (n, 3)), 1))]
    a, b = place(30), place(25)
    c = spatial.candidates(stems(spark, a), dets(spark, b), ["cell"], 3.0).cache()
    want = [(d, i, j) for i, x, y, z in a for j, u, v, w in b if (d := float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)))) <= 3.0 and 0.5 * z <= w <= z + 8]
    assert pairs(c) == {(i, j) for _, i, j in want}
    taken, left, right = set(), set(), set()
    for _, i, j in sorted(want):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            taken.add((i, j))
    assert pairs(matching.greedy(c, ["cell"])) == pairs(matching.greedy_rounds(c, ["cell"])) == taken
    best = pairs(matching.optimal(c, ["cell"]))
    assert len(best) >= len(taken) and len({i for i, _ in best}) == len({j for _, j in best}) == len(best)
    assert pairs(matching.greedy(c.repartition(7), ["cell"])) == taken


def test_assignment_is_least():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        m = rng.uniform(0, 10, (n, n))
        got = matching.assignment(m)
        assert np.isclose(m[np.arange(n), got].sum(), min(m[np.arange(n), p].sum() for p in map(list, permutations(range(n)))))


def test_nearest_then_gate(spark):
    s = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0), (0, 2, 4.0, 0.0, 9.0)], "cell int, stem int, x double, y double, radius double")
    p = spark.createDataFrame([(0, 1, 0.5, 0.0), (0, 2, 1.5, 0.0), (0, 3, 3.0, 0.0)], "cell int, point int, x double, y double")
    assert {r.point: r.stem for r in spatial.assign(p, s, ["cell"], 9.0).collect()} == {1: 1, 2: None, 3: 2}


def test_witnesses(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 10.0, 0.0), (0, 3, 20.0, 0.0)], "cell int, point int, x double, y double")
    w = spark.createDataFrame([(0, 0.5, 0.0, "chm"), (0, -0.5, 0.0, "pc"), (0, 10.3, 0.0, "rgb"), (0, 10.8, 0.0, "rgb")], "cell int, x double, y double, fam string")
    assert {r.point: r.families for r in spatial.witnesses(p, w, 2.0, ["cell"], "point").collect()} == {1: 2, 2: 1, 3: 0}


def test_overlaps(spark):
    pred, ref = [1, 1, 1, 1, 2, 2, None, None, None, None], [1, 1, 1, None, 2, 2, 2, None, None, None]
    df = spark.createDataFrame([(0, p, r) for p, r in zip(pred, ref)], "cell int, pred int, ref int")
    io = scoring.point_set_iou(df, ["cell"])
    assert {(r.pred_id, r.ref_id): r.iou for r in io.collect()} == {(1, 1): 0.75, (2, 2): 2 / 3}
    df = spark.createDataFrame([(0, p, r) for p, r in zip([1, 1, 2, 2, None], [1, 1, 2, None, 3])], "cell int, pred int, ref int")
    assert {r.ref_id: r.max_iou for r in scoring.coverage(df, ["cell"]).collect()} == {1: 1.0, 2: 0.5, 3: 0.0}
    io = spark.createDataFrame([(0, 2, 1, 0.9), (0, 2, 2, 0.6), (0, 1, 2, 0.55), (0, 3, 3, 0.4)], "cell int, pred_id int, ref_id int, iou double")
    assert {(r.pred_id, r.ref_id) for r in matching.iou_match(io, ["cell"]).collect()} == {(2, 1), (1, 2)}


def test_panoptic(spark):
    got = scoring.panoptic(spark.createDataFrame([(2, 3, 2, 0.75 + 2 / 3)], "n_pred long, n_ref long, TP long, sum_iou double")).first()
    assert np.isclose(got.SQ, 17 / 24) and np.isclose(got.RQ, 0.8)


def test_fusion(spark):
    rows = [("chm_vwf", 0.0, 0.0, 20.0), ("sat", 0.1, 0.0, 20.0), ("li2012", 0.0, 0.0, 5.0), ("chm_vwf", 50.0, 50.0, 18.0), ("sat", 50.1, 50.0, 18.0)]
    df = spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "cell int, point int, arm string, x double, y double, z double")
    got = sorted(clustering.fuse(df, ["cell"]).collect(), key=lambda r: r.cluster)
    assert [r.votes for r in got] == [2, 1, 2] and got[0].arms == "chm_vwf,sat"
    modes = {r["mode"]: r["count"] for r in clustering.operating_points(df, ["cell"], 3).groupBy("mode").count().collect()}
    assert modes == {"union": 3, "majority": 2, "layered": 3}


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(0, k) for k in range(40)], "cell int, point int")
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(39) if k != 20], "cell int, a int, b int")
    assert {r.point: r.cluster for r in clustering.components(nodes, edges, ["cell"]).collect()} == {k: 0 if k <= 20 else 21 for k in range(40)}


def test_suppression(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.5, 0.0), (0, 2.5, 0.0), (0, 9.0, 9.0)], "cell int, x double, y double")
    assert sorted((r.x, r.y) for r in matching.suppress(df, ["cell"], 2.0).collect()) == [(0.0, 0.0), (2.5, 0.0), (9.0, 9.0)]


def test_raster_kernels():
    value = np.array([[9, 5, 1, 6, 8], [7, 4, 1, 5, 7], [1, 1, 1, 1, 1.0]])
    seeds = np.zeros(value.shape, int)
    seeds[0, 0], seeds[0, 4] = 1, 2
    want = np.array([[1, 1, 0, 2, 2], [1, 1, 0, 2, 2], [0] * 5])
    for name in ("watershed", "random_walker"):
        assert (rasters.METHODS[name](value, seeds, 2.0) == want).all(), name
    want[1, 1] = 0  # 4 is not above 0.45 * 9
    assert (rasters.grow(value, seeds, 2.0) == want).all()
    assert (rasters.flood(value, seeds * 0, 2.0) == 0).all()


def test_diameters(spark):
    square = [(0, 1, float(x), float(y)) for x in (0, 2) for y in (0, 2)] + [(0, 1, 1.0, 1.0), (0, 2, 0.0, 0.0)]
    got = {r.inst: r for r in rasters.diameters(spark.createDataFrame(square, "cell int, inst int, x double, y double"), ["cell"]).collect()}
    assert np.isclose(got[1].d_eq, 2 * np.sqrt(4 / np.pi)) and np.isclose(got[1].d_caliper, np.sqrt(8)) and got[2].d_eq is None


def test_local_maxima_and_halo(spark):
    p = spark.createDataFrame([(0, 1, 1.0, 1.0, 9.0), (0, 2, 2.0, 1.0, 8.0), (0, 3, 7.9, 1.0, 7.0), (0, 4, 1.0, 1.0, 9.0)], "cell int, point int, x double, y double, z double")
    assert {r.point for r in rasters.local_maxima(p, ["cell"], "point", F.lit(4.0), 4.0).collect()} == {1, 3}
    assert sorted((r.tx, r.core) for r in spatial.halo(p.where("point = 3"), 8.0, 0.5).collect() if r.ty == 0) == [(0, True), (1, False)]


def test_null_cells_are_cells(spark):
    from stemwork.operators import matching, scoring

    points = spark.createDataFrame([(None, 1, 1), (None, 1, 1), (None, 2, 1), (5, 1, 2)], "cell int, pred int, ref int")
    got = {(r.cell, r.pred_id, r.ref_id): r.iou for r in scoring.point_set_iou(points, ["cell"]).collect()}
    assert got == {(None, 1, 1): 2 / 3, (None, 2, 1): 1 / 3, (5, 1, 2): 1.0}
    assert {(r.cell, r.max_iou) for r in scoring.coverage(points, ["cell"]).collect()} == {(None, 2 / 3), (5, 1.0)}
    left = spark.createDataFrame([(None, 1, 3.0), (None, 2, 4.0)], "cell int, stem int, z double")
    right = spark.createDataFrame([(None, 7, 5.0)], "cell int, det int, z double")
    match = spark.createDataFrame([(None, 1, 7)], "cell int, stem int, det int")
    r = matching.agreement(match, left, right, ["cell"]).first()
    assert (r.cell, r.n_left, r.n_right, r["diff"], r.matched, r.dz_mean, r.dz_sd) == (None, 2, 1, 1, 1, 2.0, None)


def test_random_walker_against_a_dense_solution():
    import numpy as np

    from stemwork.operators import rasters

    rng = np.random.default_rng(4)
    value = rng.uniform(3, 20, (9, 8))
    value[4, 2:5] = 1.0  # below the floor
    label = np.zeros((9, 8), int)
    for k, (r, c) in enumerate([(0, 0), (8, 7), (2, 6), (7, 1)], 1):
        label[r, c] = k
    for beta in (1.0, 90.0):
        got = rasters.walk(value, label, 2.0, beta)
        cells = [tuple(x) for x in np.argwhere(value >= 2)]
        at = {x: i for i, x in enumerate(cells)}
        v = np.array([value[x] for x in cells])
        v = (v - v.min()) / np.ptp(v)
        lap = np.eye(len(cells)) * 1e-6
        for (r, c), i in at.items():
            for x in ((r + 1, c), (r, c + 1)):
                if x in at:
                    j, w = at[x], np.exp(-beta * (v[i] - v[at[x]]) ** 2) + 1e-6
                    lap[[i, j], [i, j]] += w
                    lap[i, j] -= w
                    lap[j, i] -= w
        seeds = np.array([label[x] for x in cells])
        free = seeds == 0
        chance = np.stack([np.linalg.solve(lap[np.ix_(free, free)], -lap[np.ix_(free, ~free)] @ (seeds[~free] == k)) for k in range(1, 5)])
        want = seeds.copy()
        want[free] = chance.argmax(axis=0) + 1
        assert [got[x] for x in cells] == want.tolist() and (got[value < 2] == 0).all()


def test_bands_of_distance_take_what_all_candidates_do(spark):
    rng = np.random.default_rng(7)
    place = lambda n: [(k % 2, k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(np.c_[rng.normal(0, 2.5, (n, 2)), rng.uniform(5, 20, n)])]
    a, b = (spark.createDataFrame(place(n), f"cell int, {c} int, x double, y double, z double").cache() for n, c in ((500, "stem"), (450, "det")))
    every, met = spatial.candidates(a, b, ["cell"], 4.0), []

    def counted(pairs, keys):
        met.append(pairs.count())
        return matching.greedy(pairs, keys)

    want = {tuple(r) for r in matching.greedy(every, ["cell"]).collect()}
    assert {tuple(r) for r in matching.nearest_first(a, b, ["cell"], method=counted, least=0).collect()} == want
    assert len(met) > 2 and sum(met) < every.count() / 5
    assert {tuple(r) for r in matching.nearest_first(a, b, ["cell"], method=matching.greedy_rounds, least=0).collect()} == want
    # tolerances of their own, and points on each other
    c = a.withColumn("tol", F.col("stem") % 4 + 0.5).unionByName(a.withColumns({"stem": F.col("stem") + 1000, "tol": F.lit(1.0)}))
    want = {tuple(r) for r in matching.greedy(spatial.candidates(c, b, ["cell"], "tol", most=4.0), ["cell"]).collect()}
    assert {tuple(r) for r in matching.nearest_first(c, b, ["cell"], "tol", most=4.0, least=0).collect()} == want


def test_points_on_each_other_meet_as_places(spark, monkeypatch):
    rng = np.random.default_rng(3)
    spots = np.round(rng.uniform(0, 6, (2, 12, 2)))  # whole metres: many distances are equal
    high = rng.choice([8.0, 12.0, 19.0], (2, 12))
    draw = lambda side, n: [(None if s % 3 == 0 else s % 3, k, *map(float, spots[side, s]), float(high[side, s])) for k, s in enumerate(rng.integers(0, 12, n).tolist())]
    a, b = (spark.createDataFrame(draw(k, n), f"cell int, {c} int, x double, y double, z double").cache() for k, n, c in ((0, 600, "stem"), (1, 500, "det")))
    c = a.withColumns({"tol": F.col("stem") % 4 + 0.5})
    whole, met = spatial.candidates, []
    want = [{tuple(r) for r in matching.greedy(whole(s, b, ["cell"], t, most=4.0), ["cell"]).collect()} for s, t in ((a, 4.0), (c, "tol"))]

    def counted(*args, **more):
        pairs = whole(*args, **more)
        met.append(pairs.count())
        return pairs

    every = whole(a, b, ["cell"], 4.0).count()
    monkeypatch.setattr(spatial, "candidates", counted)
    assert {tuple(r) for r in matching.nearest_first(a, b, ["cell"], least=0).collect()} == want[0]
    assert 0 < sum(met) < every / 20 and any(r[0] is None for r in want[0])
    assert {tuple(r) for r in matching.nearest_first(c, b, ["cell"], "tol", most=4.0, least=0).collect()} == want[1]


def test_few_crowded_places_among_points_apart_meet_as_places(spark, monkeypatch):
    rng = np.random.default_rng(9)
    own = lambda n: rng.uniform(-20, 20, (n, 2)).tolist()
    crowd = lambda n: [[float(k % 3), 1.0] for k in range(n)]
    rows = lambda n, m: [(0, k, x, y, 10.0) for k, (x, y) in enumerate(own(n) + crowd(m))]
    a, b = (spark.createDataFrame(rows(300, m), f"cell int, {c} int, x double, y double, z double").cache() for m, c in ((120, "stem"), (90, "det")))
    whole, met = spatial.candidates, []
    want = {tuple(r) for r in matching.greedy(whole(a, b, ["cell"], 4.0), ["cell"]).collect()}

    def counted(*args, **more):
        pairs = whole(*args, **more)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "candidates", counted)
    assert {tuple(r) for r in matching.nearest_first(a, b, ["cell"], least=0).collect()} == want
    assert 0 < met[0] < 120 * 90 / 4  # pairs of points on one place


def test_points_of_one_position_and_many_heights_meet_as_places(spark, monkeypatch):
    rng = np.random.default_rng(21)
    spots = np.round(rng.uniform(0, 3, (8, 2)))  # of which some are equal, as many distances are

    def rows(n):
        high = [None if v < 0.5 else float("nan") if v > 29.5 else float(v) for v in rng.uniform(0, 30, n).round(1)]
        return [(k % 2, k, float(x), float(y), z) for k, ((x, y), z) in enumerate(zip(spots[rng.integers(0, 8, n)], high))] + [(0, n + k, *rng.uniform(0, 3, 2).tolist(), 9.0) for k in range(30)]

    a, b = (spark.createDataFrame(rows(n), f"cell int, {c} int, x double, y double, z double").cache() for n, c in ((400, "stem"), (300, "det")))
    c = a.withColumns({"tol": F.col("stem") % 3 + 0.5, "most_up": F.when(F.col("stem") % 7 > 0, F.col("stem") % 5 * 3.0)})
    whole, met = spatial.candidates, []
    cases = [(a, 4.0, 8.0, True), (a, 2.0, 8.0, False), (c, "tol", 2.0, True), (c, 3.0, "most_up", True)]
    want = [{tuple(r) for r in matching.greedy(whole(s, b, ["cell"], tol, up, 4.0, gate), ["cell"]).collect()} for s, tol, up, gate in cases]
    every = whole(a, b, ["cell"], 4.0).count()

    def counted(*args, **more):
        pairs = whole(*args, **more)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "candidates", counted)
    for (s, tol, up, gate), taken in zip(cases, want):
        met.clear()
        assert {tuple(r) for r in matching.nearest_first(s, b, ["cell"], tol, up, 4.0, gate, least=0).collect()} == taken and taken
        assert sum(met) < every / 4


def test_crowds_narrower_than_their_gaps_have_bands(spark, monkeypatch):
    rng = np.random.default_rng(22)
    rows = lambda n: [(0, k, float(k % 3) + dx, dy, 10.0) for k, (dx, dy) in enumerate(rng.uniform(0, 1e-3, (n, 2)).tolist())]
    a, b = (spark.createDataFrame(rows(n), f"cell int, {c} int, x double, y double, z double").cache() for n, c in ((240, "stem"), (210, "det")))
    whole, met = spatial.candidates, []
    want = {tuple(r) for r in matching.greedy(whole(a, b, ["cell"], 4.0), ["cell"]).collect()}

    def counted(*args, **more):
        pairs = whole(*args, **more)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "candidates", counted)
    assert {tuple(r) for r in matching.nearest_first(a, b, ["cell"], least=0).collect()} == want
    assert max(met) < 3 * 80 * 70 / 4  # pairs of each crowd


def test_links_connect_as_all_pairs_do(spark):
    rng = np.random.default_rng(11)
    rows = [(k % 2, k, "abc"[k % 3], float(x), float(y), float(z)) for k, (x, y, z) in enumerate(np.c_[rng.normal(0, 4, (900, 2)), rng.normal(12, 4, 900)])]
    df = spark.createDataFrame(rows, "cell int, point int, arm string, x double, y double, z double").cache()
    every, few = spatial.pairs_within(df, 2.0, ["cell"], "point", apart="arm", dz=5.0), clustering.links(df, ["cell"], 2.0, 5.0, per=12.0, least=0).cache()
    of = lambda edges: {(r.point, r.cluster) for r in clustering.components(df, edges, ["cell"]).collect()}
    assert of(few) == of(every) and few.count() < every.count() / 2


def test_in_turn_over_points_takes_what_it_does_over_pairs(spark):
    rng = np.random.default_rng(12)
    place = lambda n: [(k % 2, k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 3, (n, 2)).round(1))]
    a, b = (spark.createDataFrame(place(n), f"cell int, {c} int, x double, y double").withColumn("z", F.lit(1.0)) for n, c in ((250, "stem"), (220, "det")))
    want = {tuple(r) for r in matching.in_turn(spatial.candidates(a, b, ["cell"], 3.0, gate=False), ["cell"]).collect()}
    assert {tuple(r) for r in matching.nearest_in_turn(a, b, ["cell"], 3.0, least=0).collect()} == want


def test_least_cost_over_candidates_alone():
    rng = np.random.default_rng(2)
    for n, m, sd in ((60, 50, 3.0), (50, 60, 9.0)):
        a, b = rng.normal(0, sd, (n, 2)), rng.normal(0, sd, (m, 2))
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        left, right = np.nonzero(d <= 3)
        li, ri = np.unique(left, return_inverse=True)[1], np.unique(right, return_inverse=True)[1]
        got = matching._least_cost(li, ri, d[left, right]).tolist()
        want, group = [], matching._connected(li, ri)
        for k in np.unique(group):
            mine = np.flatnonzero(group == k)
            l, r = (np.unique(x[mine], return_inverse=True)[1] for x in (li, ri))
            na, nb, c = l.max() + 1, r.max() + 1, d[left, right][mine]
            cost = np.full((na + nb, na + nb), 1e6)
            cost[na:, nb:] = 0
            cost[np.arange(na), nb + np.arange(na)] = cost[na + np.arange(nb), np.arange(nb)] = c.max() + 1
            cost[l, r] = c
            chosen = matching.assignment(cost)
            want += [int(e) for e, x, y in zip(mine, l, r, strict=True) if chosen[x] == y]
        assert got == sorted(want)


@pytest.mark.parametrize("weight", [None, 0.5])
def test_optimal_over_points_takes_what_it_does_over_pairs(spark, monkeypatch, weight):
    rng = np.random.default_rng(31)

    def rows(n):
        place = np.c_[rng.normal(0, 5, (n, 2)), rng.uniform(2, 30, n)].tolist()
        return [(None if k % 3 == 0 else k % 3, k, x, y, None if k % 29 == 0 else float("nan") if k % 31 == 0 else z) for k, (x, y, z) in enumerate(place)]

    a, b = (spark.createDataFrame(rows(n), f"cell int, {c} int, x double, y double, z double").cache() for n, c in ((900, "stem"), (870, "det")))
    a = a.where("stem < 850 or cell = 1")  # cells of fewer and of more stems than detections
    every = spatial.candidates(a, b, ["cell"], 4.0) if weight is None else matching.soft_candidates(a, b, ["cell"], 4.0, weight)
    want = {tuple(r) for r in matching.optimal(every, ["cell"]).collect()}
    for pairs_of in ("within", "candidates"):
        monkeypatch.setattr(spatial, pairs_of, None)  # no pairs in DataFrames
    got = matching.optimal_points(a, b, ["cell"], 4.0, weight=weight, least=0)
    assert {tuple(r) for r in got.collect()} == want and any(r[0] is None for r in want)
    assert {tuple(r) for r in matching.optimal_points(a.repartition(7), b.repartition(5), ["cell"], 4.0, weight=weight, least=0).collect()} == want


@pytest.mark.parametrize("query", ["optimal_match", "soft_match"])
def test_assignments_of_dense_cells_shuffle_points_and_not_pairs(spark, monkeypatch, query):
    from stemwork.plans import spatial_queries

    rng = np.random.default_rng(32)
    rows = [(k % 2, k, *p) for k, p in enumerate(np.c_[rng.normal(0, 2, (9000, 2)), np.full(9000, 10.0)].tolist())]
    points = spark.createDataFrame(rows, "cell int, point int, x double, y double, z double").cache()
    sides = tuple(points.where(F.col("point") % 4 < 2 if c == "stem" else F.col("point") % 4 > 1).withColumnRenamed("point", c) for c in ("stem", "det"))
    monkeypatch.setattr(spatial_queries, "sides", lambda *_: sides)
    plan = getattr(spatial_queries, query)(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join" not in plan


def test_matching_by_prices_is_least_whatever_lies_on_each_other():
    from stemwork.operators import assigning

    rng = np.random.default_rng(33)
    crowds = lambda n, wide: np.repeat(rng.uniform(0, 12, (6, 2)), n // 6, axis=0) + rng.uniform(0, wide, (n, 2))
    for a, b in ((crowds(240, 0.0), crowds(300, 0.0)), (crowds(240, 1e-3), crowds(246, 1e-3)), (np.round(rng.uniform(0, 20, (300, 2))), np.round(rng.uniform(0, 20, (320, 2))))):
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        d[d > 4] = np.inf
        i, j, dist = assigning.match(a, b, np.arange(len(a)), np.arange(len(b)), 4.0, lambda p, q: d[np.ix_(p, q)])
        left, right = np.nonzero(np.isfinite(d))
        li, ri = np.unique(left, return_inverse=True)[1], np.unique(right, return_inverse=True)[1]
        want = matching._least_cost(li, ri, d[left, right])
        assert len(set(i.tolist())) == len(set(j.tolist())) == len(i) == len(want) and (d[i, j] == dist).all()
        assert np.isclose(dist.sum(), d[left, right][want].sum(), rtol=0, atol=1e-7)
