"""Calibration, scans, sinks and resumed streams."""

import numpy as np
import pytest

from stemwork.operators import calibration
from stemwork.sources import tables
from stemwork.streaming.resume import score_stream, scored_so_far

SCORED = "arm string, row long, prob double, label int"


def scored(spark, prob, label):
    return spark.createDataFrame([("a", k, p, y) for k, (p, y) in enumerate(zip(prob, label))], SCORED)


def test_error_of_two_bins(spark):
    got = calibration.calibration_error(scored(spark, [0.05, 0.15, 0.85, 0.95], [0, 0, 1, 1]), ["arm"], bins=2).first()
    assert np.isclose(got.ece, 0.10)


def test_bins_follow_the_breaks_as_doubles(spark):
    got = {r.bin: r.n for r in calibration.reliability(scored(spark, [0.7, 1.0, 0.0, -1.0], [1, 1, 0, 0]), ["arm"]).collect()}
    assert (got[7], got[8], got[10], got[1], len(got)) == (1, 0, 1, 2, 10)


def test_precision_at_recall(spark):
    df = scored(spark, [0.9, 0.8, 0.7, 0.6, 0.5], [1, 0, 1, 1, 0])
    got = [calibration.precision_at_recall(df, ["arm"], t).first().precision for t in (0.6, 1.0, 0.01)]
    assert np.allclose(got, [2 / 3, 0.75, 1])
    assert calibration.precision_at_recall(scored(spark, [0.5], [0]), ["arm"], 0.5).first().precision is None


def test_isotonic_is_monotone_and_interpolates(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.uniform(0, 1, 60), 1)
    kx, ky = calibration.knots(x, (rng.uniform(0, 1, 60) < x).astype(float))
    assert (np.diff(kx) > 0).all() and (np.diff(ky) >= -1e-12).all() and ky.min() >= 0 and ky.max() <= 1
    train = spark.createDataFrame([("a", 0, 0.0, 0), ("a", 1, 1.0, 1)], "arm string, row long, raw double, label int")
    ask = spark.createDataFrame([("a", -1.0), ("a", 0.25), ("a", 2.0), ("a", None), ("b", 0.5)], "arm string, raw double")
    assert [r.cal for r in calibration.isotonic(train, ask, ["arm"]).sort("arm", "raw").collect()] == [None, 0.0, 0.25, 1.0, None]


def test_detections_of_bad_files_fail_whole(spark, tmp_path):
    for name, text in {"ok": "x,y,z\n1,2,3\n4,5,6\n", "empty": "x,y,z\n", "names": "a,b,c\n1,2,3\n", "value": "x,y,z\n1,2,nan\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows, files = tables.read_detections(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: r.ok for r in files.collect()} == {"ok.csv": True, "empty.csv": True, "names.csv": False, "value.csv": False}
    assert sorted((r.x, r.y, r.z) for r in rows.collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_cached_variants(spark):
    df = spark.createDataFrame([("k1", None, 1), ("k1", "a", 2), ("k2", "b", 3), ("k2", "a", 4), ("k3", "c", 5)], "key string, params string, v int")
    assert {r.key: r.v for r in tables.cached_arm(df, ["key"], "b").collect()} == {"k1": 1, "k2": 3, "k3": 5}


def test_ply_round_trip(spark, tmp_path):
    names, kinds, rows = ["x", "y", "z", "id"], ["double", "double", "float", "int"], [(0.1, 2.0, 3.0, -1), (1e6, 2.5, 4.0, 7)]
    data = tables.format_ply(names, kinds, rows)
    assert tables.parse_ply(data) == (names, rows)
    with pytest.raises(ValueError, match="cut off"):
        tables.parse_ply(data[:-1])
    (tmp_path / "a.ply").write_bytes(data)
    got = tables.read_ply(spark, str(tmp_path), "x double, y double, z double, id int", (1.0, 0.0, 0.0)).collect()
    assert sorted((round(r.x, 3), r.id) for r in got) == [(1.1, -1), (1000001.0, 7)]


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.123456789, 2.0, "a"), (3.0, 4.0, None)], "x double, y double, name string")
    (tmp_path / "f.geojson").write_text(tables.geojson_collection(tables.geojson_features(df, "x", "y", ["name"])))
    got = sorted(r.geometry for r in tables.read_geojson(spark, str(tmp_path / "f.geojson")).collect())
    assert got == ['{"type":"Point","coordinates":[1.1234568,2.0]}', '{"type":"Point","coordinates":[3.0,4.0]}']
    assert tables.geojson_collection(tables.geojson_features(df.limit(0), "x", "y", ["name"])) == '{"type":"FeatureCollection","features":[]}'


def test_markdown(spark):
    assert tables.markdown(spark.createDataFrame([(1, 0.5, None)], "n long, r double, s string")) == "| n | r | s |\n|---|---|---|\n| 1 | 0.500 |  |"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "key string, seq long, v int"
    run = lambda: score_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "log"), ["key"]).awaitTermination()
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("a", 2, 5)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.key: r.v for r in scored_so_far(spark, str(tmp_path / "out"), ["key"]).collect()} == {"a": 5, "b": 1}


def test_las_files_of_other_kinds_are_errors():
    import numpy as np

    from stemwork.sources import las

    x = np.array([500000.123, 500001.5]), np.array([4100000.25, 4100003.0]), np.array([0.5, -2.0])
    data = las.format_las(*x, np.array([2, 7]), np.array([1, 3]), {"inst": np.array([0, -5])})
    got = las.parse_las(data)
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), np.stack(x, axis=1), atol=5e-4)
    assert got["class"].tolist() == [2, 7] and got.ret.tolist() == [1, 3] and got.inst.tolist() == [0, -5]
    assert len(las.parse_las(data, ["z"], classes=[2])) == 1 and len(las.parse_las(data, ["z"], first_only=True)) == 1
    assert len(las.parse_las(las.format_las(*(np.empty(0),) * 3, *(np.empty(0, int),) * 2))) == 0
    for bad, what in ((data[:-1], "cut off"), (b"PLY" + data, "not a LAS"), (data[:104] + b"\x80" + data[105:], "compression")):
        with pytest.raises(ValueError, match=what):
            las.parse_las(bad)
    with pytest.raises(ValueError, match="missing"):
        las.parse_las(data, ["x", "tree"])


def test_knots_of_ranges_are_those_of_the_whole(spark):
    r = np.random.default_rng(3)
    rows = [(k % 2 if k % 9 else None, k, float(np.round(r.normal(), 1)), float(r.random() < 0.4 + 0.1 * (k % 5))) for k in range(600)] + [(7, 600, 1.0, 1.0), (8, 601, None, 1.0)]
    d = spark.createDataFrame(rows, "arm int, row long, raw double, label double").repartition(6)
    got = {f.arm: f for f in calibration.fitted_knots(d, ["arm"]).collect()}
    assert set(got) == {0, 1, None, 7} and got[7].kx == [1.0] and got[7].ky == [1.0]
    for arm in (0, 1, None):
        mine = [x for x in rows if x[0] == arm and x[2] is not None]
        kx, ky = calibration.knots(np.array([x[2] for x in mine]), np.array([x[3] for x in mine]))
        at = np.linspace(-4, 4, 300)
        assert len(got[arm].kx) <= len(kx) and np.allclose(np.interp(at, got[arm].kx, got[arm].ky), np.interp(at, kx, ky))
