"""Whole-file sinks and the scan of LAS files by ranges of points."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from stemwork.sources import files, las


def cloud(n, shift=0.0):
    r = np.random.default_rng(n)
    return r.uniform(0, 50, n) + shift, r.uniform(0, 50, n), r.uniform(0, 30, n), r.integers(1, 6, n), r.integers(1, 4, n)


@pytest.fixture()
def folder(tmp_path):
    for name, shift, n in (("a", 0.0, 1000), ("b", 1000.0, 37), ("c", 2000.0, 0)):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "points.las").write_bytes(las.format_las(*cloud(n, shift), {"inst": np.arange(n)}))
    return str(tmp_path)


def test_a_file_is_many_partitions(spark, folder):
    rows = las.scan_las(spark, folder, ["file", "x", "y", "class", "ret"], ["inst"], points=64)
    assert rows.rdd.getNumPartitions() == 16 + 1
    got = rows.where("file like '%/a/%'").orderBy("inst").toPandas()
    x, y, _, kind, ret = cloud(1000)
    assert len(got) == 1000 and abs(got.x - x).max() < 6e-4 and abs(got.y - y).max() < 6e-4 and (got["class"] == kind).all() and (got.ret == ret).all()
    whole = las.read_las(spark, f"{folder}/*", ["x", "y", "class", "ret"], ["inst"]).select("x", "y", "class", "ret", "inst")
    assert rows.drop("file").exceptAll(whole).count() == 0 and rows.count() == whole.count() == 1037
    assert las.scan_las(spark, f"file://{folder}/b/points.las", ["z"]).count() == 37 and las.scan_las(spark, f"{folder}/c", ["z"]).count() == 0


def test_conditions_are_pushed(spark, folder):
    rows = las.scan_las(spark, folder, ["x", "z", "class"])
    some = rows.where((F.col("x") > 1000) & (F.col("class") == 2) & (F.col("z") < 20))
    x, _, z, kind, _ = cloud(37, 1000.0)
    assert some.count() == int(((kind == 2) & (np.round(z, 3) < 20)).sum())
    reader = las._PointReader(folder, ["x"], 64)
    assert len(reader.partitions()) == 17
    reader.pushFilters([GreaterThan(("x",), 500.0), EqualTo(("class",), 2), In(("ret",), (1, 2))])
    assert [p.path.split("/")[-2] for p in reader.partitions()] == ["b"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 37
    reader.pushFilters([LessThan(("x",), -1.0)])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 0


def test_bad_files_are_errors(spark, tmp_path):
    good = las.format_las(*cloud(10))
    for k, bad in enumerate((good[:-1], b"LASF", good[:104] + b"\x83" + good[105:])):
        (tmp_path / f"{k}.las").write_bytes(bad)
        with pytest.raises(Exception, match="cut off|not a LAS|is read"):
            las.scan_las(spark, str(tmp_path / f"{k}.las"), ["x"]).count()


def test_files_come_together_or_not_at_all(spark, tmp_path):
    rows = spark.range(20).select(F.format_string("d=%d/f.bin", "id").alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("content")).repartition(4)
    files.write_files(rows, f"{tmp_path}/out")
    found = {os.path.relpath(os.path.join(d, f), tmp_path): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names}
    assert found == {f"out/d={k}/f.bin": k for k in range(20)} and not [d for d in os.listdir(tmp_path / "out") if d.startswith("_")]
    bad = rows.withColumn("content", F.when(F.col("name") == "d=13/f.bin", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        files.write_files(bad, f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none") or not [f for _, _, names in os.walk(tmp_path / "none") for f in names]


def test_writers_leave_the_driver_out(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).alias("cell"), (F.col("id") / 7).alias("x"), F.col("id").cast("double").alias("y"), F.lit(1.5).alias("z"), (F.col("id") % 4).cast("int").alias("class"), F.lit(1).alias("ret"), F.col("id").cast("int").alias("inst"))
    las.write_las(rows, str(tmp_path), "cell", ["inst"])
    back = las.scan_las(spark, str(tmp_path), ["file", "x", "class"], ["inst"])
    assert back.count() == 500 and {r.file.split("/")[-2] for r in back.select("file").distinct().collect()} == {"cell=0", "cell=1", "cell=2"}
    assert back.agg(F.sum("inst")).first()[0] == 500 * 499 // 2
