"""Queries that write a table with a sink of this package and read it back with the scan that belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.sources import las, tables as T, tiles
from stemwork.sources.scratch import scratch

from .fixtures import ctes, fixture


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with NULLs written twice as CSV, the second time in place of the first, and read with its schema."""
    path = scratch(spark, "csv")
    rows = fixture(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    T.write_csv(rows.limit(5), path)
    T.write_csv(rows, path)
    return T.read_csv(spark, path, "p_partkey long, p_brand string, p_size int, p_retailprice double")


def inferred_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    T.write_csv(fixture(spark, sf_dir, "nation"), path)
    return T.read_csv(spark, path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


def checked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection files of ten cells, of which one has a value that is none: its cell is not ok and has no rows."""
    path = scratch(spark, "detections")
    p = fixture(spark, sf_dir, "points").select("cell", "x", "y", F.when((F.col("cell") == 3) & (F.col("point") % 50 == 3), F.lit(None)).otherwise(F.col("z")).alias("z"))
    p.repartition(1, "cell").sortWithinPartitions("cell").write.partitionBy("cell").option("header", True).csv(path)
    rows, files = T.read_detections(spark, f"{path}/*/*.csv")
    cell = F.regexp_extract("file", r"cell=(\d+)", 1).cast("int")
    n = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return files.select(cell.alias("k"), "ok").join(n, F.col("k") == F.col("cell"), "left").select(F.col("k").alias("cell"), "ok", F.coalesce("n", F.lit(0)).alias("n"))


def cached_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each arm's cached variants the one without parameters, else the pinned one, else the first."""
    c = fixture(spark, sf_dir, "items").select((F.col("l_partkey") % 40).alias("plot"), "l_returnflag", "l_orderkey", "l_linenumber").withColumn("params", F.when((F.col("plot") % 3 == 0) & (F.col("l_linenumber") < 3), F.lit(None)).when((F.col("plot") % 5 == 0) | (F.col("l_linenumber") == 2), F.concat(F.lit("v"), F.col("l_linenumber"))).otherwise("old"))
    return T.cached_arm(c, ["l_returnflag", "plot"], "v2").groupBy("l_returnflag", "plot", "params").agg(F.count("*").alias("n"))


def cached_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs that file names tell, after a scan of the files' names alone."""
    path = scratch(spark, "cache")
    n = fixture(spark, sf_dir, "nation").select(F.concat(F.lit("li2012__SITE__p"), F.col("n_regionkey"), F.lit("__"), F.col("n_nationkey") % 4, F.lit("__v1.csv")).alias("name"), "n_nationkey")
    n.write.partitionBy("name").parquet(path)
    names = spark.read.parquet(path).select("name").distinct()
    k = T.cached_keys(F.col("name"))
    return names.select(k["arm"].alias("arm"), k["site"].alias("site"), k["plot"].alias("plot"), k["rung"].alias("rung")).distinct()


def selection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    T.write_csv(fixture(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_type").alias("method"), F.col("p_size").alias("rung"), F.col("p_partkey").alias("other"), (F.col("p_size") / 4).alias("vwf_a")), path)
    return T.selection_rows(T.read_csv(spark, path), "Brand#12")


def box_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box files of two layouts, with and without a score, read as one table."""
    path = scratch(spark, "boxes")
    p = fixture(spark, sf_dir, "points").where("arm = 'deepforest'")
    p.where("cell % 2 = 0").select("x", "y", (F.col("z") / 20).alias("score")).coalesce(1).write.option("header", True).csv(f"{path}/a")
    p.where("cell % 2 = 1").select(F.lit("tree").alias("label"), "y", "x").coalesce(1).write.option("header", True).csv(f"{path}/b")
    return T.read_boxes(spark, f"{path}/*/*.csv").select("x", "y", "score")


def crown_point_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points in white-space tables; rows with a gap go, and so does a file of another layout."""
    path = scratch(spark, "crowns")
    p = fixture(spark, sf_dir, "points").select("cell", "x", "y", F.when(F.col("point") % 9 == 0, "NA").otherwise(F.col("z").cast("string")).alias("z"), (F.col("point") % 7).alias("crown_id"))
    line = F.array_join(F.array(F.col("x").cast("string"), F.col("y").cast("string"), "z", F.col("crown_id").cast("string")), "  ")
    for name, head, some in (("a", "x y z crown_id", p.where("cell < 5")), ("b", "x y z id", p.where("cell >= 5"))):
        rows = some.select(line.alias("value"), F.lit(1).alias("o")).union(spark.createDataFrame([(head, 0)], "value string, o int"))
        rows.repartition(1).sortWithinPartitions("o").select("value").write.text(f"{path}/{name}")
    return T.read_crown_points(spark, f"{path}/*/*.txt").select("x", "y", "z", "crown_id")


def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of an incremental sink, one of them written again after an interruption."""
    path = scratch(spark, "batches")
    e = fixture(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    write = T.upsert_sink(path, ["user_id", "event_type"], "event_id")
    for k in (0, 1, 1, 2):
        write(e.where(F.col("event_id") % 3 == k), k)
    return T.upsert(None, spark.read.parquet(path).drop("batch"), ["user_id", "event_type"], "event_id")


def labelled_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance labels written with 0 for none and read with NULL for it."""
    path = scratch(spark, "cloud")
    p = fixture(spark, sf_dir, "points").select("point", F.when(F.col("point") % 4 != 0, (F.col("point") % 11).cast("int")).alias("inst"))
    T.write_instances(p, path)
    return T.read_instances(spark, path)


def ply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each cell as a binary PLY, read back with an offset."""
    path = scratch(spark, "ply")
    p = fixture(spark, sf_dir, "points").select("cell", "x", "y", "z", F.col("point").cast("int").alias("inst"))
    T.write_ply(p, path, ["x", "y", "z", "inst"], ["double", "double", "double", "int"], "cell", offset=(100.0, 200.0, 0.0))
    return T.read_ply(spark, f"{path}/*/*", "x double, y double, z double, inst int", offset=(100.0, 200.0, 0.0)).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "z", "inst")


def frozen_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a cache of clips that is filled in two goes, of which the second finds some clips there."""
    root = scratch(spark, "frozen")
    c = fixture(spark, sf_dir, "items").select(F.lit("SITE").alias("site"), F.concat(F.lit("p"), F.col("l_partkey") % 30).alias("plot"), F.when(F.col("l_linenumber") % 2 == 0, "8").alias("rung"), (F.col("l_orderkey") % 9).cast("int").alias("class"), F.col("l_linenumber").alias("ret"), F.col("l_quantity").alias("z"))
    T.freeze(c.where("plot < 'p2'"), root)
    return T.freeze(c, root)


def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as a collection of each cell and read back."""
    path = scratch(spark, "geojson")
    p = fixture(spark, sf_dir, "points").select("cell", "point", "arm", F.when(F.col("point") % 5 != 0, F.round("z", 6)).alias("z"), "x", "y")
    T.write_geojson(p, path, "x", "y", ["point", "arm", "z"], "cell")
    rows = T.read_geojson(spark, f"{path}/*/*.txt")
    number = lambda c, k: F.get_json_object(c, k).cast("double")
    return rows.select(F.get_json_object("properties", "$.point").cast("long").alias("point"), F.get_json_object("properties", "$.arm").alias("arm"), number("properties", "$.z").alias("z"), number("geometry", "$.coordinates[0]").alias("lon"), number("geometry", "$.coordinates[1]").alias("lat"))


def las_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each cell as LAS with their labels, of which two classes are read back, by some of their columns."""
    path = scratch(spark, "las")
    p = fixture(spark, sf_dir, "points").select("cell", "x", "y", "z", (F.col("point") % 6).cast("int").alias("class"), (F.col("point") % 3 + 1).cast("int").alias("ret"), F.col("point").alias("inst"))
    las.write_las(p, path, "cell", ["inst"])
    rows = las.read_las(spark, f"{path}/*/*", ["x", "y", "z", "class", "ret"], ["inst"], classes=[2, 5])
    return rows.select(F.regexp_extract("file", r"cell=(\d+)", 1).cast("int").alias("cell"), *[F.round(F.col(c) * 1000).cast("long").alias(f"{c}_mm") for c in "xyz"], "class", "ret", "inst")


def las_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read by ranges of 20 points, with conditions that the scan takes over."""
    path = scratch(spark, "las")
    p = fixture(spark, sf_dir, "points").select("cell", "x", "y", "z", (F.col("point") % 6).cast("int").alias("class"), (F.col("point") % 3 + 1).cast("int").alias("ret"), F.col("point").alias("inst"))
    las.write_las(p, path, "cell", ["inst"])
    rows = las.scan_las(spark, path, ["x", "z", "class"], ["inst"], 20)
    return rows.where((F.col("class") == 2) & (F.col("x") >= -5.0)).select("class", "inst", F.round(F.col("z") * 1000).cast("long").alias("z_mm"))


def tile_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of detail of a box, from a catalog of all points in tiles."""
    path = scratch(spark, "tiles")
    tiles.write_tiles(fixture(spark, sf_dir, "points").select("cell", "point", "x", "y", "z"), path, 8.0, 4.0, 3)
    return tiles.scan_tiles(spark, path, (-6.0, -3.5, 5.0, 9.0), 1).select("cell", "point", "level", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"))


QUERIES = {
    f.__name__: f for f in (csv_round_trip, inferred_csv, checked_detections, cached_variants, cached_rungs, selection_manifest, box_files, crown_point_files, appended_batches, labelled_cloud, ply_round_trip, frozen_clips, geojson_files, las_round_trip, las_scan, tile_box)
}

_P = ctes("points")
ORACLE_SQL = {
    "csv_round_trip": "SELECT p_partkey, p_brand, CASE WHEN p_size % 3 <> 0 THEN p_size END AS p_size, p_retailprice FROM part",
    "inferred_csv": "SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY n_regionkey",
    "checked_detections": f"WITH {_P} SELECT cell, NOT bool_or(cell = 3 AND point % 50 = 3) AS ok, CASE WHEN bool_or(cell = 3 AND point % 50 = 3) THEN 0 ELSE count(*) END AS n FROM f_points GROUP BY cell",
    "cached_variants": """WITH c AS (SELECT l_returnflag, l_partkey % 40 AS plot, CASE WHEN l_partkey % 40 % 3 = 0 AND l_linenumber < 3 THEN NULL WHEN l_partkey % 40 % 5 = 0 OR l_linenumber = 2 THEN 'v' || l_linenumber ELSE 'old' END AS params FROM lineitem),
n AS (SELECT l_returnflag, plot, params, count(*) AS n FROM c GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY l_returnflag, plot ORDER BY CASE WHEN params IS NULL THEN 0 WHEN params = 'v2' THEN 1 ELSE 2 END, params) = 1""",
    "cached_rungs": "SELECT DISTINCT 'li2012' AS arm, 'SITE' AS site, 'p' || n_regionkey AS plot, CAST(n_nationkey % 4 AS VARCHAR) AS rung FROM nation",
    "selection_manifest": "SELECT p_brand AS site, p_type AS method, CAST(p_size AS VARCHAR) AS rung, p_size / 4 AS vwf_a FROM part WHERE p_brand = 'Brand#12'",
    "box_files": f"WITH {_P} SELECT x, y, CASE WHEN cell % 2 = 0 THEN z / 20 END AS score FROM f_points WHERE arm = 'deepforest'",
    "crown_point_files": f"WITH {_P} SELECT x, y, z, CAST(point % 7 AS INT) AS crown_id FROM f_points WHERE cell < 5 AND point % 9 <> 0",
    "appended_batches": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "labelled_cloud": f"WITH {_P} SELECT point, CASE WHEN point % 4 <> 0 AND point % 11 <> 0 THEN CAST(point % 11 AS INT) END AS inst FROM f_points",
    "ply_round_trip": f"WITH {_P} SELECT round(x, 9) AS x, round(y, 9) AS y, z, CAST(point AS INT) AS inst FROM f_points",
    "frozen_clips": """WITH c AS (SELECT 'SITE' AS site, 'p' || (l_partkey % 30) AS plot, CASE WHEN l_linenumber % 2 = 0 THEN '8' ELSE 'native' END AS rung, l_orderkey % 9 AS class, l_linenumber AS ret FROM lineitem),
m AS (SELECT site, plot, rung, count(*) AS n_raw, count_if(class = 2) AS n_ground, count_if(ret = 1) AS n_first FROM c GROUP BY ALL HAVING count(*) >= 100 AND count_if(class = 2) >= 10)
SELECT *, CAST(list_reduce(list_transform(string_split(site || '|' || plot || '|' || rung, ''), lambda c: CAST(ascii(c) AS DOUBLE)), lambda h, c: ((h - (h % 128) + CAST(xor(CAST(h % 128 AS BIGINT), CAST(c AS BIGINT)) AS DOUBLE)) * 16777619) % 4294967296, CAST(2166136261 AS DOUBLE)) % 2147483648 AS BIGINT) AS seed FROM m""",
    "las_round_trip": f"WITH {_P} SELECT cell, CAST(round(x * 1000) AS BIGINT) AS x_mm, CAST(round(y * 1000) AS BIGINT) AS y_mm, CAST(round(z * 1000) AS BIGINT) AS z_mm, CAST(point % 6 AS INT) AS class, CAST(point % 3 + 1 AS INT) AS ret, point AS inst FROM f_points WHERE point % 6 IN (2, 5)",
    "las_scan": f"WITH {_P} SELECT 2 AS class, point AS inst, CAST(round(z * 1000) AS BIGINT) AS z_mm FROM f_points WHERE point % 6 = 2 AND round(x * 1000) >= -5000",
    "tile_box": f"""WITH {_P}, l AS (SELECT cell, point, x, y, CASE WHEN row_number() OVER (PARTITION BY floor(x / 4), floor(y / 4) ORDER BY md5(CAST(point AS VARCHAR)), point) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY floor(x / 2), floor(y / 2) ORDER BY md5(CAST(point AS VARCHAR)), point) = 1 THEN 1 ELSE 2 END AS level FROM f_points)
SELECT cell, point, level, CAST(floor(x / 8) AS BIGINT) AS tx, CAST(floor(y / 8) AS BIGINT) AS ty FROM l WHERE level <= 1 AND x BETWEEN -6 AND 5 AND y BETWEEN -3.5 AND 9""",
    "geojson_files": f"WITH {_P} SELECT point, arm, CASE WHEN point % 5 <> 0 THEN round(z, 6) END AS z, round(x, 7) AS lon, round(y, 7) AS lat FROM f_points",
}
