"""Scans and sinks of tables: checked detections, cached arms, manifests, keyed upserts, GeoJSON, Markdown, PLY."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from stemwork.functions.scalars import finite

from .files import write_files

DETECTION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z")])


def check_columns(df: DataFrame, names: list[str], fill: dict[str, Column] | None = None) -> DataFrame:
    """df with the columns that `fill` has and df lacks; an error names those that are missing still."""
    for name, value in (fill or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(detections with their file, (file, ok) for each file): CSV with exactly x, y, z and finite values.

    A file of wrong columns or with a value that is none fails as a whole: it is ok false and has no rows.
    A file with its header alone is ok. The header is read as a row, so each file is judged by its own.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    parts = F.split(F.regexp_replace("value", '["\\s]', ""), ",")
    rows = lines.where("value <> ''").select("file", parts.alias("p"))
    header = F.array_join("p", ",") == "x,y,z"
    numbers = [F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    rows = rows.select("file", header.alias("header"), F.size("p").alias("n"), *numbers)
    good = (F.col("n") == 3) & finite("x") & finite("y") & finite("z")
    files = rows.groupBy("file").agg((F.bool_or("header") & F.bool_and(F.col("header") | good)).alias("ok"))
    kept = rows.where(~F.col("header")).join(files.where("ok").select("file"), "file", "left_semi")
    return kept.select("file", "x", "y", "z"), files


def cached_arm(cache: DataFrame, keys: list[str], params: str | None = None) -> DataFrame:
    """Rows of one variant of each key: the one without parameters, else the one with `params`, else the first by name.

    cache has the column params (NULL for none); partitions by keys and params are pruned by filters on them.
    """
    p = F.when(F.col("params").isNull(), 0).when(F.col("params") == params, 1).otherwise(2) if params is not None else F.when(F.col("params").isNull(), 0).otherwise(2)
    variants = cache.select(*keys, "params").distinct()
    first = variants.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(p, "params"))).where("_r = 1").drop("_r")
    names = {c: f"_v{i}" for i, c in enumerate([*keys, "params"])}
    return cache.join(first.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left_semi")


def cached_keys(names: Column) -> Column:
    """(arm, site, plot, rung) of a cache file's name, its parts between double underscores; NULL if too few."""
    parts = F.split(F.regexp_replace(names, r"\.csv$", ""), "__")
    return F.when(F.size(parts) >= 4, F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("arm", "site", "plot", "rung"))]))


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows of both, of each key the one with the largest seq (an incremental, resumable sink's content)."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(seq).desc()))).where("_r = 1").drop("_r")


def upsert_sink(path: str, keys: list[str], seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch under its number; reading back takes the last of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def geojson_features(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """rows as one column `feature`: GeoJSON points of 7 decimals with the properties, NULLs kept."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 7), F.round(lat, 7)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def geojson_collection(features: DataFrame) -> str:
    """A small feature collection as text; empty if there are no rows."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features.toLocalIterator()) + "]}"


def write_geojson(rows: DataFrame, path: str, lon: str, lat: str, properties: list[str], by: str) -> None:
    """One feature collection a file and value of `by`, in folders of that name; each is written by one task.

    A value's features are gathered in its one text, so `by` must be fine enough for a file.
    """
    f = geojson_features(rows, lon, lat, [*properties, by])
    features = f.select("feature", F.get_json_object("feature", f"$.properties.{by}").alias(by))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("feature")), ","), F.lit("]}"))
    features.groupBy(by).agg(text.alias("value")).repartition(by).sortWithinPartitions(by).write.option("maxRecordsPerFile", 1).partitionBy(by).text(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, properties) as JSON text, a row for each feature of the files, read whole."""
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(features).alias("f"))
    return rows.select(F.get_json_object("f", "$.geometry").alias("geometry"), F.get_json_object("f", "$.properties").alias("properties"))


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small result as a Markdown table: whole numbers stay whole, others have `digits` decimals, NULL is empty."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join(map(cell, r)) + " |" for r in df.toLocalIterator()])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types from the schema, else inferred by one more pass. Empty and NA are NULL."""
    reader = spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV with headers, NULL as NA, in place of what is there."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def selection_rows(manifest: DataFrame, site: str, keep: tuple[str, ...] = ("site", "method", "rung", "chm_res", "vwf_a")) -> DataFrame:
    """The site's rows of a selection manifest, rung as text, with those of the columns that it has; site, method and
    rung must be there."""
    check_columns(manifest, ["site", "method", "rung"])
    rows = manifest.where(F.col("site") == site).select(*[c for c in keep if c in manifest.columns])
    return rows.withColumn("rung", F.col("rung").cast("string"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Crown boxes of all CSV files that the pattern names, by column name: x, y and score (NULL in files without it)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    parts = F.transform(F.split(F.regexp_replace("value", '"', ""), ","), lambda c: F.trim(c))
    rows = lines.where("trim(value) <> ''").select("file", parts.alias("p"))
    # a header is a row without any number; each file has its own
    named = F.exists("p", lambda c: c.isin("x", "y"))
    heads = rows.where(named).select(F.col("file").alias("h_file"), F.col("p").alias("h")).dropDuplicates(["h_file"])
    body = rows.where(~named).join(heads, F.col("file") == F.col("h_file"))
    value = lambda c: F.get("p", F.array_position("h", F.lit(c)).cast("int") - 1).try_cast("double").alias(c)
    return body.select("file", value("x"), value("y"), value("score"))


def read_crown_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z, crown_id) of white-space tables with exactly these columns; rows that lack a number go, and
    files with other headers give none."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p"), F.col("_metadata.file_path").alias("file"))
    good = lines.where(F.array_join("p", " ") == "x y z crown_id").select("file").distinct()
    numbers = [F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    rows = lines.where(F.array_join("p", " ") != "x y z crown_id").select("file", *numbers, F.get("p", F.lit(3)).try_cast("int").alias("crown_id"))
    return rows.where(finite("x") & finite("y") & finite("z") & F.col("crown_id").isNotNull()).join(good, "file", "left_semi")


def write_instances(points: DataFrame, path: str, label: str = "inst") -> None:
    """A labelled cloud: all columns, with 0 for points without a label."""
    points.withColumn(label, F.coalesce(F.col(label), F.lit(0))).write.mode("overwrite").parquet(path)


def read_instances(spark: SparkSession, path: str, label: str = "inst") -> DataFrame:
    """A labelled cloud with NULL for points of label 0; a cloud without the label is an error."""
    rows = check_columns(spark.read.parquet(path), [label])
    return rows.withColumn(label, F.when(F.col(label) != 0, F.col(label)))


def frozen_dir(root: str, site: str, plot: str, rung: str | None) -> str:
    """Where a frozen clip lies: root/site/plot/rung, native where there is no rung."""
    return f"{root}/{site}/{plot}/{rung or 'native'}"


def freeze(clips: DataFrame, root: str, keys: tuple[str, ...] = ("site", "plot", "rung"), least: int = 100, ground: int = 10) -> DataFrame:
    """Writes clips that the cache lacks, with a manifest, and returns the manifest of all that it holds.

    clips: keys, class, ret, z and whatever else. A clip of fewer than `least` points or `ground` ground points
    (class 2) isn't kept. Points and manifests are partitioned by the keys, so a reader prunes to its clip; a
    clip whose manifest is there is reused as it is and never written again.
    """
    from stemwork.functions.scalars import seed_for

    spark = clips.sparkSession
    clips = clips.withColumn("rung", F.coalesce(F.col("rung").cast("string"), F.lit("native")))
    try:
        known = spark.read.parquet(f"{root}/manifest")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    names = {k: f"_f{i}" for i, k in enumerate(keys)}
    same = lambda: [F.col(k).cast("string") == F.col(n).cast("string") for k, n in names.items()]
    fresh = clips if known is None else clips.join(known.select(*[F.col(k).alias(n) for k, n in names.items()]), same(), "left_anti")
    some = fresh.groupBy(*keys).agg(F.count("*").alias("n_raw"), F.count_if(F.col("class") == 2).alias("n_ground"), F.count_if(F.col("ret") == 1).alias("n_first"))
    some = some.where((F.col("n_raw") >= least) & (F.col("n_ground") >= ground)).withColumn("seed", seed_for(*keys)).persist()
    fresh.join(some.select(*[F.col(k).alias(n) for k, n in names.items()]), same(), "left_semi").write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/points")
    some.write.mode("append").parquet(f"{root}/manifest")
    some.unpersist()
    return spark.read.schema("site string, plot string, rung string, n_raw long, n_ground long, n_first long, seed long").parquet(f"{root}/manifest")


# Scalar types of PLY and their letters for struct.
PLY_TYPES = {
    "char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d",
    "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d",
}
# End of fixed values.


def parse_ply(data: bytes) -> tuple[list[str], list[tuple]]:
    """Names and rows of the vertices of a little-endian binary PLY; an error says what is wrong with others."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    start = data.index(b"\n", end) + 1
    head = data[:end].decode("ascii").replace("\r\n", "\n").split("\n")
    if not any(x.split()[:2] == ["format", "binary_little_endian"] for x in head):
        raise ValueError("only binary_little_endian is read")
    names, kinds, count, inside = [], "<", 0, False
    for words in (x.split() for x in head):
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            if words[1] == "list":
                raise ValueError("vertices with lists aren't read")
            kinds += PLY_TYPES[words[1]]
            names.append(words[2])
    size = struct.calcsize(kinds)
    if len(data) - start < count * size:
        raise ValueError("the file is cut off")
    return names, list(struct.iter_unpack(kinds, data[start : start + count * size]))


def format_ply(names: list[str], kinds: list[str], rows: list[tuple]) -> bytes:
    """A little-endian binary PLY of vertices."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property {k} {n}" for k, n in zip(kinds, names, strict=True)], "end_header\n"]
    pack = struct.Struct("<" + "".join(PLY_TYPES[k] for k in kinds))
    return "\n".join(head).encode() + b"".join(pack.pack(*r) for r in rows)


def write_ply(df: DataFrame, path: str, names: list[str], kinds: list[str], by: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """A binary PLY for each value of `by`, x, y and z less the offset, in folders of its name.

    A file is made by one task from one value's rows, which must fit its memory.
    """
    import pandas as pd

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows = part[names].copy()
        for c, o in zip("xyz", offset, strict=True):
            if c in rows:
                rows[c] = rows[c] - o
        return pd.DataFrame({by: [part[by].iloc[0]], "content": [format_ply(names, kinds, list(rows.itertuples(index=False, name=None)))]})

    kind = df.schema[by].dataType.simpleString()
    packed = df.select(by, *names).groupBy(by).applyInPandas(pack, f"`{by}` {kind}, content binary")
    write_files(packed.select(F.concat(F.lit(f"{by}="), F.coalesce(F.col(by).cast("string"), F.lit("None")), F.lit("/points.ply")).alias("name"), "content"), path)


def read_ply(spark: SparkSession, path: str, schema: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Vertices of PLY files, their x, y, z (any case) moved by the offset, NULL for properties a file lacks.

    Files are read by Spark as binary rows, one a task at a time.
    """
    from pyspark.sql import types

    names = types._parse_datatype_string(schema).names

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for data in batch.content:
                found, rows = parse_ply(data)
                frame = pd.DataFrame(rows, columns=[n.lower() for n in found])
                for c, o in zip("xyz", offset, strict=True):
                    if c in frame:
                        frame[c] = frame[c].astype("float64") + o
                yield frame.reindex(columns=[n.lower() for n in names]).set_axis(names, axis=1)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
