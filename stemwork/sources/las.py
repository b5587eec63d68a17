"""LAS point files (version 1.2, formats 0 to 3, little-endian, not compressed), with whole-number extra dimensions.

scan_las() reads ranges of points, so a file is as many tasks as it needs. read_las() takes files as Spark's binary rows, for
stores that only Spark knows; there a file is parsed by one task. Only the columns that are asked for are decoded,
and conditions on class and return drop points before they become rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import place, write_files

# The public header's layout and the point formats' sizes.
HEADER, HEADER_SIZE, SIZES = "<4sHHIHH8sBB32s32sHHHIIBHI5I3d3d6d", 227, {0: 20, 1: 28, 2: 26, 3: 34}
POINT = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8"}
# End of fixed values.
#: Points of a partition at most, and of a batch.
POINTS, BATCH = 1_000_000, 100_000
SCHEMA = {"x": "double", "y": "double", "z": "double", "intensity": "int", "ret": "int", "returns": "int", "class": "int", "withheld": "boolean"}


def format_las(x: np.ndarray, y: np.ndarray, z: np.ndarray, kind: np.ndarray, ret: np.ndarray, extra: dict[str, np.ndarray] | None = None, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 0; coordinates are kept to `scale`, extra dimensions as 32-bit whole numbers."""
    extra = extra or {}
    n, size = len(x), SIZES[0] + 4 * len(extra)
    low = [float(np.floor(v.min())) if n else 0.0 for v in (x, y, z)]
    points = np.zeros(n, np.dtype([*POINT, *((name, "<i4") for name in extra)]))
    for name, v, o in zip("XYZ", (x, y, z), low, strict=True):
        points[name] = np.round((v - o) / scale)
    points["class"], points["flags"] = kind & 31, (ret & 7) | (ret & 7) << 3
    for name, v in extra.items():
        points[name] = v
    records = b"".join(struct.pack("<2sBB32s4s24s24s24s24s24s32s", b"", 6, 0, name.encode(), b"", b"", b"", b"", b"", b"", b"") for name in extra)
    note = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(records), b"extra dimensions") + records if extra else b""
    returns = [int((ret == k).sum()) for k in range(1, 6)]
    box = [f(v) if n else 0.0 for v in (x, y, z) for f in (np.max, np.min)]
    head = struct.pack(HEADER, b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"stemwork", 1, 2024, HEADER_SIZE, HEADER_SIZE + len(note), int(bool(extra)), 0, size, n, *returns, scale, scale, scale, *low, *box)
    return head + note + points.tobytes()


@dataclass(frozen=True)
class Layout:
    """What a file's header says of its points: where they start, how many of what bytes, their box and extra dimensions."""

    start: int
    size: int
    count: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    box: dict[str, tuple[float, float]]
    fields: tuple[tuple[str, str], ...]
    extra: tuple[str, ...]

    def points(self, data: bytes, count: int, at: int = 0) -> np.ndarray:
        return np.frombuffer(data, np.dtype(list(self.fields)), count, at)


def layout_of(data: bytes, length: int | None = None) -> Layout:
    """The layout from a file's bytes up to its first point; length is the whole file's. An error says what is wrong with other kinds of files."""
    length = len(data) if length is None else length
    if data[:4] != b"LASF" or len(data) < HEADER_SIZE:
        raise ValueError("not a LAS file")
    h = struct.unpack_from(HEADER, data)
    major, minor, header_size, start, notes, kind, size, count = h[7], h[8], h[13], h[14], h[15], h[16], h[17], h[18]
    if kind & 0xC0 or kind not in SIZES or (major, minor) > (1, 3):
        raise ValueError("only LAS up to 1.3 with point formats 0 to 3 is read, without compression")
    if length < start + count * size:
        raise ValueError("the file is cut off")
    fields, used, at = list(POINT), SIZES[kind], header_size
    fields += [("_more", f"V{SIZES[kind] - 20}")] if SIZES[kind] > 20 else []
    names: list[str] = []
    for _ in range(notes):
        _, user, number, note, _ = struct.unpack_from("<H16sHH32s", data, at)
        at += 54
        if user.rstrip(b"\0") == b"LASF_Spec" and number == 4:
            for k in range(0, note, 192):
                name = data[at + k + 4 : at + k + 36].split(b"\0")[0].decode()
                what = EXTRA_TYPES.get(data[at + k + 2])
                if what is None:
                    raise ValueError(f"the extra dimension {name} is not of whole numbers")
                fields.append((f"+{name}", what))
                names.append(name)
                used += np.dtype(what).itemsize
        at += note
    if used > size:
        raise ValueError("the points are shorter than their dimensions")
    fields += [("_rest", f"V{size - used}")] if size > used else []
    box = {c: (h[31 + 2 * k], h[30 + 2 * k]) for k, c in enumerate("xyz")}
    return Layout(start, size, count, h[24:27], h[27:30], box, tuple(fields), tuple(names))


def decoded(p: np.ndarray, layout: Layout, columns: list[str] | None = None) -> dict[str, np.ndarray]:
    """The columns of points; None is all there are. Only those are computed."""
    make = {
        **{c: (lambda k=k, c=c: p[c.upper()] * layout.scale[k] + layout.offset[k]) for k, c in enumerate("xyz")},
        "intensity": lambda: p["intensity"].astype("int32"), "ret": lambda: (p["flags"] & 7).astype("int32"), "returns": lambda: (p["flags"] >> 3 & 7).astype("int32"),
        "class": lambda: (p["class"] & 31).astype("int32"), "withheld": lambda: p["class"] >> 7 == 1, **{n: (lambda n=n: p[f"+{n}"].astype("int64")) for n in layout.extra},
    }
    wanted = list(make) if columns is None else columns
    missing = [c for c in wanted if c not in make]
    if missing:
        raise ValueError(f"dimensions {missing} are missing")
    return {c: make[c]() for c in wanted}


def parse_las(data: bytes, columns: list[str] | None = None, classes: list[int] | None = None, first_only: bool = False) -> pd.DataFrame:
    """Points of a LAS file's bytes. columns: None is all there are."""
    layout = layout_of(data)
    p = layout.points(data, layout.count, layout.start)
    if classes is not None:
        p = p[np.isin(p["class"] & 31, classes)]
    if first_only:
        p = p[p["flags"] & 7 == 1]
    return pd.DataFrame(decoded(p, layout, columns))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int


class _PointReader(DataSourceReader):
    """Ranges of points of all files below a path; conditions on class, ret and place drop files, then points, before they become rows."""

    def __init__(self, path: str, columns: list[str], step: int):
        self.path, self.columns, self.step, self.tests = path, columns, step, []

    def pushFilters(self, filters):
        simple = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, EqualTo: np.equal, In: np.isin}
        for f in filters:
            if type(f) in simple and len(f.attribute) == 1 and f.attribute[0] in ("x", "y", "z", "class", "ret"):
                self.tests.append((f.attribute[0], type(f).__name__, simple[type(f)], f.value))
        return filters  # Spark tests what is left again, which costs little

    def _apart(self, box: dict[str, tuple[float, float]]) -> bool:
        """Whether no place in a file's box passes the tests."""
        for c, kind, _, value in self.tests:
            if c in box and isinstance(value, (int, float)):
                low, high = box[c]
                if kind.startswith("Greater") and high < value or kind.startswith("Less") and low > value or kind == "EqualTo" and not low <= value <= high:
                    return True
        return False

    def partitions(self) -> list[_Range]:
        store, root = place(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".las") and "/_" not in f.path[len(root) :]]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            layout = _layout(store, f.path)
            if not self._apart(layout.box):
                out += [_Range(f.path, k, min(self.step, layout.count - k)) for k in range(0, layout.count, self.step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = place(self.path)
        layout = _layout(store, partition.path)
        with store.open_input_file(partition.path) as f:
            for k in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - k)
                p = layout.points(f.read_at(n * layout.size, layout.start + k * layout.size), n)
                for c, _, test, value in self.tests:
                    p = p[test(decoded(p, layout, [c])[c], list(value) if isinstance(value, tuple) else value)]
                found = decoded(p, layout, [c for c in self.columns if c != "file"])
                yield pa.RecordBatch.from_pydict({c: pa.array([partition.path] * len(p), pa.string()) if c == "file" else pa.array(found[c]) for c in self.columns})


def _layout(store: fs.FileSystem, path: str) -> Layout:
    with store.open_input_file(path) as f:
        size = f.size()
        head = f.read_at(min(size, HEADER_SIZE), 0)
        start = struct.unpack_from("<I", head, 96)[0] if len(head) == HEADER_SIZE else 0
        return layout_of(f.read_at(min(size, max(start, HEADER_SIZE)), 0), size)


class LasPoints(DataSource):
    """Read only: .format("las_points").schema(...).option("path", ...), and option points, the most of them in a partition."""

    @classmethod
    def name(cls) -> str:
        return "las_points"

    def schema(self) -> str:
        return "file string, " + ", ".join(f"`{c}` {t}" for c, t in SCHEMA.items())

    def reader(self, schema) -> _PointReader:
        return _PointReader(self.options["path"], [f.name for f in schema], int(self.options.get("points", POINTS)))


def scan_las(spark: SparkSession, path: str, columns: list[str] | None = None, extra: list[str] | None = None, points: int = POINTS) -> DataFrame:
    """(columns) of all LAS files below a path that pyarrow's file systems know, or of one file, in partitions of at most so many points.

    A large file is many partitions, each reading its own bytes. Only the columns asked for are decoded ("file" is the
    path). Conditions on x, y, z, class and ret are pushed to the scan: files whose header's box is apart aren't read. Nothing
    but headers passes the driver.
    """
    spark.dataSource.register(LasPoints)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = [*(columns or list(SCHEMA)), *(extra or [])]
    kinds = {"file": "string"} | SCHEMA
    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in wanted)
    return spark.read.format("las_points").schema(schema).option("points", str(points)).option("path", path).load()


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, extra: list[str] | None = None, classes: list[int] | None = None, first_only: bool = False) -> DataFrame:
    """(file, columns) of LAS files: a file with another layout, or without an extra dimension that is asked for, is an error."""
    wanted = [*(columns or list(SCHEMA)), *(extra or [])]
    schema = "file string, " + ", ".join(f"`{c}` {SCHEMA.get(c, 'long')}" for c in wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                points = parse_las(data, wanted, classes, first_only)
                yield points.assign(file=name)[["file", *wanted]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_las(df: DataFrame, path: str, by: str, extra: list[str] | None = None) -> None:
    """One LAS file for each value of `by`, from x, y, z, class, ret and extra dimensions (NULL is 0), in folders of its name.

    A file is made by one task from one value's points, which must fit its memory.
    """
    extra = extra or []

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        more = {c: part[c].fillna(0).to_numpy("int64") for c in extra}
        body = format_las(*(part[c].to_numpy(float) for c in "xyz"), part["class"].fillna(0).to_numpy(int), part["ret"].fillna(0).to_numpy(int), more)
        return pd.DataFrame({by: [part[by].iloc[0]], "content": [body]})

    kind = df.schema[by].dataType.simpleString()
    packed = df.select(by, "x", "y", "z", "class", "ret", *extra).groupBy(by).applyInPandas(pack, f"`{by}` {kind}, content binary")
    write_files(packed.select(F.concat(F.lit(f"{by}="), F.coalesce(F.col(by).cast("string"), F.lit("None")), F.lit("/points.las")).alias("name"), "content"), path)
