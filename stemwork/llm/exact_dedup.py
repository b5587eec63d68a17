"""Exact deduplication by Grace hashing with open-addressing tables that compare complete content.

Every task first combines the rows of its own input, so copies of one text meet the shuffle once for each
input partition. The distinct texts are then dealt by a hash of their content, and each task partitions
what it reads into spill files by further bits of that hash, again and again, until a bucket fits an
open-addressing table of bounded size. Texts that a task has often are dealt twice, first with a share of their rows. Equality is decided on complete bytes, never on a digest. Rows and
their texts part after the first step: only distinct texts are shuffled, and a row finds its group by the
slot that it got there.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import parts, written

#: Bytes of texts in one open-addressing table; larger buckets are split into FAN spill files.
TABLE_BYTES, FAN = 64 << 20, 16
#: A text that a table has so often is merged in so many tasks before it is merged in one.
HOT_ROWS, HOT_PARTS = 64, 32
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(b"  +")


def normalized(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space replaced by one space; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    return _RUNS.sub(b" ", raw) if b"  " in raw else raw


class Table:
    """Open addressing with linear probing: content -> the payload that `merge` folds."""

    def __init__(self, merge):
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.values: list = []
        self.merge = merge

    def add(self, h: int, key: bytes, value) -> int:
        """Number of the entry that holds key."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.keys[k] == key:
                self.values[k] = self.merge(self.values[k], value)
                return k
            at = (at + 1) & mask
        self.slots[at] = k = len(self.keys)
        self.hashes.append(h)
        self.keys.append(key)
        self.values.append(value)
        if 3 * len(self.keys) > 2 * len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(rows: Iterable[tuple[bytes, object]], merge, level: int = 0, table_bytes: int = TABLE_BYTES, fan: int = FAN) -> Iterator[tuple[bytes, list]]:
    """(content, values folded) of each distinct content.

    Fills a table until it holds table_bytes; if rows are left then, contents that are not in the table go
    to `fan` spill files by a hash of this level, and each file is treated alike. A file holds at most the
    distinct contents that are left and their copies, so the depth is bounded by the logarithm of the input.
    """
    table, size, files = Table(merge), 0, None
    try:
        for key, value in rows:
            h = xxhash.xxh64_intdigest(key, level)
            if files is None and size <= table_bytes:
                before = len(table.keys)
                table.add(h, key, value)
                size += (len(table.keys) > before) * (len(key) + 200)
                continue
            mask, at = len(table.slots) - 1, h & (len(table.slots) - 1)
            while (k := table.slots[at]) >= 0 and not (table.hashes[k] == h and table.keys[k] == key):
                at = (at + 1) & mask
            if k >= 0:
                table.values[k] = merge(table.values[k], value)
            else:
                files = files or [tempfile.TemporaryFile() for _ in range(fan)]
                pickle.dump((key, value), files[(h >> 40) % fan], pickle.HIGHEST_PROTOCOL)
        yield from zip(table.keys, table.values, strict=True)
        del table
        for f in files or []:
            f.seek(0)
            yield from grace(_spilled(f), merge, level + 1, table_bytes, fan)
            f.close()
    finally:
        for f in files or []:
            f.close()


def _spilled(f) -> Iterator[tuple[bytes, object]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _lower(x: int | None, y: int | None) -> int | None:
    """Smaller of two ids; null is larger than any."""
    return y if x is None or (y is not None and y < x) else x


def _own(a, b):
    """(least id, rows, slot) of rows of one task: the slot is the first row's."""
    return _lower(a[0], b[0]), a[1] + b[1], a[2]


def _all(a, b):
    """(least id, rows, slots) of what tasks have found; b's slots join a's list."""
    a[2].extend(b[2])
    return _lower(a[0], b[0]), a[1] + b[1], a[2]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so after each run of ASCII white space becomes one space; null is empty.
    keep_id is the smallest doc_id of a row's group and kept says that it is the row's own, so rows that
    repeat it with an equal text are all kept. Null doc_ids come last; in a group of nothing else keep_id is
    null and all rows are kept. An empty table gives no row.
    """
    first = "doc_id long, slot long, text_sha256 string, content binary, least long, rows long"

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in first.split(", ")]
        table, size = Table(_own), 0
        members: list[tuple[int | None, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(members), 4096):
                ids, slots = zip(*members[k : k + 4096], strict=True)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.int64()), pa.array([None] * n, pa.string()), pa.array([None] * n, pa.binary()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64())], names=names)
            for k in range(0, len(table.keys), 512):
                keys, values = table.keys[k : k + 512], table.values[k : k + 512]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * n, pa.int64()), pa.array([v[2] for v in values], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in keys]), pa.array(keys, pa.binary()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=names
                )

        for batch in parts(batches):
            for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                key = normalized(text)
                before = len(table.keys)
                k = table.add(xxhash.xxh64_intdigest(key), key, (doc_id, 1, rid))
                size += (len(table.keys) > before) * (len(key) + 200)
                members.append((doc_id, table.values[k][2]))
                if size > TABLE_BYTES or len(members) > 1 << 20:
                    yield from flush()
                    table, size, members = Table(_own), 0, []
        yield from flush()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    combined = written(rows.mapInArrow(combine, first), "exact")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
        """Contents of (slot, content, least, rows) with what _all makes of their values."""
        read = ((key, (least, n, [slot])) for batch in parts(batches) for slot, key, least, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        return grace(read, _all)

    def emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    def pre_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((slot, slots[0], key if slot == slots[0] else None, least, n) for key, (least, n, slots) in folded(batches) for slot in slots)
        return emitted(rows, FIRST_KINDS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((slot, least, n, sha) for key, (least, n, slots) in folded(batches) for sha in [hashlib.sha256(key).hexdigest()] for slot in slots)
        return emitted(rows, KINDS)

    texts = combined.where("content is not null").select("slot", "content", "least", "rows")
    # texts that a task has often meet in HOT_PARTS tasks first, so that their last task gets as many rows of them
    often = texts.where(F.col("rows") >= HOT_ROWS).repartition(F.xxhash64("content"), F.pmod(F.xxhash64("slot"), F.lit(HOT_PARTS)))
    often = written(often.mapInArrow(pre_merge, "slot long, first_slot long, content binary, least long, rows long"), "exact-often")
    rest = texts.where(F.col("rows") < HOT_ROWS).union(often.where("content is not null").select("first_slot", "content", "least", "rows"))
    groups = written(rest.repartition(F.xxhash64("content")).mapInArrow(merge, "slot long, keep_id long, group_size long, sha string"), "exact-groups")
    others = often.where("slot <> first_slot").select(F.col("slot").alias("o_slot"), "first_slot").join(groups, F.col("first_slot") == F.col("slot"))
    groups = groups.union(others.select("o_slot", "keep_id", "group_size", "sha"))
    members = combined.where("content is null").select("doc_id", F.col("slot").alias("at"))
    joined = members.join(groups, F.col("at") == F.col("slot"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


KINDS = pa.schema([("slot", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])
FIRST_KINDS = pa.schema([("slot", pa.int64()), ("first_slot", pa.int64()), ("content", pa.binary()), ("least", pa.int64()), ("rows", pa.int64())])
