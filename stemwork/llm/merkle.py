"""Merkle manifest of a dataset: a digest of every row, of every group and of the whole, and proofs of single rows.

Rows are sorted by range over (group, order), so a group is a stretch of neighbouring partitions. Counts of the
groups at either end of each partition, one row a partition, are all that is needed to know where a
partition's leaves stand in their groups. Each partition then builds the subtrees that are complete within it,
in one pass that holds less than `fanout` nodes a level. Nodes whose parent reaches into another partition, at
most 2 * fanout a level and partition, are shuffled by their coordinate (group, level, place), level by level,
until each group has one node left. The groups' own digests are leaves of a last tree that is built alike.

Proofs come back down: a node hands what stands beside it, and what its parent was handed, to its children;
those that a partition made meet its leaves again, and the partition completes the proofs of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, parts, written

FANOUT = 8
NODE = "struct<left:string,right:string>"
_NODES = "pid int, g string, size long, level int, place long, digest string"


def digest(parts_of: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(parts_of, 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The leaf of a row with these values."""
    return digest(F.concat(*map(field, values)))


def _joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def folded(leaf_digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with what stands left and right of it on each level."""
    for left, right in path:
        leaf_digest = hashlib.sha256(f"{left}{leaf_digest}{right}".encode()).hexdigest()
    return leaf_digest


def local_levels(first: int, leaves: list[str], size: int, fanout: int) -> list[tuple[int, list[str], int, int]]:
    """(place of the first node, nodes, lo, hi) of each level that leaves first, first + 1, ... of `size` give alone; nodes[lo:hi] have parents here."""
    levels, nodes = [], leaves
    while nodes:
        if size == 1:
            levels.append((first, nodes, 0, 0))
            break
        lo = min(-first % fanout, len(nodes))
        hi = len(nodes) if first + len(nodes) == size else lo + (len(nodes) - lo) // fanout * fanout
        levels.append((first, nodes, lo, hi))
        first, nodes, size = (first + lo) // fanout, [_joined(nodes[k : min(k + fanout, hi)]) for k in range(lo, hi, fanout)], -(-size // fanout)
    return levels


def _paths(levels: list[tuple[int, list[str], int, int]], fanout: int, handed: dict[tuple[int, int], list]) -> list[list[tuple[str, str]]]:
    """The path of each leaf: what stands beside it and its parents, level by level, ending with what the uppermost node here was handed."""
    above: list[list] = []
    for level in range(len(levels) - 1, -1, -1):
        first, nodes, lo, hi = levels[level]
        here: list = [None] * len(nodes)
        for k in [*range(lo), *range(hi, len(nodes))]:
            here[k] = handed[level, first + k]
        for k in range(lo, hi, fanout):
            run, up = nodes[k : min(k + fanout, hi)], above[(k - lo) // fanout]
            for j in range(len(run)):
                here[k + j] = [("".join(run[:j]), "".join(run[j + 1 :])), *up]
        above = here
    return above


@dataclass
class Manifest:
    """leaves: pid, seq, g, leaf and what came along, sorted by range; ends: see _ends; ragged: nodes that partitions made
    without their parents; levels: the nodes above those, with their runs; groups: g, size, digest."""

    leaves: DataFrame
    ends: dict
    ragged: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    partitions: int
    fanout: int


def _ends(leaves: DataFrame) -> dict[int, tuple[str, int, int, str, int]]:
    """For each partition the group of its first row, how many leaves of it come before, its size, and the last row's group and size.

    One row a partition comes to the driver, since a group that is neither first nor last in a partition lies whole in it.
    """
    counts = leaves.groupBy("pid", "g").agg(F.count("*").alias("n"))
    ends = counts.groupBy("pid").agg(F.min(F.struct("g", "n")).alias("a"), F.max(F.struct("g", "n")).alias("z"))
    rows = sorted((r["pid"], r["a"]["g"], r["a"]["n"], r["z"]["g"], r["z"]["n"]) for r in ends.collect())
    size: dict[str, int] = {}
    before = []
    for _, a, n, z, m in rows:
        before.append(size.get(a, 0))
        size[a] = size.get(a, 0) + n
        if z != a:
            size[z] = m
    return {pid: (a, k, size[a], z, size[z]) for (pid, a, _, z, _), k in zip(rows, before)}


def _stretch(ends: dict, pid: int, g: str, n: int) -> tuple[int, int]:
    """The place of the first of n leaves that a partition has of a group, and the group's size."""
    a, before, size_a, z, size_z = ends[pid]
    return (before, size_a) if g == a else (0, size_z if g == z else n)


def _by_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[pa.RecordBatch]]]:
    """pid, group and batches of each stretch of rows that agree in these."""
    here, held = None, []
    for batch in parts(batches, 8192):
        keys = list(zip(batch.column("pid").to_pylist(), batch.column("g").to_pylist()))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for k, end in zip(cuts, cuts[1:]):
            if k == end:
                continue
            if held and keys[k] != here:
                yield (*here, held)
                held = []
            here = keys[k]
            held.append(batch.slice(k, end - k))
    if held:
        yield (*here, held)


def _subtrees(ends: dict, fanout: int):
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    names = [c.split()[0] for c in _NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pid, g, held in _by_stretch(batches):
            leaves = [x for b in held for x in b.column("leaf").to_pylist()]
            first, size = _stretch(ends, pid, g, len(leaves))
            for level, (at, nodes, lo, hi) in enumerate(local_levels(first, leaves, size, fanout)):
                out += [(pid, g, size, level, at + k, nodes[k]) for k in [*range(lo), *range(hi, len(nodes))]]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _height(size: int, fanout: int) -> int:
    height = 0
    while size > 1:
        size, height = -(-size // fanout), height + 1
    return height


def build(rows: DataFrame, order: list[Column], fanout: int = FANOUT) -> Manifest:
    """The trees of rows (g, leaf, and more that comes along), g never null, the leaves of a group in `order`."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are interchangeable, but must not be one key of the ranges
    spread = F.monotonically_increasing_id().alias("_mk_spread")
    ranged = rows.select("*", spread).repartitionByRange(n, F.col("g"), *order, F.col("leaf"), F.col("_mk_spread"))
    ranged = ranged.sortWithinPartitions("g", *order, "leaf", "_mk_spread").drop("_mk_spread")
    ranged = ranged.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq"))
    leaves = checkpointed(ranged)
    ends = _ends(leaves)
    ragged = checkpointed(leaves.select("pid", "g", "leaf").mapInArrow(_subtrees(ends, fanout), _NODES))
    tallest = max([_height(size, fanout) for _, _, a, _, z in ends.values() for size in (a, z)], default=0)

    tops = ragged.withColumn("levels", _levels(F.col("size"), fanout))
    levels, built = [], None
    for level in range(tallest):
        now = tops.where((F.col("level") == level) & (F.col("levels") > level)).select("g", "size", "levels", "place", "digest", "pid")
        if built is not None:
            now = now.unionByName(built.where(F.col("levels") > level).select("g", "size", "levels", "place", "digest", F.lit(None).cast("int").alias("pid")))
        run = F.array_sort(F.collect_list(F.struct("place", "digest", "pid")))
        up = now.groupBy("g", "size", "levels", F.floor(F.col("place") / fanout).alias("place")).agg(run.alias("run"))
        built = checkpointed(up.withColumn("digest", digest(F.array_join("run.digest", ""))))
        levels.append(built)
    ends_of = [tops.where(F.col("level") == F.col("levels")).select("g", "size", "digest")]
    ends_of += [x.where(F.col("levels") == k + 1).select("g", "size", "digest") for k, x in enumerate(levels)]
    groups = ends_of[0]
    for x in ends_of[1:]:
        groups = groups.unionByName(x)
    return Manifest(leaves, ends, ragged, levels, checkpointed(groups), max(1, leaves.rdd.getNumPartitions()), fanout)


def _levels(size: Column, fanout: int) -> Column:
    """Levels above the leaves, counted in whole numbers."""
    out, reach = F.lit(0), 1
    while reach < 1 << 62:
        out = out + (size > reach).cast("int")
        reach *= fanout
    return out


def handed_down(tree: Manifest, tops: DataFrame) -> DataFrame:
    """pid, g, level, place, up and the columns of tops for every node that a partition made without its parent.

    tops: g, up (what stands beside the group's digest, level by level) and more columns. up is an array of (left, right).
    """
    more = [c for c in tops.columns if c not in ("g", "up")]
    sides = lambda test: F.array_join(F.transform(F.filter("run", test), lambda x: x["digest"]), "")
    alone = tree.ragged.where(F.col("level") == _levels(F.col("size"), tree.fanout)).select("pid", "g", "level", "place")
    out = alone.join(tops, "g")
    handed = None
    for level in range(len(tree.levels) - 1, -1, -1):
        parents = tree.levels[level]
        begin = parents.where(F.col("levels") == level + 1).select("g", "place", "run").join(tops, "g")
        if handed is not None:
            going_on = handed.where("pid is null").select("g", "place", "up", *more)
            begin = begin.unionByName(parents.where(F.col("levels") > level + 1).select("g", "place", "run").join(going_on, ["g", "place"]))
        each = begin.select("g", "run", "up", *more, F.explode("run").alias("x"))
        beside = F.struct(sides(lambda y: y["place"] < F.col("x.place")).alias("left"), sides(lambda y: y["place"] > F.col("x.place")).alias("right"))
        handed = checkpointed(each.select(F.col("x.pid").alias("pid"), "g", F.lit(level).alias("level"), F.col("x.place").alias("place"), F.concat(F.array(beside), "up").alias("up"), *more))
        out = out.unionByName(handed.where("pid is not null").select(out.columns))
    return out


def _completed(tree: Manifest, tops: DataFrame, keep: list[str], kinds: str, derive) -> DataFrame:
    """The leaves' columns `keep` and what derive(rows of a stretch, group's columns, paths) adds as the columns of `kinds`.

    The rows of a partition are streamed; those of one group are held, so a partition must fit its task.
    """
    ends, fanout, more = tree.ends, tree.fanout, [c for c in tops.columns if c not in ("g", "up")]
    nodes = handed_down(tree, tops).withColumns({"is_leaf": F.lit(False), "seq": F.lit(0).cast("long")})
    leaves = tree.leaves.withColumn("is_leaf", F.lit(True))
    both = nodes.unionByName(leaves, allowMissingColumns=True).repartitionById(tree.partitions, F.col("pid")).sortWithinPartitions("pid", "g", "is_leaf", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        for pid, g, held in _by_stretch(batches):
            handed, group, mine = {}, None, []
            for batch in held:
                is_leaf = batch.column("is_leaf").to_pylist()
                n = is_leaf.index(True) if True in is_leaf else len(is_leaf)
                for row in batch.slice(0, n).select(["level", "place", "up", *more]).to_pylist():
                    handed[row["level"], row["place"]] = [(x["left"], x["right"]) for x in row["up"]]
                    group = group or {c: row[c] for c in more}
                mine.append(batch.slice(n))
            rows = pa.Table.from_batches(mine)
            digests = rows.column("leaf").to_pylist()
            first, size = _stretch(ends, pid, g, len(digests))
            paths = _paths(local_levels(first, digests, size, fanout), fanout, handed)
            added = derive(rows, group, paths)
            ready += pa.Table.from_arrays([*(rows.column(c) for c in keep), *added.values()], names=[*keep, *added]).to_batches()
            if sum(b.num_rows for b in ready) >= 4096:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    types = {f.name: f.dataType.simpleString() for f in tree.leaves.schema}
    return both.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), kinds]))


def _with_paths(rows: pa.Table, group: dict, paths: list) -> dict[str, pa.Array]:
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    path = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind)
    return {c: pa.array([v] * len(paths), pa.string()) for c, v in group.items()} | {"path": path}


def _verified(rows: pa.Table, group: dict, paths: list) -> dict[str, pa.Array]:
    proof = [hashlib.sha256("".join(a + b for a, b in p).encode()).hexdigest() for p in paths]
    again = [folded(x, p) for x, p in zip(rows.column("seen").to_pylist(), paths)]
    same = {c: pa.array([v] * len(paths), pa.string()) for c, v in group.items()}
    return same | {"proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(again, pa.string()), "verified": pa.array([x == group["root"] for x in again], pa.bool_())}


@dataclass
class Dataset:
    """The digest of a dataset (None if it has no row), the trees of its groups, and tops: g, up, subroot, root of each group."""

    root: str | None
    tree: Manifest
    tops: DataFrame

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root and path, the array of (left, right) by which folded() gets from leaf to root."""
        return _completed(self.tree, self.tops, ["doc_id", "leaf"], f"subroot string, root string, path array<{NODE}>", _with_paths)

    def verified(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the leaf as seen, with the proof of the original) and verified."""
        return _completed(self.tree, self.tops, ["doc_id", "leaf"], "subroot string, root string, proof_sha256 string, folded_root string, verified boolean", _verified)


def manifest(docs: DataFrame, seen_text: Column | None = None, fanout: int = FANOUT) -> Dataset:
    """The manifest of documents (doc_id, source, lang, n_chars, text) grouped by lang, ordered by doc_id.

    seen_text: the text as it is found when proofs are verified; the text itself if None. Null langs are a group, the
    first; null doc_ids come first in their group; rows with equal doc_id are ordered by their leaf, and equal
    rows are leaves of their own, so the manifest of a table doesn't depend on how it is stored. Extra columns are no part of
    a leaf. A table without rows has no root and no proofs.
    """
    values = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    text = F.col("text").cast("string")
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    seen = leaf(*values, text if seen_text is None else seen_text)
    rows = docs.select(group.alias("g"), values[0].alias("doc_id"), leaf(*values, text).alias("leaf"), seen.alias("seen"))
    tree = build(written(rows, "leaves"), [F.col("doc_id").asc_nulls_first()], fanout)
    above = build(tree.groups.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("digest").alias("leaf")), [F.col("of")], fanout)
    found = above.groups.first()
    root = found["digest"] if found else None
    start = above.groups.select("g", F.array().cast(f"array<{NODE}>").alias("up"))
    paths = _completed(above, start, ["of", "leaf"], f"path array<{NODE}>", _with_paths)
    tops = checkpointed(paths.select(F.col("of").alias("g"), F.col("path").alias("up"), F.col("leaf").alias("subroot"), F.lit(root).cast("string").alias("root")))
    return Dataset(root, tree, tops)


def tampered() -> Column:
    """The text in lower case (A to Z alone) where 3 divides the CRC-32 of the decimal doc_id, else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.col("text").cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)
