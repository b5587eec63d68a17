"""MinHash near-deduplication by an LSH forest, with every link confirmed on full sets.

Each distinct set of word shingles has TREES signatures of DEEPEST minima. A tree is the order of all sets by
one of these signatures: sets that share a prefix of it lie together, the longer the prefix the closer. A
set's candidates are its neighbours in each order, those with the longest common prefix, if that has SHALLOW
minima at least. So the depth adapts to each region: where few sets share a prefix a short one makes
neighbours, where thousands do neighbours share a long one, and copies by the thousand give pairs by the
thousand and not by the million. A pair at the threshold shares SHALLOW minima in some tree with a probability
of 1 - (1 - 0.75**4)**32, all but 5 in a million; more similar ones with a higher one.

Candidates are confirmed in two passes. First each set is compared with the neighbour that it shares most minima
with over all trees, and links make components. Then the orders are gone through again, and neighbours whose
components differ are compared, since a link inside a component changes nothing.

What is left are pairs that share a prefix but are neighbours in no tree, because a region is dense, and whose
components still differ. They are found exactly by prefix filtering: of the sets in regions with several
components, two that link share a shingle among the first n - ceil(0.75 n) + 1 of either in the order (how many
of these sets have it, hash). Rare shingles come first, so sets that share a passage but are no copies of each
other don't meet; shingles of one component only are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import bucketed, checkpointed, least_nodes, likely, parts, written

WORDS, PERCENT, TREES, SHALLOW, DEEPEST, SEED = 5, 75, 32, 4, 8, 7
#: Sets that follow a set in an order and are its neighbours, in the first pass and in the second.
REACH = (1, 2)
EDGES_A_TASK = 100_000
_RNG = np.random.default_rng(SEED)
_ODD = lambda n: _RNG.integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _MUL, _ADD = _ODD(64), _ODD(TREES * DEEPEST), _ODD(TREES * DEEPEST)
_SHIFT = np.arange(48, -1, -16, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of all words, if fewer; none without words.

    Words are what ASCII white space separates, A to Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(w) <= size:
        return _mixed(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    n = len(w) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += w[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """TREES rows of DEEPEST minima."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        low = np.minimum(low, (s[None, k : k + 512] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return low.reshape(TREES, DEEPEST)


def labels_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of each tree as two longs: 16 bits a minimum, the first SHALLOW minima in the first long."""
    parts = _mixed(sig) & np.uint64(0xFFFF)
    pack = lambda p: (p << _SHIFT).sum(axis=1, dtype=np.uint64).view(np.int64)
    return pack(parts[:, :SHALLOW]), pack(parts[:, SHALLOW:])


def sketched(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (digest of the set), hi and lo (labels by tree); written."""
    schema = "doc_id long, n long, s1 long, s2 long, hi array<long>, lo array<long>"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in parts(batches):
            n, digests, hi, lo = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                x, y = labels_of(signature(s)) if len(s) else (none, none)
                hi.append(x)
                lo.append(y)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(hi, kind), pa.array(lo, kind)], names=names)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "sketches")


def _neighbours(rows: np.ndarray, new: int, reach: int, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, depth, fits) of neighbours up to `reach` apart in sorted rows (t, hi, lo, uid, c, n) whose c differ; b is among the last `new`."""
    count = len(rows)
    for step in range(1, reach + 1):
        first = max(0, count - new - step)
        x, y = rows[first : count - step], rows[first + step :]
        hit = (x[:, 0] == y[:, 0]) & (x[:, 1] == y[:, 1]) & (x[:, 4] != y[:, 4])
        x, y = x[hit], y[hit]
        apart = (x[:, 2] ^ y[:, 2]).view(np.uint64)
        fits = 100 * np.minimum(x[:, 5], y[:, 5]) >= percent * np.maximum(x[:, 5], y[:, 5])
        yield x[:, 3], y[:, 3], SHALLOW + sum((apart >> s == 0).astype(np.int64) for s in _SHIFT), fits.astype(np.int64)


def forest(sets: DataFrame, reach: int, percent: int = PERCENT) -> DataFrame:
    """a, b, depth, fits: neighbours in each tree whose c differ, the length of their common prefix, and whether their sizes allow a link.

    sets: uid, c, n, hi, lo. Rows are dealt by ranges of (tree, label, uid), so no label is a task's alone. The
    rows at both ends of each range are compared with those of the next one apart from the others.
    """
    schema = "a long, b long, depth long, fits long, t long, hi long, lo long, uid long, c long, n long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    keys, none = names[4:], lambda n: [pa.nulls(n, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = lambda rows: pa.RecordBatch.from_arrays(none(len(rows)) * 4 + [pa.array(rows[:, i]) for i in range(len(keys))], names=names)
        last, seen = np.empty((0, len(keys)), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if seen < reach:
                yield ends(new[: reach - seen])
            rows = np.concatenate([last, new])
            for found in _neighbours(rows, len(new), reach, percent):
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), *none(len(found[0])) * len(keys)], names=names)
            seen += len(new)
            last = rows[-reach:]
        yield ends(last[max(0, len(last) - max(0, seen - reach)) :])

    trees = F.explode(F.arrays_zip(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long")).alias("t"), "hi", "lo"))
    order = sets.select("uid", "c", "n", trees.alias("x")).select("x.t", "x.hi", "x.lo", "uid", "c", "n")
    found = written(order.repartitionByRange(*keys[:4]).sortWithinPartitions(*keys[:4]).mapInArrow(run, schema), "neighbours")
    inside = found.where("a is not null").select("a", "b", "depth", "fits")
    ends = found.where("a is null").select(*keys)
    w = W.partitionBy("t").orderBy("hi", "lo", "uid")
    for step in range(1, reach + 1):
        pairs = ends.withColumn("y", F.lead(F.struct(*keys), step).over(w)).where("y.hi = hi and y.c <> c")
        apart = F.col("lo").bitwiseXOR(F.col("y.lo"))
        depth = SHALLOW + sum(((F.shiftrightunsigned(apart, int(s)) == 0).cast("long") for s in _SHIFT), F.lit(0).cast("long"))
        inside = inside.union(pairs.select("uid", "y.uid", depth, _fits("n", "y.n", percent).cast("long")))
    return inside


def shingle_sets(docs: DataFrame, chosen: DataFrame, size: int = WORDS) -> DataFrame:
    """uid, n, s (sorted shingles) of the documents whose doc_id is a uid of chosen and whose text has words; in buckets by uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            s = [shingles(x, size).view(np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, s), pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["uid", "n", "s"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = likely(docs.select(F.col("doc_id").cast("long").alias("uid"), F.col("text").cast("string").alias("text")), chosen, "uid")
    # an inner join, since Spark would move a semi-join ahead of the filter; chosen has a uid once
    some = some.repartition(n, "uid").join(chosen.select("uid"), "uid").dropDuplicates(["uid", "text"])
    return bucketed(some.mapInArrow(run, "uid long, n long, s array<long>").where("n > 0"), "sets", "uid")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union. sets: uid, n, s.

    Only pairs move, the second time with a's set.
    """
    x = sets.select(F.col("uid").alias("a"), F.col("n").alias("a_n"), F.col("s").alias("a_s"))
    y = sets.select(F.col("uid").alias("b"), F.col("n").alias("b_n"), F.col("s").alias("b_s"))
    both = pairs.select("a", "b").hint("shuffle_merge").join(x, "a").hint("shuffle_merge").join(y, "b").where(_fits("a_n", "b_n", percent))
    both = both.withColumn("same", F.size(F.array_intersect("a_s", "b_s")))
    return both.where(100 * F.col("same") >= percent * (F.col("a_n") + F.col("b_n") - F.col("same"))).select("a", "b")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars: each node but the least of its component here, with that one."""
    held = [np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches]
    edges = np.concatenate([np.empty((0, 2), np.int64), *held])
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    least = least_nodes(len(nodes), at[:, 0], at[:, 1])
    inner = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[least[inner]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of edges (a, b): union-find in each task, then alternating large and small stars across tasks.

    A task holds about EDGES_A_TASK edges, so few edges are one task's and need no stars, and many don't
    cross the wire in pieces of a few rows. Rounds end when a whole one changes nothing.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"))
    n = 1 + edges.count() // EDGES_A_TASK
    few = lambda df: df.coalesce(n)
    stars = lambda df: checkpointed(few(df).mapInArrow(_contracted, "u long, v long"))
    state, last = stars(edges), None
    while n > 1:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = few(state).select(F.explode(ends).alias("e")).select("e.u", "e.v")
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v")))).distinct()
        state = stars(small)
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that a link allows."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (uid, ...) with c, the component that links make of each."""
    return nodes.drop("c").join(components(links), F.col("uid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "uid")).drop("node", "component")


def unseen(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of nodes (uid, c, hi, lo) of different components that may link and that the forest can't have compared.

    Nodes of regions with more than REACH[1] + 1 sets and several components are in question.
    """
    flat = nodes.select("uid", "c", F.posexplode("hi").alias("t", "hi"))
    mixed = flat.groupBy(F.col("t").alias("m_t"), F.col("hi").alias("m_hi")).agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("top")).where(f"m > {REACH[1] + 1} and low <> top")
    open_ = flat.join(mixed, (F.col("t") == F.col("m_t")) & (F.col("hi") == F.col("m_hi")), "left_semi").select("uid", "c").distinct()
    held = checkpointed(open_).join(sets, "uid").select("uid", "c", "n", F.explode("s").alias("s"))
    common = held.groupBy(F.col("s").alias("f_s")).agg(F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("top")).where("df > 1")
    ranked = held.join(common, F.col("s") == F.col("f_s")).select("uid", "c", "n", F.struct("df", "s", (F.col("low") != F.col("top")).alias("apart")).alias("x"))
    sorted_ = ranked.groupBy("uid", "c", "n").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    alone = F.col("n") - F.size("xs")  # shingles that no other set has come first
    spare = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    first = sorted_.withColumn("alone", alone).select("uid", "c", "n", "alone", F.posexplode(F.slice("xs", F.lit(1), F.greatest(F.lit(0), spare - F.col("alone")).cast("int"))).alias("k", "x"))
    posts = first.where("x.apart").select("uid", "c", "n", (F.col("alone") + F.col("k")).alias("p"), "x.s")
    left = posts.select(F.col("uid").alias("a"), F.col("c").alias("a_c"), F.col("n").alias("a_n"), F.col("p").alias("a_p"), F.col("s").alias("a_s"))
    # the first shingle that a linked pair shares leaves as many from it on in either set as the intersection needs
    ahead = lambda n, p: (100 + percent) * (F.col(n) - F.col(p)) >= percent * (F.col("a_n") + F.col("n"))
    met = left.join(posts, (F.col("a_s") == F.col("s")) & (F.col("a") < F.col("uid")) & (F.col("a_c") != F.col("c")) & _fits("a_n", "n", percent) & ahead("a_n", "a_p") & ahead("n", "p"))
    return met.select("a", F.col("uid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked if their sets of word shingles have 100 * intersection >= percent * union; component_id
    is the smallest doc_id that links lead to, its own included, and kept says that it is its own. Texts
    that are null, empty or without words have no shingles and are linked with nothing. Rows of one doc_id
    with different texts are linked by that. A row with a null doc_id names no component: it belongs to that of
    a row with an equal set, if there is one, and else has a null component_id and is kept; it links no other
    rows. Other columns are not read.
    """
    sketches = sketched(docs, size)
    own = sketches.where("n > 0")
    firsts = own.groupBy("s1", "s2").agg(F.min("doc_id").alias("uid"))
    with_uid = own.join(firsts.withColumnsRenamed({"s1": "z1", "s2": "z2"}), (F.col("s1") == F.col("z1")) & (F.col("s2") == F.col("z2")))
    nodes = checkpointed(with_uid.where("doc_id = uid").dropDuplicates(["s1", "s2"]).select("uid", F.col("uid").alias("c"), "n", "hi", "lo"))
    near = forest(nodes, REACH[0], percent).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("fits").alias("fits"), F.sum("depth").alias("w"))
    sides = near.withColumn("x", F.explode(F.array(F.struct(F.col("a").alias("uid"), F.col("b").alias("o")), F.struct(F.col("b").alias("uid"), F.col("a").alias("o")))))
    best = checkpointed(sides.groupBy("x.uid").agg(F.max(F.struct("fits", "w", "x.o")).alias("m")).select("uid", "m.fits", "m.o"))
    close = checkpointed(nodes.join(best.select("uid"), "uid", "left_semi"))
    sets = shingle_sets(docs, best.select("uid"), size)
    pairs = checkpointed(best.where("fits = 1").select(F.least("uid", "o").alias("a"), F.greatest("uid", "o").alias("b")).distinct())
    links = checkpointed(confirmed(pairs, sets, percent))

    close = checkpointed(_labelled(close, links))
    second = forest(close, REACH[1], percent).where("fits = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = checkpointed(links.union(confirmed(second.join(pairs, ["a", "b"], "left_anti"), sets, percent)))

    close = checkpointed(_labelled(close, links))
    links = checkpointed(links.union(confirmed(unseen(close, sets, percent), sets, percent)))

    again = own.groupBy(F.col("doc_id").alias("same")).agg(F.min(F.struct("s1", "s2")).alias("low"), F.max(F.struct("s1", "s2")).alias("top")).where("low <> top").select("same")
    twice = with_uid.join(again, F.col("doc_id") == F.col("same"), "left_semi").where("uid <> doc_id").select(F.col("doc_id").alias("a"), F.col("uid").alias("b"))
    found = components(links.union(twice))
    whole = with_uid.select("doc_id", "n", "uid").join(found, F.col("uid") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "uid").alias("c"))
    empty = sketches.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("c"))
    return whole.union(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("c")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, less every row but one of each component of near_duplicates.

    Rows are numbered. Those with a null doc_id go by numbers above all doc_ids, so they link like others and
    come last; of several rows of the doc_id that stays, the first with words does. Rows without words and
    doc_id are linked with nothing.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    top = rows.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(top).cast("long") + 1 + F.col("_row"))
    found = near_duplicates(rows.select(name.alias("doc_id"), "text"), size, percent).where("kept")
    kept = found.select(F.col("doc_id").alias("k"), (F.col("n_shingles") > 0).alias("k_some")).distinct()
    some = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = rows.select("_row", name.alias("i"), some.alias("some")).join(kept, (F.col("i") == F.col("k")) & (F.col("some") == F.col("k_some")))
    stays = named.groupBy("i").agg(F.min(F.struct((~F.col("some")).alias("none"), "_row")).alias("m")).select(F.col("m._row").alias("s_row"))
    return rows.join(stays, F.col("_row") == F.col("s_row"), "left_semi").drop("_row")
