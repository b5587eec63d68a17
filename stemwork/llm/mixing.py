"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target in words divided by its size is what each of its documents is expected to be taken, or
more or less by the documents' own weights if they have any. The whole part of that is taken for certain; the
rest is an inclusion probability p, and documents are ranked by the odds of a uniform number over the
odds of p. The first ones in that order, as many as the rest of the target holds, are taken once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, checkpointed, running_total

BUDGET, LIMIT, BUCKETS, SEED = 1.5, 2.0, 8192, 20240101
#: Classes of document weights in an octave.
STEPS = 8
#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1)).cast("long")


def uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) that depends on seed and `of` only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, budget: float = BUDGET, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of one row per source.

    The budget is shared by weight; a source stops at limit times its size and the excess is shared by
    weight among the others, until none is above. That is the level L with sum(min(limit * size, L * w))
    equal to the budget: sources reach their limits in the order limit * size / w.
    """
    alone = W.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(alone) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (which + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * limit).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))
    left = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.col("whole") - F.coalesce(full, F.lit(0.0))) / left
    rows = rows.withColumn("whole", budget * F.sum("source_size").over(W.partitionBy())).withColumn("level", level)
    stop = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.when(stop.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * stop["level"])).alias("target"))


def by_length() -> Column:
    """A weight that grows with the logarithm of a text's words: one of 1,000 words has 2.5 times that of one of 15."""
    return F.log2(F.col("size") + F.lit(2.0))


def _expected(goal: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """_mx_s, _mx_k, source_size, target, _mx_e: the copies that documents of a source and weight class are expected to get.

    They are in proportion to the weight, but no more than `limit`; what a limit cuts off is spread over the
    other classes of the source, until none is above. goal: source, source_size, target; classes: source,
    _mx_k and mass, the words of the documents. A class is an eighth of an octave, so a source has few.
    """
    w = W.partitionBy("source").orderBy(F.col("_mx_k").desc())
    m = F.pow(F.lit(2.0), F.col("_mx_k") / STEPS)
    rows = classes.join(goal.withColumnRenamed("source", "_mx_s"), F.col("source").eqNullSafe(F.col("_mx_s"))).withColumn("m", m)
    full = F.coalesce(F.sum("mass").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * limit
    level = F.try_divide(F.col("target") - full, F.sum(F.col("mass") * F.col("m")).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = rows.withColumn("level", level).withColumn("most", limit / F.col("m"))
    stop = F.min(F.when(F.col("level") <= F.col("most"), F.struct("most", "level"))).over(W.partitionBy("source"))
    expected = F.when(stop.isNull(), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), stop["level"] * F.col("m")))
    return rows.select("_mx_s", F.col("_mx_k").alias("_mx_c"), "source_size", "target", F.when(F.col("mass") > 0, F.greatest(expected, F.lit(0.0))).otherwise(0.0).alias("_mx_e"))


def _decided(rows: DataFrame, by: DataFrame, seed: int) -> DataFrame:
    """rows (source, size, _mx_k, _mx_i, _mx_h, ...) with what `by` says of their source and class, and _mx_sure, _mx_p, _mx_q."""
    # null-safe, since a plain equality would have every row's words counted once more to filter nulls
    out = rows.join(by, F.col("source").eqNullSafe(F.col("_mx_s")) & F.col("_mx_k").eqNullSafe(F.col("_mx_c"))).drop("_mx_s", "_mx_c")
    out = out.withColumn("_mx_sure", F.floor("_mx_e")).withColumn("_mx_p", F.when(F.col("size") > 0, F.col("_mx_e") - F.col("_mx_sure")).otherwise(0.0))
    u, p = uniform(seed, F.col("_mx_i"), F.col("_mx_h"), F.col("_mx_t")), F.col("_mx_p")
    return out.withColumn("_mx_q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))


def _numbered(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows with _mx_t: 0, or 1, 2, ... among those of equal source, _mx_i and _mx_h, which `again` has if there are any."""
    if again is None:
        return rows.withColumn("_mx_t", F.lit(0).cast("long"))
    keys = ["source", "_mx_i", "_mx_h"]
    on = [F.col(k).eqNullSafe(F.col(f"_again{n}")) for n, k in enumerate(keys)]
    marked = rows.join(again, on, "left")
    mine = [f"_again{n}" for n in range(len(keys))]
    once = marked.where(F.col("_again2").isNull()).drop(*mine).withColumn("_mx_t", F.lit(0).cast("long"))
    more = checkpointed(marked.where(F.col("_again2").isNotNull()).drop(*mine).withColumns({"_mx_one": F.lit(1), "_mx_part": F.spark_partition_id()}))
    return once.unionByName(running_total(more, keys, "_mx_part", [F.col("_mx_part")], "_mx_one", "_mx_t").drop("_mx_one", "_mx_part"))


def mix(docs: DataFrame, budget: float = BUDGET, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS, weight: Column | None = None, seed: int = SEED, narrow: bool = False) -> DataFrame:
    """docs with size, source_size, target and copies (0 to limit, rounded up) of each document.

    weight: a column by which the documents of a source share its target, to an eighth of an octave; equal if
    None, 1 where it is null or not positive. It may name columns of docs and size. A document stops at `limit` copies and the excess is shared by
    weight. Words are runs of anything but ASCII white space. Texts that are null or have no words have size 0
    and are taken for certain only. Null sources are a source, the last. Repeated rows are documents of their
    own, each with a draw of its own, and equal rows are interchangeable, so reruns agree. Columns of docs named as the new ones are replaced.
    Ranks are found on narrow rows; each source's last rank then decides on its documents where they are, so
    no text is shuffled. After the last rank that the target covers whole, the one document whose size is
    nearest to what is left is taken too, if that brings the source nearer to its target. narrow: return
    doc_id and source alone of docs' columns, from the narrow rows, so that texts are read once.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    share = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    step = F.round(F.log2(F.when(share > 0, share).otherwise(1.0)) * STEPS).cast("int")
    sized = docs.withColumn("size", words(F.col("text").cast("string")))
    sized = sized.withColumns({"_mx_k": step, "_mx_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), "_mx_h": F.xxhash64("text")})
    thin = checkpointed(sized.select("doc_id", "source", "size", "_mx_k", "_mx_i", "_mx_h"))
    again = checkpointed(thin.groupBy("source", "_mx_i", "_mx_h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source").alias("_again0"), F.col("_mx_i").alias("_again1"), F.col("_mx_h").alias("_again2")))
    again = None if again.isEmpty() else again
    thin = _numbered(thin, again)
    classes = checkpointed(thin.groupBy("source", "_mx_k").agg(F.sum("size").alias("mass")))
    goal = targets(classes.groupBy("source").agg(F.sum("mass").alias("source_size")), budget, limit, weights)
    expected = checkpointed(_expected(goal, classes, limit))

    rows = _decided(thin, expected, seed)
    sure = rows.groupBy("source").agg(F.sum(F.col("_mx_sure") * F.col("size")).alias("taken")).withColumnRenamed("source", "_s")
    drawn = rows.where("_mx_p > 0").withColumn("_mx_b", F.floor(F.col("_mx_q") / (1 + F.col("_mx_q")) * BUCKETS))
    drawn = running_total(drawn, ["source"], "_mx_b", [F.col("_mx_q"), F.col("_mx_i"), F.col("_mx_h"), F.col("_mx_t")], "size", "run")
    drawn = drawn.join(sure, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rest", F.col("target") - F.col("taken"))
    place = F.struct("_mx_q", "_mx_i", "_mx_h", "_mx_t")
    last = drawn.where("run <= rest").groupBy("source").agg(F.max(place).alias("_mx_last"), F.max("run").alias("got")).withColumnRenamed("source", "_s")
    after = drawn.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").where("_mx_last is null or run > rest")
    gap = F.col("rest") - F.coalesce(F.col("got"), F.lit(0))
    closing = after.withColumn("off", F.abs(F.col("size") - gap)).where(F.col("off") < gap)
    closing = closing.groupBy("source").agg(F.min(F.struct(F.col("off"), place.alias("at")))["at"].alias("_mx_close")).withColumnRenamed("source", "_s3")
    cuts = expected.join(last.select(F.col("_s").alias("_s2"), "_mx_last"), F.col("_mx_s").eqNullSafe(F.col("_s2")), "left").join(closing, F.col("_mx_s").eqNullSafe(F.col("_s3")), "left").drop("_s2", "_s3")
    out = _decided(thin if narrow else _numbered(sized, again), checkpointed(cuts), seed)
    taken = F.coalesce(place <= F.col("_mx_last"), F.lit(False)) | F.coalesce(place == F.col("_mx_close"), F.lit(False))
    once = (F.col("_mx_p") > 0) & taken
    return out.withColumn("copies", F.col("_mx_sure") + once.cast("long")).drop("_mx_k", "_mx_i", "_mx_h", "_mx_t", "_mx_e", "_mx_sure", "_mx_p", "_mx_q", "_mx_last", "_mx_close")
