"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

Lines that aren't blank are hashed. Two windows belong to each line: one starts there and ends with the
line that brings it to MIN_WORDS words, one ends there and starts likewise. The longest line of a window,
by hash and then the last among equals, is its minimum; a repeated run of MIN_WORDS words or more holds a window
whole, so it holds that window's minimum at every place: minima that occur at one place only are no part of a run, and
their windows go. The key of those left certifies all lines of the window by two 64-bit hashes of their sequence, since lines
that many texts share may be minima without being in a run, and pairing all their places would be quadratic.

Windows meet the first place of their key. A run that came before is the union of its windows that did, so matches are
extended both ways by chaining windows that overlap or touch, in one pass over each document's windows,
however often a document repeats itself; what came later is deleted. Order is by doc_id and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, written

MIN_WORDS = 25


def _lines(text: Column) -> Column:
    """Array of (pos, lh, l2, nw) of the lines that aren't blank: place, two hashes of the normalized line, words."""
    plain = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    size = lambda y: F.when(y == "", 0).otherwise(F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).cast("long")
    made = F.transform(plain, lambda y, k: F.struct(k.alias("pos"), F.xxhash64(y).alias("lh"), F.xxhash64(y, F.lit(1)).alias("l2"), size(y).alias("nw")))
    return F.filter(made, lambda s: s["nw"] > 0)


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """i, h (keys of a document), lh (hash of the minimum), at (its place), k1, k2 (key), from, to (places of the first and last line), first, final (the same without blank lines)."""
    rows = _keyed(docs).select("i", "h", _lines(F.col("text")).alias("lines")).dropDuplicates(["i", "h"]).where(F.size("lines") > 0)
    flat = rows.select("i", "h", F.posexplode("lines").alias("seq", "line")).select("i", "h", "seq", "line.*")
    place = W.partitionBy("i", "h").orderBy("pos")
    flat = flat.withColumns({"upto": F.sum("nw").over(place.rowsBetween(W.unboundedPreceding, 0)), "whole": F.sum("nw").over(W.partitionBy("i", "h"))})
    flat = flat.withColumn("before", F.col("upto") - F.col("nw"))
    starting = W.partitionBy("i", "h").orderBy("before").rangeBetween(0, min_words - 1)
    ending = W.partitionBy("i", "h").orderBy("upto").rangeBetween(1 - min_words, 0)
    least = F.min(F.struct((-F.least("nw", F.lit(min_words))).alias("short"), "lh", (-F.col("pos")).alias("last")))

    def picked(window, full: Column) -> Column:
        low = least.over(window)
        return F.when(full, F.struct(low["lh"].alias("lh"), (-low["last"]).alias("at"), F.xxhash64(F.collect_list("lh").over(window)).alias("k1"), F.xxhash64(F.collect_list("l2").over(window)).alias("k2"), F.min("pos").over(window).alias("from"), F.max("pos").over(window).alias("to"), F.min("seq").over(window).alias("first"), F.max("seq").over(window).alias("final")))

    found = F.array(picked(starting, F.col("whole") - F.col("before") >= min_words), picked(ending, F.col("upto") >= min_words))
    return flat.select("i", "h", found.alias("found")).select("i", "h", F.explode(F.array_distinct(F.array_compact("found"))).alias("p")).select("i", "h", "p.*")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """i, h (keys of a document), runs: array of (from, to), the line numbers of its later repeated runs."""
    found = written(windows(docs, min_words), "windows")
    minima = found.groupBy(F.col("lh").alias("m_lh")).agg(F.min(F.struct("i", "h", "at")).alias("low"), F.max(F.struct("i", "h", "at")).alias("top")).where("low <> top").select("m_lh")
    held = found.join(minima, F.col("lh") == F.col("m_lh"), "left_semi")
    firsts = held.groupBy(F.col("k1").alias("f_k1"), F.col("k2").alias("f_k2")).agg(F.min(F.struct("i", "h", "from")).alias("f"), F.max(F.struct("i", "h", "from")).alias("last")).where("f <> last").drop("last")
    later = held.join(firsts, (F.col("k1") == F.col("f_k1")) & (F.col("k2") == F.col("f_k2"))).where(F.struct("i", "h", "from") > F.col("f"))
    place = W.partitionBy("i", "h").orderBy("from", "to").rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce(F.col("first") > F.max("final").over(place) + 1, F.lit(True))
    chained = later.select("i", "h", "from", "to", "first", "final").withColumn("opens", opens).withColumn("run", F.sum(F.col("opens").cast("int")).over(W.partitionBy("i", "h").orderBy("from", "to").rowsBetween(W.unboundedPreceding, 0)))
    runs = chained.groupBy("i", "h", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return runs.groupBy("i", "h").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1).cast("long")).alias("i"), F.xxhash64("text").alias("h"), text.alias("text"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all rows and columns, with text less its later repeated runs, and lines and lines_dropped.

    Lines end at line feeds and compare equal when they are so after runs of ASCII white space become one
    space, ends trimmed. Blank lines inside a deleted run go with it (runs that touch are one), others stay. Null texts stay null,
    and have one (blank) line, as empty ones; null doc_ids come last. Rows with equal doc_id and text are
    one document and are treated alike. Columns i, h and runs of docs are kept.
    """
    mine = ["_ld_i", "_ld_h", "_ld_runs"]
    runs = repeated_runs(docs, min_words).select(F.col("i").alias(mine[0]), F.col("h").alias(mine[1]), F.col("runs").alias(mine[2]))
    i, h = F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1).cast("long")), F.xxhash64(docs["text"])
    rows = docs.join(runs, (i == F.col(mine[0])) & (h == F.col(mine[1])), "left")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda _, k: ~F.exists(mine[2], lambda r: k.between(r["from"], r["to"])))
    hit = F.col(mine[2]).isNotNull()
    n = F.size(lines).cast("long")
    rows = rows.withColumns({"lines": n, "_ld_kept": F.when(hit, kept)})
    rows = rows.withColumns({"text": F.when(hit, F.array_join("_ld_kept", "\n")).otherwise(F.col("text")), "lines_dropped": F.when(hit, n - F.size("_ld_kept")).otherwise(F.lit(0)).cast("long")})
    return rows.drop(*mine, "_ld_kept")
