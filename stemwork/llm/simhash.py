"""SimHash fingerprints and permuted block tables, with DataFrame functions only.

A document's terms are its pairs of neighbouring words, weighted by the length of both. The 128 bits of
each term's hash vote up or down, with the term's weight, on the 128 bits of the fingerprint. Votes are
counted in 44 sums of which each holds three counters of 21 bits, which generated code adds up at once; a
counter holds CHUNK terms, and longer documents are counted chunk by chunk.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, checkpointed, likely

BITS, LANE, HEAVIEST = 128, 21, 16
CHUNK = (1 << LANE) // HEAVIEST - 1
#: Hamming radius of the search, and blocks of 16 bits: within the radius at least BLOCKS - RADIUS are equal.
RADIUS, BLOCKS = 6, 8
#: Neighbours in the order of doc_id are found in buckets of about so many rows; quantiles, and parts of each, at most.
BUCKET_ROWS, MOST_BUCKETS, MOST_PARTS = 200, 4096, 64


def terms(text: Column) -> Column:
    """Array of (hash, weight) of pairs of neighbouring words; the last word pairs with nothing."""
    words = F.array_remove(F.split(text, SPACE), "")
    size = lambda w: F.coalesce(F.length(w), F.lit(0))
    return F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.least(F.lit(HEAVIEST), size(a) + size(b)).cast("long").alias("w")))


def fingerprints(rows: DataFrame, keys: list[str], term: str) -> DataFrame:
    """keys, hi, lo: the fingerprint of the terms (h, w) in the array column `term`, by keys.

    hi and lo are the bits as two longs; no terms give 0. Rows with one key are counted together.
    """
    exploded = rows.select(*keys, F.posexplode_outer(term).alias("at", "t")).select(*keys, (F.coalesce("at", F.lit(0)) / CHUNK).cast("int").alias("chunk"), F.coalesce("t.h", F.lit(0)).alias("h0"), F.coalesce("t.w", F.lit(0)).alias("w"))
    exploded = exploded.withColumn("h1", F.xxhash64("h0", F.lit(1)))

    def lanes(h: str, k: int) -> Column:
        three = F.shiftrightunsigned(h, 3 * k).bitwiseAND(7)
        spread = three.bitwiseAND(1) + F.shiftleft(three.bitwiseAND(2), LANE - 1) + F.shiftleft(three.bitwiseAND(4), 2 * LANE - 2)
        return F.sum(spread * F.col("w"))

    sums = [lanes(f"h{i}", k).alias(f"s{i}_{k}") for i in range(2) for k in range(22)]
    packed = exploded.groupBy(*keys, "chunk").agg(F.sum("w").alias("all"), *sums)
    count = lambda i, j: F.shiftrightunsigned(f"s{i}_{j // 3}", LANE * (j % 3)).bitwiseAND((1 << LANE) - 1)
    votes = packed.groupBy(*keys).agg(F.sum("all").alias("all"), *[F.sum(count(i, j)).alias(f"v{i}_{j}") for i in range(2) for j in range(64)])
    bit = lambda i, j: F.shiftleft((2 * F.col(f"v{i}_{j}") > F.col("all")).cast("long"), j)
    whole = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [bit(i, j) for j in range(64)])
    return votes.select(*keys, whole(1).alias("hi"), whole(0).alias("lo"))


def distance(a: str, b: str) -> Column:
    """Hamming distance of the fingerprints with these prefixes of column names."""
    return sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in ("hi", "lo")), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """1 minus the share of bits that differ."""
    return 1 - distance(a, b) / float(BITS)


def block_keys(hi: Column, lo: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Keys of a fingerprint in the permuted tables, one for each choice of blocks - radius blocks.

    Two fingerprints within the radius differ in at most `radius` blocks, so they meet in some table.
    """
    width = BITS // blocks
    part = lambda k: F.shiftrightunsigned(hi if k * width >= 64 else lo, k * width % 64).bitwiseAND((1 << width) - 1)
    return F.array(*[F.xxhash64(F.lit(n), *[part(k) for k in chosen]) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q_hi, q_lo, hi, lo, n, distance: for each distinct fingerprint of queries, those of index within radius.

    Both need columns hi and lo; n is the number of rows of index with the fingerprint. Equal fingerprints
    meet once for all their rows. Few keys of the index are asked for, so most of the others go before keys are shuffled.
    """
    have = index.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    want = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct()
    tables = have.select("hi", "lo", "n", F.explode(block_keys(F.col("hi"), F.col("lo"), radius, blocks)).alias("key"))
    asked = want.select("q_hi", "q_lo", F.explode(block_keys(F.col("q_hi"), F.col("q_lo"), radius, blocks)).alias("q_key"))
    tables = likely(tables, asked.select(F.col("q_key").alias("key")), "key")
    met = tables.join(asked, F.col("key") == F.col("q_key")).withColumn("distance", distance("q_", ""))
    return met.where(F.col("distance") <= radius).select("q_hi", "q_lo", "hi", "lo", "n", "distance").distinct()


def _buckets(ids: DataFrame) -> Column:
    """A column that grows with (i, h), with about BUCKET_ROWS rows to a value, found from the ids (i) of all rows.

    Edges are quantiles of i. Between two of them rows are split evenly by i, so that the number of buckets
    grows with the table up to MOST_BUCKETS * MOST_PARTS; rows of an id that is several quantiles, by h.
    """
    count, least, most, points = ids.agg(F.count("*"), F.min("i"), F.max("i"), F.percentile_approx("i", [k / MOST_BUCKETS for k in range(1, MOST_BUCKETS)], 5 * MOST_BUCKETS)).first()
    if not count:
        return F.lit(0)
    n = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS))
    parts = max(1, min(MOST_PARTS, count // (BUCKET_ROWS * n)))
    chosen = [points[k * MOST_BUCKETS // n - 1] for k in range(1, n)]
    edges = sorted(set(chosen))
    repeats = Counter(chosen)
    same = [0, *(repeats[e] for e in edges)]  # quantiles that the lower edge is
    low, high = [least, *edges], [*edges, most + 1 if most < (1 << 63) - 1 else most]
    own = [c * parts if c > 1 else 0 for c in same]
    start = [0]
    for c in own:
        start.append(start[-1] + c + parts)
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[k : k + step] for k in range(0, len(edges), step)]
    array = lambda values: F.array(*[F.lit(x).cast("long") for x in values])
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("i")))
    k = F.lit(1)
    if groups:
        g = below(array([g[0] for g in groups]))
        k = F.when(g == 0, 1).otherwise((g - 1) * step + below(F.element_at(F.array(*map(array, groups)), F.greatest(g, F.lit(1)))) + 1)
    at = lambda values: F.element_at(array(values), k)
    share = (F.col("i").cast("double") - at(low)) / F.greatest(F.lit(1.0), at(high).cast("double") - at(low))
    inside = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts)))
    by_hash = F.floor((F.col("h").cast("double") / float(1 << 64) + 0.5) * at(own))
    return at(start) + F.when((at(own) > 0) & (F.col("i") == at(low)), F.least(at(own) - 1, by_hash)).otherwise(at(own) + inside)


def _with_next(docs: DataFrame) -> DataFrame:
    """b, doc_id, text, next (text of the next document, descending doc_id, the last one's is the first),
    extra (a copy of a bucket's first row at the end of the bucket before it), o (the order in b)."""
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("i", F.coalesce("doc_id", lowest)).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("b", _buckets(docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("i"))))
    firsts = rows.groupBy("b").agg(F.max(F.struct("i", "h")).alias("top"))  # one row of 24 bytes a bucket
    order = W.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("b").over(W.orderBy(F.col("b").desc())), F.last("b").over(order))
    copies = firsts.select(F.col("top.i").alias("t_i"), F.col("top.h").alias("t_h"), before.alias("t_b"))
    rows = rows.join(F.broadcast(copies), (F.col("i") == F.col("t_i")) & (F.col("h") == F.col("t_h")), "left")
    places = F.filter(F.array(F.struct(F.col("b").alias("at"), F.lit(False).alias("extra")), F.struct(F.col("t_b").alias("at"), F.lit(True).alias("extra"))), lambda p: p["at"].isNotNull())
    rows = rows.select("doc_id", "text", "i", "h", F.explode(places).alias("p")).select(F.col("p.at").alias("b"), "p.extra", "doc_id", "text", "i", "h")
    w = W.partitionBy("b").orderBy("extra", F.col("i").desc(), F.col("h").desc())
    return rows.withColumn("next", F.lead("text").over(w)).withColumn("o", F.row_number().over(w))


def edit_resistance(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    The edited text is the document's with its last third replaced by as much of the start of the next
    document's, descending doc_id. n_within: for documents whose doc_id is divisible by 100, how many rows
    have fingerprints within the radius, their own included; null for others. Null texts are empty, and
    fingerprints of empty texts are 0. Null doc_ids come last; rows with one doc_id go by a hash of their
    texts. Other columns are not read. All shuffles but that of whole texts by bucket are of narrow rows.
    """
    rows = _with_next(docs)
    n = F.char_length("text").cast("long")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", n)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("sha", F.sha2("edited", 256))
    keys = ["b", "o", "extra", "doc_id", "n_chars", "sha"]
    both = F.array(F.struct(F.lit(False).alias("e"), F.col("text").alias("x")), F.struct(F.lit(True).alias("e"), F.col("edited").alias("x")))
    kinds = rows.select(*keys, F.explode(both).alias("k")).select(*keys, "k.e", terms(F.col("k.x")).alias("term"))
    prints = fingerprints(kinds, [*keys, "e"], "term")
    pick = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    wide = prints.groupBy(*keys).agg(*[pick(c, e).alias(("e_" if e else "") + c) for c in ("hi", "lo") for e in (False, True)])
    w = W.partitionBy("b").orderBy("o")
    wide = wide.withColumns({"n_hi": F.lead("hi").over(w), "n_lo": F.lead("lo").over(w)}).where("not extra")
    wide = checkpointed(wide.select("doc_id", "n_chars", "sha", "hi", "lo", "e_hi", "e_lo", "n_hi", "n_lo"))
    query = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    asked = wide.where(query)
    near = within_radius(asked, wide, radius).groupBy("q_hi", "q_lo").agg(F.sum("n").alias("n_within"))
    found = asked.join(near, (F.col("hi") == F.col("q_hi")) & (F.col("lo") == F.col("q_lo")), "left").drop("q_hi", "q_lo")
    out = found.unionByName(wide.where(~query).withColumn("n_within", F.lit(None).cast("long")))
    text = lambda p: F.concat(*[F.lpad(F.lower(F.hex(f"{p}{x}")), 16, "0") for x in ("hi", "lo")])
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), text("").alias("fingerprint"), text("e_").alias("edited_fingerprint"),
        likeness("", "e_").alias("near_edited"), likeness("", "n_").alias("near_next"), "n_within",
    )
