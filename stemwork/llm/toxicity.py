"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Fitting counts, over all labelled documents of the learning folds, in how many toxic and other documents
each token occurs. Tokens are words in lower case without marks around them, and the first 6, 5 and 4
letters of longer words, counted by 64-bit hashes. A token's log-odds are those of Monroe, Colaresi
and Quinn: an informative Dirichlet prior in proportion to all counts, and a z-score. A word stands for
its longest token that SEEN documents have; it has that token's log-odds if its z-score is beyond Z, and
DRIFT otherwise, so scores sum to less than 0 over harmless text. A text is scanned once by the algorithm of Ruzzo and Tompa, which finds all maximal
scoring segments. By Karlin and Altschul the best score of n harmless words exceeds s with a probability of
1 - exp(-K n exp(-L s)); L follows from the scores of harmless documents and K is fitted to their best
segments. The logarithms of these chances, of the best segment and summed over further significant ones, are
what a logistic curve, fitted on a fold that the log-odds have not seen, turns into the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, likely, parts

#: Low bits of a key, which are the token's own; those above are of the first 4 letters, which a word shares
#: with all its prefixes. So the tokens that can hide a significant prefix are found by their keys alone.
OWN_BITS = 44
#: Tokens that a task gathers before it adds up equal ones, and sums that it holds before it passes them on.
GATHER = 1 << 21
#: PRIOR: the prior's weight as a share of all counts.
PRIOR, Z, SEEN, DRIFT, FOLDS, SIGNIFICANT = 0.2, 3.0, 4, -0.1, 5, 0.05
#: Documents of the calibration fold that the logistic curve is fitted on, at most (by a hash of doc_id). L and K
#: are of all its harmless documents.
CURVE_ROWS = 20_000
#: Most that a text scores where labels of both kinds are there but can't be told apart.
MOST_BASE = 0.49
_MARKS = re.compile(r"^\W+|\W+$")
CACHE_WORDS = 300_000


def fold(doc_id: Column) -> Column:
    """CRC-32 of doc_id as text, modulo FOLDS; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS, F.lit(0))


def keys_of(word: str) -> tuple[int, ...]:
    """Keys of a word's tokens, the whole word first; none for a word of marks."""
    w = _MARKS.sub("", word.lower())
    if not w:
        return ()
    tokens = [w] + [w[:k] + "*" for k in (6, 5, 4) if len(w) > k]
    group = xxhash.xxh64_intdigest(w[:4]) >> OWN_BITS
    group = (group - (group >> (63 - OWN_BITS) << (64 - OWN_BITS))) << OWN_BITS
    return tuple(group | xxhash.xxh64_intdigest(t) & ((1 << OWN_BITS) - 1) for t in tokens)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (key, toxic and other documents), summed over what a task reads or as much as it holds."""
    known: dict[str, tuple[int, ...]] = {}
    keys, counts = np.empty(0, np.int64), np.empty((0, 2), np.int64)
    waiting: list[tuple[np.ndarray, bool]] = []
    size = 0

    def gather() -> None:
        """Keys that wait join the counts."""
        nonlocal keys, counts, size
        toxic = np.repeat(np.array([t for _, t in waiting], bool), [len(k) for k, _ in waiting])
        held = len(keys)
        keys, at = np.unique(np.concatenate([keys, *(k for k, _ in waiting)]), return_inverse=True)
        both = np.stack([np.bincount(at[held:][of], minlength=len(keys)) for of in (toxic, ~toxic)], axis=1).astype(np.int64)
        both[at[:held]] += counts
        counts, size = both, 0
        waiting.clear()

    def sums() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            some = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some, 0]), pa.array(counts[some, 1])], names=["key", "toxic", "other"])

    for batch in parts(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(known) > CACHE_WORDS:
                known.clear()
            found: set[int] = set()
            for w in set((text or "").split()):
                s = known.get(w)
                if s is None:
                    s = known[w] = keys_of(w)
                found.update(s)
            waiting.append((np.fromiter(found, np.int64, len(found)), toxic))
            size += len(found)
            if size > GATHER:
                gather()
                if len(keys) > GATHER:
                    yield from sums()
                    keys, counts = np.empty(0, np.int64), np.empty((0, 2), np.int64)
    gather()
    yield from sums()


@dataclass
class Model:
    """weights: score of each significant token; hiding: other tokens that SEEN documents have, where a token
    with the same first letters is significant; rate, scale: L, K; curve: None where the labels don't have both
    kinds, so that every text scores `base`."""

    weights: dict[int, float]
    hiding: frozenset[int] = frozenset()
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, ...] | None = None
    base: float = 0.0

    def word(self, word: str) -> float:
        for k in keys_of(word):
            if k in self.weights:
                return self.weights[k]
            if k in self.hiding:
                return DRIFT
        return DRIFT

    def chance(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Calibrated chance of label 1 of a text of n words with these segments."""
        if self.curve is None:
            return self.base
        v = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], features(n, found, self.rate, self.scale), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of n words, in their order.

    scores: (place, score) of the words that don't score `drift`, by place. Linear in their number: each
    candidate is pushed once and merged away at most once.
    """
    found: list[list[float]] = []  # first, last, sum before it, sum with it
    total, at = 0.0, 0
    for place, score in scores:
        total += drift * (place - at)
        at = place + 1
        before = total
        total += score
        if score <= 0:
            continue
        new = [place, place, before, total]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = int(found[k][4])
            if k < 0 or found[k][3] >= new[3]:
                found.append([*new, k])
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            del found[k:]
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def marked(text: str | None, model: Model, known: dict[str, float]) -> tuple[int, list[tuple[int, float]]]:
    """Number of words of a text, and (place, score) of those that don't score DRIFT; known: scores of words so far."""
    words = (text or "").split()
    if len(known) > CACHE_WORDS:
        known.clear()
    found = []
    for k, w in enumerate(words):
        s = known.get(w)
        if s is None:
            s = known[w] = model.word(w)
        if s != DRIFT:
            found.append((k, s))
    return len(words), found


def features(n: int, found: list[tuple[int, int, float]], rate: float, scale: float) -> tuple[float, float]:
    """Nats by which the best segment is rarer than chance, and by which further significant ones are, damped."""
    rare = sorted((rate * s - math.log(max(scale * max(n, 1), 1e-300)) for _, _, s in found), reverse=True)
    more = sum(x for x in rare[1:] if x > -math.log(SIGNIFICANT))
    return max(0.0, min(40.0, rare[0] if rare else 0.0)), math.log1p(more)


def _rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive L with sum(p * exp(L * s)) = 1, by bisection; 1 where scores can't reach above 0."""
    p = counts / counts.sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights (constant first) of a logistic curve by Newton's method with a slight ridge."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled rows whose fold isn't 0: fold 4 calibrates, 1 to 3 give the log-odds.

    Rows of labels with a null doc_id or label are left out; a document with several labels counts with
    each. All other rows count, in one pass and one sum by token. Significant tokens go to the driver, and of
    the others that are seen those which can hide one: the rest score DRIFT whether they are known or not.
    Texts meet their labels in a merge join at every size, and of the folds that are learned from only texts
    that a filter of labelled doc_ids lets through are shuffled. Where folds 1 to 3 lack labelled rows of either kind, every text scores the share of label 1
    in folds 1 to 4: 0 without labels, 1 if all are toxic, else less than 0.5. Where only fold 4 lacks a kind,
    the log-odds of label 1 are those of that share and the nats of the segments, each at its full weight; if
    it lacks harmless documents, L and K are of those of folds 1 to 3.
    """
    marks = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("l_id"), (F.col("toxic") == 1).alias("toxic")).where(fold(F.col("l_id")) != 0)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    rows = likely(named, marks.select(F.col("l_id").alias("doc_id")), "doc_id").join(marks.hint("merge"), F.col("doc_id") == F.col("l_id"))
    toxic, every = named.select("doc_id").join(marks.hint("merge"), F.col("doc_id") == F.col("l_id")).agg(F.count_if("toxic"), F.count("*")).first()
    base = 1.0 if every and toxic == every else min(MOST_BASE, toxic / max(every, 1))
    counted = rows.where(f"fold < {FOLDS - 1}").select("text", "toxic").mapInArrow(_counted, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counted = checkpointed(counted)
    model = Model({}, base=base)
    nt, no = counted.agg(F.sum("toxic"), F.sum("other")).first()
    if not nt or not no:
        return model
    prior, mass = PRIOR * (F.col("toxic") + F.col("other")), PRIOR * (nt + no)
    odds = lambda y, n: F.ln((F.col(y) + prior) / (n + mass - F.col(y) - prior))
    judged = counted.where(F.col("toxic") + F.col("other") >= SEEN).withColumn("delta", odds("toxic", nt) - odds("other", no))
    z = F.col("delta") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    group = F.shiftright("key", OWN_BITS)
    judged = judged.select("key", "delta", (F.abs(z) >= Z).alias("significant"))
    model.weights = {r["key"]: r["delta"] for r in judged.where("significant").select("key", "delta").toLocalIterator()}
    groups = judged.where("significant").select(group.alias("group")).distinct()
    model.hiding = frozenset(r["key"] for r in judged.where("not significant").join(groups, group == F.col("group"), "left_semi").select("key").toLocalIterator())

    def scanned(some: DataFrame) -> DataFrame:
        found = scan_all(some, model, ["doc_id", "toxic"])
        return checkpointed(found.select("doc_id", "toxic", "n_words", F.transform("spans", lambda x: x["score"]).alias("scores"), "marks"))

    scored = scanned(rows.where(f"fold = {FOLDS - 1}"))
    calm = scored.where("not toxic")
    if calm.isEmpty():
        calm = scanned(rows.where(f"fold < {FOLDS - 1} and not toxic"))
    harmless = calm.select(F.greatest("n_words", F.lit(1)).alias("words"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best"))
    words, hits, least = harmless.agg(F.sum("words"), F.count_if(F.col("best") > 0), F.min(F.when(F.col("best") > 0, F.col("best")))).first()
    words = max(words or 0, 1)
    counted = calm.select(F.explode("marks").alias("m")).groupBy(F.round("m", 3).alias("m")).count().collect()
    values, counts = np.array([r["m"] for r in counted] + [DRIFT]), np.array([r["count"] for r in counted], float)
    counts = np.append(counts, max(1.0, words - counts.sum()))
    model.rate = _rate(values, counts)
    # from P(best > s) = 1 - exp(-K n exp(-L s)): the expected number of segments above the least best score
    model.scale = max(1e-12, (hits or 1) / words * math.exp(model.rate * (least if hits else 1.0)))

    share = min(1.0, CURVE_ROWS / max(scored.count(), 1))
    rows = scored.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("toxic", "n_words", "scores").collect()
    x = np.array([features(max(r["n_words"], 1), [(0, 0, c) for c in r["scores"]], model.rate, model.scale) for r in rows], float).reshape(-1, 2)
    y = np.array([r["toxic"] for r in rows], float)
    share = max(base, 0.5 / every)
    model.curve = _logistic(x, y) if len(y) and 0 < y.sum() < len(y) else (math.log(share / (1 - share)), 1.0, 1.0)
    return model


def scan_all(docs: DataFrame, model: Model, keep: list[str], details: bool = True) -> DataFrame:
    """The columns `keep` with n_words, n_segments, score and, if wanted, spans (from, to, score) and marks (scores other than DRIFT).

    Texts are scanned whole; null is empty. score is the calibrated chance of label 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema
    more = ["spans array<struct<`from`:long,`to`:long,score:double>>", "marks array<double>"] if details else []
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long, n_segments int, score double", *more])
    names = [*keep, "n_words", "n_segments", "score", *(x.split(" ")[0] for x in more)]
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value, {}
        for batch in parts(batches):
            sizes, counts, scores, spans, marks = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                n, scored = marked(text, m, known)
                found = segments(scored, n)
                sizes.append(n)
                counts.append(len(found))
                scores.append(m.chance(n, found))
                if details:
                    spans.append([{"from": a, "to": b, "score": c} for a, b, c in found])
                    marks.append([s for _, s in scored])
            own = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int32()), pa.array(scores, pa.float64())]
            own += [pa.array(spans, span), pa.array(marks, pa.list_(pa.float64()))] if details else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(keep))), *own], names=names)

    return docs.select(F.col("text").cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, segments: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments and, if wanted, segments of every document, labelled or not.

    A score depends on the text alone. Null and empty texts have the score of a text without segments.
    segments: (from, to, score) in words of the maximal scoring passages. See fit() for labels of one kind.
    """
    model = fit(docs, labels)
    rows = scan_all(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"], segments)
    found = [F.col("spans").alias("segments")] if segments else []
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", *found)
