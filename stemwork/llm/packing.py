"""Mixture-controlled packing of documents into fixed windows of tokens by deficit round-robin.

Each source is a queue of documents. In every round a source's deficit counter gains its quantum, its
share of one window, and the source sends documents while the counter covers them whole; what is left
of the counter is carried to the next round. While a queue has documents, the credit after r rounds is
r quanta, so the document whose tokens end at E in its queue is sent in round ceil(E / quantum): the
carried deficits are running sums, and windows on different partitions are filled at once. Documents,
in the order (round, source, place in the queue), are laid end to end and cut where a window is full.
The last window, if not full, is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import checkpointed, parts, running_total, written

WINDOW, END_ID, BUCKETS, KNOTS = 4096, 2, 8192, 32
#: Characters and words whose ids the fast encoder gives; others go to the tokenizer itself, word by word.
#: Latin text of composed characters is its own NFC, and its lower case doesn't depend on what is around it.
PLAIN = re.compile("[\n\x20-\x7e\u00a1-\u024f]*")
#: Other words whose ids a Python worker remembers; it forgets all of them when there are more.
CACHE_WORDS = 100_000


def _fast(model: dict, pattern: str):
    """tiktoken's encoder of a word BPE vocabulary, or None if its merges aren't ranked by id.

    The mark of a word's end becomes a blank, which no other token of such a vocabulary holds. Each word
    must then be followed by one blank, and merging by rank gives the ids that merging by list gives.
    """
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    vocab, end = model["vocab"], model.get("end_of_word_suffix")
    letters = sorted(ByteLevel.alphabet())
    if end != "</w>" or any(vocab.get(a + b) != 2 * len(letters) + k for k, (a, b) in enumerate(model["merges"])):
        return None
    # byte-level alphabets map printable bytes to themselves and the others, in order, to what follows 255
    shown = {ord(c) for c in letters if ord(c) < 256}
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for token, k in vocab.items():
        body = token.removesuffix(end)
        if all(c in byte for c in body) and not (token.startswith("<|") and token.endswith("|>")):
            ranks[bytes(byte[c] for c in body) + b" " * (body != token)] = k
    return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


def _encoder(path: str, end_id: int):
    """texts -> their ids, little-endian uint16 or uint32, each with end_id, and the width of an id.

    Neither the normalizer nor the pre-tokenizer of a word tokenizer looks across a blank or a line feed,
    so a text's ids are those of its words. Plain words, in a document of them all at once, go to an
    encoder of the same vocabulary that is several times as fast; the others to the tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4"
    settings = json.loads(Path(path).read_text())
    split = [p["pattern"]["Regex"] for p in (settings.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
    fast = _fast(settings["model"], split[0]) if len(split) == 1 else None
    seen: dict[str, list[int]] = {}

    def plain(text: str) -> list[int]:
        found = fast[1].findall(text.lower())
        return fast[0].encode_ordinary(" ".join(found) + " ") if found else []

    def encode(text: str | None) -> bytes:
        text = text or ""
        if fast and PLAIN.fullmatch(text) and "<|" not in text:
            ids = plain(text)
        else:
            ids = []
            for easy, words in groupby(text.replace("\n", " ").split(" "), lambda w: bool(fast and PLAIN.fullmatch(w) and "<|" not in w)):
                if easy:
                    ids += plain(" ".join(words))
                    continue
                for w in words:
                    if w not in seen:
                        if len(seen) >= CACHE_WORDS:
                            seen.clear()
                        seen[w] = tokenizer.encode(w, add_special_tokens=False).ids
                    ids += seen[w]
        return np.array([*ids, end_id], kind).tobytes()

    return encode, np.dtype(kind).itemsize


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """rid, doc_id, source, n (tokens with the end id), ids (binary, 2 or 4 bytes each), width; written to the shared folder.

    A null text is an empty one, so every row has at least its end id. rid tells repeated rows apart.
    """
    schema = "rid long, doc_id long, source string, n long, ids binary, width int"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = _encoder(tokenizer_path, end_id)
        for part in parts(batches, 256):
            ids = [encode(x) for x in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())], names=names
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, schema), "tokens")


def tail_cuts(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences after the last full window: powers of two, longest first."""
    at, cuts = total // window * window, []
    for bit in reversed(range(window.bit_length())):
        if (total - at) >> bit:
            cuts.append((at, 1 << bit))
            at += 1 << bit
    return cuts


def _quanta(tokens: DataFrame, weights: dict[str | None, float] | tuple[float, ...] | None, window: int) -> DataFrame:
    """q_source, queue (its tokens), quantum (its credit a round), before (rounds before its first), drained (its last round)."""
    sums = tokens.groupBy("source").agg(F.sum("n").alias("queue"))
    mass = F.col("queue").cast("double")
    if isinstance(weights, dict):
        mass = F.lit(0.0)
        for name, weight in weights.items():
            mass = F.when(F.col("source").eqNullSafe(F.lit(name)), float(weight)).otherwise(mass)
    elif weights is not None:
        place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
        mass = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int"))
    rows = sums.withColumn("mass", mass).withColumn("late", F.col("mass") <= 0)
    rows = rows.withColumn("mass", F.when(F.col("late"), F.col("queue").cast("double")).otherwise(F.col("mass")))
    rows = rows.withColumn("quantum", F.col("mass") * window / F.sum("mass").over(W.partitionBy("late")))
    turns = F.ceil(F.col("queue") / F.col("quantum"))
    before = F.when(F.col("late"), F.coalesce(F.max(F.when(~F.col("late"), turns)).over(W.partitionBy()), F.lit(0))).otherwise(F.lit(0))
    return checkpointed(rows.withColumn("before", before).select(F.col("source").alias("q_source"), "queue", "quantum", "before", (before + turns).alias("drained")))


def _slots(quanta: DataFrame, total: int) -> Column:
    """A column of about BUCKETS values that grows with the column `round`, each for about as many tokens.

    The tokens sent by a round are linear in it between the rounds in which sources are drained; KNOTS of
    these rounds, by the sources' tokens, are where the density of slots changes.
    """
    shares = [k / KNOTS for k in range(1, KNOTS + 1)]
    found = quanta.agg(F.percentile(F.col("drained").cast("double"), F.array(*map(F.lit, shares)), F.col("queue")).alias("k"), F.max("drained").alias("m")).first()
    knots = sorted({0.0, *(float(int(x)) for x in found["k"] or []), float(found["m"] or 1)})
    sent = quanta.agg(*[F.sum(F.least(F.greatest(F.lit(r) - F.col("before"), F.lit(0.0)) * F.col("quantum"), F.col("queue").cast("double"))).alias(f"t{k}") for k, r in enumerate(knots)]).first()
    slot, base = F.lit(0), 0
    for k in range(1, len(knots)):
        n = max(1, round(BUCKETS * ((sent[k] or 0.0) - (sent[k - 1] or 0.0)) / max(total, 1)))
        inside = F.least(F.lit(n - 1), F.floor((F.col("round") - knots[k - 1]) * (n / (knots[k] - knots[k - 1]))))
        slot = F.when(F.col("round") >= knots[k - 1], base + inside).otherwise(slot)
        base += n
    return slot.cast("long")


def plan(tokens: DataFrame, weights: dict[str | None, float] | tuple[float, ...] | None, window: int) -> tuple[DataFrame, int]:
    """(rid, round, start of the document in the laid-out stream), and the number of tokens in all.

    weights: target share of each source in a window, by source or, as a tuple, for the sources in code point
    order (null last), repeating. A source without one, and every source if None, aims at its own share of
    all tokens, which drains all queues together. Sources of weight 0 follow last, by their own shares.
    """
    rows = tokens.select("rid", "doc_id", "source", "n", F.xxhash64("doc_id").alias("h")).withColumn("b", F.shiftrightunsigned("h", 51))
    quanta = _quanta(tokens, weights, window)
    total = quanta.agg(F.sum("queue")).first()[0] or 0
    queued = running_total(rows, ["source"], "b", [F.col("h"), F.col("doc_id"), F.col("rid")], "n", "e")
    sent = queued.join(quanta.drop("queue", "drained"), F.col("source").eqNullSafe(F.col("q_source"))).withColumn("round", F.col("before") + F.ceil(F.col("e") / F.col("quantum")))
    spread = sent.withColumn("slot", _slots(quanta, total))
    laid = running_total(spread, [], "slot", [F.col("round"), F.col("source"), F.col("e"), F.col("rid")], "n", "end")
    return laid.select(F.col("rid").alias("p_rid"), "round", (F.col("end") - F.col("n")).alias("at")), int(total)


def pack(docs: DataFrame, tokenizer_path: str, weights: dict[str | None, float] | tuple[float, ...] | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents with their places in sequences of at most `window` tokens.

    Columns: doc_id, source, round, start (ids of the document before the piece), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Each id lies in one piece; offsets in a
    sequence have no gaps. Null texts pack as their end id alone; null sources are one queue; repeated rows
    are packed as often as they come; an empty table gives no piece; other columns are not read.
    """
    tokens = tokenized(docs, tokenizer_path, end_id)
    places, total = plan(tokens, weights, window)
    full, cuts = total // window * window, tail_cuts(total, window)
    edges = np.array([c[0] for c in cuts] + [total], np.int64)
    schema = "doc_id long, source string, round long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            out: list[tuple] = []
            for doc_id, source, turn, n, width, at, ids in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                whole = np.frombuffer(ids, f"<u{width}").astype("<u4")
                first, end = at, at + n
                while at < end:
                    if at < full:
                        seq, base, stop = at // window, at // window * window, min(end, at // window * window + window)
                    else:
                        k = int(np.searchsorted(edges, at, "right")) - 1
                        seq, base, stop = full // window + k, int(edges[k]), min(end, int(edges[k + 1]))
                    out.append((doc_id, source, turn, at - first, stop - at, whole[at - first : stop - first].tobytes(), n, seq, at - base))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)] if out else [pa.array([], t) for t in TYPES], names=names)

    joined = tokens.join(places, F.col("rid") == F.col("p_rid"))
    return joined.select("doc_id", "source", "round", "n", "width", "at", "ids").mapInArrow(run, schema)


TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def with_crc(pieces: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, the unsigned CRC-32 of their bytes."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
