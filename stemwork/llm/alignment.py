"""Alignment of the tokens of two tokenizers, and how often the corpus links each pair of ids.

A document's tokens of tokenizer A and those of tokenizer B are the nodes of a graph, whose edges are the
overlaps of their byte ranges. Union-find gives its connected components: those are the smallest groups
between bytes where tokens of both end. Every A token of a group is linked with every B token of it. A pair
of ids counts once for each document that links it, over all documents.

Documents are encoded once and written with their distinct pairs. Counts don't go back to documents pair by
pair: the documents of a task make a chunk (a new one after CHUNK links, so that a chunk's rows are bounded),
each chunk's distinct pairs get their counts in one join, and documents meet the counts of their chunk in a
sort by chunk, which is streamed. So what is shuffled for a frequent pair grows with chunks and not with
documents, and no task holds a whole pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import least_nodes as components, parts, written

#: Distinct links of documents after which a task begins a new chunk.
CHUNK = 8_000_000
#: Lists in which a chunk's counts travel.
SLICES = 64
#: The byte-level pattern of pre-tokens, fixed by the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COLUMNS = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def byte_level(path: str):
    """(encode, bytes of each id) of a byte-level BPE file: special tokens are plain text.

    The merges of such a file are in the order of its ids, so its vocabulary is read as ranks: the same ids as by
    its own library, several times faster.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = _byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in vocabulary.items()}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return (lambda texts: [encode(f" {t}", disallowed_special=()) for t in texts]), table


@functools.cache
def pieces(path: str):
    """(encode, bytes of each id) of a piece model, which puts a space before each text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return (lambda texts: model.encode(texts, num_threads=1)), table


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (A token, B token) whose byte ranges overlap; both tile the same bytes."""
    a_start = np.concatenate([[0], a_end[:-1]])
    first = np.searchsorted(b_end, a_start, "right")
    each = np.searchsorted(b_end, a_end, "left") - first + 1
    u = np.repeat(np.arange(len(a_end)), each)
    return u, np.arange(len(u)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)


def _counted(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in the order of groups, and how often each occurs."""
    keys, times = np.unique(group * size + ids, return_counts=True)
    return keys // size, keys % size, times


class _Strings:
    """Byte strings by number, to be joined in any order."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(t) for t in strings])
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        return self.flat[np.repeat(self.start[ids] - end + length, length) + np.arange(int(end[-1]))].tobytes()


class Aligner:
    """Groups and links of texts under two tokenizers, each (encode, bytes of each id)."""

    def __init__(self, a, b):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = a, b
        self.table_b = _Strings(self.bytes_b)
        self.len_a, self.len_b = np.array([len(t) for t in self.bytes_a]), self.table_b.length
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.step = max(self.size_a, self.size_b)
        self.marked = _Strings([f"{mark}{i}".encode() for mark in ",|;" for i in range(self.step)])

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """For each text n_a, n_b, n_groups, n_links, groups as text, its distinct pairs a * size_b + b and how often each is linked."""
        none = np.zeros(0, np.int64)
        out: list[tuple] = [(0, 0, 0, 0, "", none, none)] * len(texts)
        there = [k for k, t in enumerate(texts) if t]
        a, b = self.encode_a([texts[k] for k in there]), self.encode_b([texts[k] for k in there])
        for k, x, y in zip(there, a, b):
            whole, x, y = f" {texts[k]}".encode(), np.asarray(x).astype(np.int64), np.array(y, np.int64)
            # a byte-level vocabulary has all bytes and keeps them all, so a length will do for A
            if len(y) and int(self.len_a[x].sum()) == len(whole) and self.table_b.joined(y) == whole:
                out[k] = self.aligned(x, y)
        yield from out

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple:
        a_end, b_end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        u, v = overlaps(a_end, b_end)
        root = components(len(a) + len(b), u, v + len(a))
        opens = root[: len(a)] == np.arange(len(a))  # a group's smallest node is its first A token
        number = np.cumsum(opens) - 1
        in_a, in_b = number[root[: len(a)]], number[root[len(a) :]]
        n = int(number[-1]) + 1
        n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)

        # one A or one B token: a link for each of the others; else distinct ids of either side, times their counts
        many = (n_a > 1) & (n_b > 1)
        few_a = ~many[in_a]
        each = np.where(few_a, n_b[in_a], 0)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        keys, times = np.repeat(a, each) * self.size_b + b[np.repeat((np.cumsum(n_b) - n_b)[in_a], each) + at], None
        if many.any():
            g, x, s = _counted(in_a[~few_a], a[~few_a], self.size_a)
            h, y, t = _counted(in_b[many[in_b]], b[many[in_b]], self.size_b)
            first, last = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            width = last - first
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
            times = np.concatenate([np.ones(len(keys), np.int64), np.repeat(s, width) * t[at]])
            keys = np.concatenate([keys, np.repeat(x, width) * self.size_b + y[at]])
        if times is None:
            pairs, times = np.unique(keys, return_counts=True)
        else:
            pairs, where = np.unique(keys, return_inverse=True)
            times = np.bincount(where, weights=times).astype(np.int64)
        return len(a), len(b), n, int(n_a @ n_b), self._text(a, b, opens, in_a, in_b, n_a, n_b), pairs, times

    def _text(self, a: np.ndarray, b: np.ndarray, opens: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: ids by group."""
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[in_a]] = a + 2 * self.step * opens
        out[np.arange(len(b)) + np.cumsum(n_a)[in_b]] = b + self.step * np.concatenate([[True], in_b[1:] != in_b[:-1]])
        return self.marked.joined(out)[1:].decode()


@functools.cache
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(byte_level(a), pieces(b))


def encoded(docs: DataFrame, a: str, b: str, digest: bool = True) -> DataFrame:
    """A row for each document with its chunk, counts, groups (their SHA-256 if digest) and distinct pairs of ids with the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, chunk, links = _aligner(a, b), TaskContext.get(), 0, 0
        for batch in parts(batches, 256):
            rows = list(aligner.rows(batch.column("text").to_pylist()))
            offsets = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate([r[k] for r in rows]).astype(kind)) for k, kind in ((5, np.int64), (6, np.int32))]
            groups = [hashlib.sha256(r[4].encode()).hexdigest() if digest and r[0] else r[4] for r in rows]
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            names = pa.array([f"{task.partitionId()}-{chunk}"] * len(rows))
            yield pa.RecordBatch.from_arrays([names, batch.column("doc_id"), *numbers, pa.array(groups, pa.string()), *lists], names=[c.split()[0] for c in COLUMNS.split(", ")])
            links += int(offsets[-1])
            if links > CHUNK:
                chunk, links = chunk + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def _chunk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, pair, n: the documents of each chunk that link a pair; a chunk may give a pair more than once."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for chunk, found in held.items():
            pairs, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(pairs)), pa.array(pairs), pa.array(n)], names=["chunk", "pair", "n"])
        held.clear()

    for batch in batches:
        column, lists = batch.column("chunk").to_pylist(), batch.column("pairs")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        for k, chunk in enumerate(column):
            held.setdefault(chunk, []).append(values[ends[k] : ends[k + 1]])
        size += int(ends[-1] - ends[0])
        if size > CHUNK:
            yield from out()
            size = 0
    yield from out()


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, pair) of `encoded` rows, and pair, count: in how many documents each pair is linked."""
    by_chunk = written(rows.select("chunk", "pairs").mapInArrow(_chunk_pairs, "chunk string, pair long, n long").groupBy("chunk", "pair").agg(F.sum("n").alias("n")), "chunk-pairs")
    return by_chunk, by_chunk.groupBy("pair").agg(F.sum("n").alias("count"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, the lists of its counts first: adds n_best and count_sum to the documents."""
    here, lists, known = None, [], None
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for batch in parts(batches, 1024):
        chunks, is_doc = batch.column("chunk").to_pylist(), batch.column("is_doc").to_pylist()
        found = []
        for k, chunk in enumerate(chunks):
            if chunk != here:
                here, lists, known = chunk, [], None
            pairs, times = (batch.column(c)[k].values.to_numpy() for c in ("pairs", "times"))
            if not is_doc[k]:
                lists.append((pairs, times, batch.column("counts")[k].values.to_numpy()))
                continue
            if known is None:
                whole = [np.concatenate(x) for x in zip(*lists)] or [np.zeros(0, np.int64)] * 3
                order = np.argsort(whole[0])
                known, lists = [x[order] for x in whole], []
            at = np.searchsorted(known[0], pairs)
            found.append((k, int(times @ known[1][at]), int(times @ known[2][at])))
        if found:
            docs = batch.take(pa.array([f[0] for f in found]))
            more = {"n_best": pa.array([f[1] for f in found], pa.int64()), "count_sum": pa.array([f[2] for f in found], pa.int64())}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else docs.column(c) for c in names], names=names)


def align(docs: DataFrame, a: str, b: str, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row of docs, extra columns left out.

    a is the path of a byte-level BPE file, which gets a space before each text, b that of a piece model, which puts
    one there itself. groups is `a1,a2|b1;a3|b2,b3`, or its SHA-256 if digest. count_sum is the sum of
    links' counts, n_best the number of links whose count is the highest that their A id has with any B id, ties
    included. Null and empty texts, and those whose tokens don't join to the text's bytes (the piece model
    normalizes some), have zeros and no groups. Repeated rows are documents of their own and null doc_ids stay.
    """
    rows = written(encoded(docs, a, b, digest), "encoded")
    by_chunk, counts = pair_counts(rows)
    size_b = len(pieces(b)[1])
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / size_b)), "pair-counts")
    highest = counts.groupBy(F.col("a").alias("a_of")).agg(F.max("count").alias("most"))
    counts = counts.join(highest, F.col("a") == F.col("a_of")).select(F.col("pair").alias("pair_of"), "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    lists = by_chunk.join(counts, F.col("pair") == F.col("pair_of")).groupBy("chunk", F.pmod(F.xxhash64("pair"), F.lit(SLICES)).alias("slice"))
    lists = lists.agg(F.collect_list(F.struct("pair", "best", "count")).alias("all"))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    lists = lists.select("chunk", F.lit(False).alias("is_doc"), *nothing, F.lit(None).cast("string").alias("groups"), F.col("all.pair").alias("pairs"), F.col("all.best").alias("times"), F.col("all.count").alias("counts"))
    both = lists.unionByName(rows.withColumns({"is_doc": F.lit(True), "counts": F.array().cast("array<long>")}))
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return both.repartition("chunk").sortWithinPartitions("chunk", "is_doc").mapInArrow(_scored, kinds)
