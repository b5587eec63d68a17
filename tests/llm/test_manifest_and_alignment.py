"""The Merkle manifest and the alignment of tokenizers, held against plain versions of their contracts."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stemwork.llm import alignment, merkle, queries

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and the proof of each leaf as a list of the others of its runs with its own place."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for p, a in zip(paths, at):
            p.append((runs[a // 8][: a % 8], runs[a // 8][a % 8 + 1 :]))
        at, level = [a // 8 for a in at], [h(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made, out = [], []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append(tree([leaf(r) for r in groups[g]]))
    root, above = tree([m[0] for m in made]) if made else (None, [])
    for g, (subroot, paths), up in zip(names, made, above):
        for r, p in zip(groups[g], paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4]
            x = leaf((*r[:4], text))
            for left, right in p + up:
                x = h(*left, x, *right)
            proof = h(*(y for left, right in p + up for y in left + right))
            out.append((r[0], leaf(r), subroot, root, proof, x, x == root))
    return out


def some_rows(n, seed=3):
    r = random.Random(seed)
    langs = [None, "", "-", "=", "de", "en", "en", "en", "en", "fr", "zü", "￿", "😀"]
    rows = [(k, r.choice(["a", None, "söurce"]), r.choice(langs), r.choice([None, 5, 12345]), r.choice(["Ab C", "abc", None, "", "ÄÖ Zz"])) for k in range(n)]
    return rows + [(None, None, "en", None, None), (None, None, "en", None, "X"), (7, "a", "de", 1, "Y"), (7, "a", "de", 1, "Y"), (7, "a", "de", 1, "Z")]


@pytest.mark.parametrize("n", [0, 1, 9, 64, 700])
def test_manifest_equals_plain_trees(spark, n):
    rows = some_rows(n) if n > 1 else [(k, "a", "en", 1, "T") for k in range(n)]
    docs = spark.createDataFrame(rows, KIND).repartition(3).withColumns({"g": F.lit(1), "leaf": F.lit("x"), "pid": F.lit(9)})
    got = merkle.manifest(docs, merkle.tampered()).verified().collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_manifest(rows), key=str)


def test_manifest_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(some_rows(500), KIND)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    roots = set()
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            made = merkle.manifest(docs.repartition(4))
            roots.add(made.root)
            assert made.verified().where("not verified").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(roots) == 1


def test_paths_lead_to_the_root_and_equal_rows_are_split(spark):
    rows = [(1, "a", "en", 1, "same")] * 300 + [(k, "a", None, 1, "t") for k in range(3)]
    made = merkle.manifest(spark.createDataFrame(rows, KIND))
    got = made.proofs().collect()
    assert len(got) == len(rows) and all(merkle.folded(r.leaf, [tuple(x) for x in r.path]) == made.root == r.root for r in got)
    assert not any(merkle.folded(h("other"), [tuple(x) for x in r.path]) == made.root for r in got)


def test_levels_and_paths_of_a_stretch():
    leaves = [h(str(k)) for k in range(75)]
    for first, n in ((0, 75), (3, 70), (8, 64), (9, 3), (64, 11), (74, 1)):
        levels = merkle.local_levels(first, leaves[first : first + n], 75, 8)
        for at, nodes, lo, hi in levels:
            assert len(nodes) >= hi >= lo >= 0 and (hi == lo or (at + lo) % 8 == 0)
        whole = merkle.local_levels(0, leaves, 75, 8)
        for (at, nodes, _, _), (_, all_nodes, _, _) in zip(levels, whole):
            assert nodes == all_nodes[at : at + len(nodes)]


A, B = (public_tokenizers.path(x) for x in queries.ALIGNED)


def token_bytes():
    table = {}
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(spare)] = b
            spare += 1
    return table


def plain_alignment(texts):
    tokenizer, model, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), token_bytes()
    tokenizer.encode_special_tokens = True
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a = [(i, bytes(alphabet[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(f" {t}", add_special_tokens=False).ids]
        b = []
        for i in model.encode(t):
            p = model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()))
        whole = f" {t}".encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, tokens, ends in ((0, a, ends_a), (1, b, ends_b)):
            for (i, _), k in zip(tokens, np.searchsorted(cuts, ends)):
                groups[k][side].append(i)
        docs.append(groups)
    count = collections.Counter(p for d in docs if d for p in {(x, y) for g, k in d for x in g for y in k})
    most = collections.defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = []
    for d in docs:
        links = [(x, y) for g, k in d or [] for x in g for y in k]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, k))}" for g, k in d or [])
        out.append((sum(len(g) for g, _ in d or []), sum(len(k) for _, k in d or []), len(d or []), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), h(text) if d else ""))
    return out


TEXTS = ["Hello world", "Hello  world \n\n x", "", None, "naïve café 😀😀 中文字符", "▁ not a space", "<|endoftext|> <s> </s> <0x41>", " " * 300, "a" * 500, "tab\tand\r\nnul\x00", "Hello world", "ﬁ ligature ½", "แปลภาษาไทยเป็นอังกฤษ" * 20, " 　", "é", "no-break… “quotes”—dash"]


def test_alignment_equals_plain_version(spark):
    r = random.Random(5)
    letters = "ab cé中😀 \n.,'sthe"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumns({"chunk": F.lit(1), "pairs": F.lit(2), "count": F.lit(3)})
    got = {x.doc_id: tuple(x)[1:] for x in alignment.align(rows, A, B).collect()}
    want = plain_alignment(texts)
    assert {k: got[k] for k in range(len(texts))} == dict(enumerate(want)) and len(got) == len(texts)
    assert sum(w[0] == 0 for w in want) < 10


def test_alignment_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 20)
    texts = ["the cat sat on the mat"] * 5 + ["the dog", "a cat", None] * 4
    rows = spark.createDataFrame([(k // 2 if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = sorted(map(str, (tuple(x) for x in alignment.align(rows, A, B).collect())))
    assert got == sorted(str((k // 2 if k else None, *w)) for k, w in enumerate(plain_alignment(texts)))
    assert alignment.align(rows.where("false"), A, B).count() == 0


def test_components_are_those_of_a_plain_search():
    r = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (400, 390), (1000, 5000)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        near = collections.defaultdict(set)
        for x, y in zip(u.tolist(), v.tolist()):
            near[x].add(y)
            near[y].add(x)
        want = [-1] * n
        for k in range(n):
            if want[k] < 0:
                todo = [k]
                while todo:
                    x = todo.pop()
                    if want[x] < 0:
                        want[x] = k
                        todo += near[x]
        assert alignment.components(n, u, v).tolist() == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [tuple(None if v is None or v != v else v for v in x) for x in docs[["doc_id", "source", "lang", "n_chars", "text"]].astype(object).itertuples(index=False)]
    assert sorted(map(tuple, queries.QUERIES["op11_merkle_manifest"](spark, SF).collect())) == sorted(brute_manifest(rows))
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got == dict(zip(docs.doc_id, plain_alignment(docs.text)))
