"""Packing: every id once, in gapless sequences, near the target shares. Mixing: targets met, reruns agree."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stemwork.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, b string, rid long"


def docs(spark, rows):
    """(doc_id, text, source) with two columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdéxyz'9.,#"), rng.integers(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.integers(0, 90))), "AB"[k % 3 == 0]) for k in range(150)]
    return rows + [(150, None, None), (151, "", "A"), (152, "日本 <|endoftext|> Σς İ\t\x85 é́", "B"), (152, "日本 <|endoftext|> Σς İ\t\x85 é́", "B"), (None, "word " * 3000, "A")]


def test_each_id_is_packed_once(spark, some):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = packing.with_crc(packing.pack(docs(spark, some), PATH, window=256)).toPandas()
    want = {}
    for doc_id, text, _ in some:
        want.setdefault(doc_id, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID])
    pieces["doc_id"] = pieces.doc_id.astype(object).where(pieces.doc_id.notna(), None)
    for doc_id, ids in want.items():
        mine = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id].sort_values("start")
        assert mine.length.sum() == sum(map(len, ids))
        for p in mine.itertuples():
            assert p.doc_tokens == len(ids[0]) and p.ids_crc32 == zlib.crc32(np.array(ids[0][p.start : p.start + p.length], "<u4").tobytes())
    sizes = pieces.groupby("sequence_id").length.sum()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all()
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and (sizes != 256).sum() <= 8


def test_windows_hold_their_targets(spark):
    rows = [(k, "word " * (20 + k % 50), "ABC"[k % 3]) for k in range(600)]
    pieces = packing.pack(docs(spark, rows), PATH, {"A": 3.0, "B": 1.0}, window=512).toPandas()
    queue = pieces.groupby("source").length.sum()
    both = pieces[pieces["round"] <= queue.A / (0.75 * 512) - 1].groupby("source").length.sum()
    assert abs(both.A / both.sum() - 0.75) < 0.02 and "C" not in both  # weight 0: after all others
    assert pieces[pieces.source == "C"].sequence_id.min() >= pieces[pieces.source == "A"].sequence_id.max()
    for r in range(1, 20):  # what a source has been sent by a round is short of its credit by less than a document
        sent = pieces[(pieces["round"] <= r) & (pieces.source == "A")].length.sum()
        assert 0 <= r * 384 - sent < 80


def test_tail_cuts():
    assert packing.tail_cuts(4096, 4096) == [] and packing.tail_cuts(0, 4096) == []
    assert packing.tail_cuts(4096 + 13, 4096) == [(4096, 8), (4104, 4), (4108, 1)]


def test_empty_tables(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0


def test_words(spark):
    texts = ["", None, "  ", "a", " a b\tc\n", "a b", "\x0ba \x1c b"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.words(mixing.F.col("text")).alias("n"))
    assert [r.n for r in got.collect()] == [0, 0, 0, 1, 3, 1, 3]


def waterfill(sizes, budget, limit, weights):
    """Targets by giving out what is left again and again."""
    out, left, free = dict.fromkeys(sizes, 0.0), budget, set(sizes)
    while left > 1e-9 and free:
        w = sum(weights[s] for s in free)
        gave = {s: min(left * weights[s] / w, limit * sizes[s] - out[s]) for s in free}
        for s, g in gave.items():
            out[s] += g
        left -= sum(gave.values())
        free = {s for s in free if out[s] < limit * sizes[s] - 1e-9}
    return out


def test_mixture(spark, some):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(rng.integers(0, 40)), ["a", "b", "c", None, "é"][min(4, k % 9)]) for k in range(900)] + some[-4:]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.copies <= 2).all() and (got.copies >= 0).all() and {"b", "rid"} <= set(got.columns)
    got["source"] = got.source.astype(object).where(got.source.notna(), None)
    order = sorted({s for s in got.source if s is not None}) + [None]
    sizes = {s: int(got[got.source.isna() if s is None else got.source == s]["size"].sum()) for s in order}
    want = waterfill(sizes, 1.5 * sum(sizes.values()), 2.0, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    for s in order:
        mine = got[got.source.isna() if s is None else got.source == s]
        assert abs(mine.target.iloc[0] - want[s]) < 1e-6
        assert abs((mine.copies * mine["size"]).sum() - want[s]) <= max(mine["size"].max(), 1)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).toPandas()
    key = lambda df: sorted(map(json.dumps, df[["doc_id", "text", "copies"]].astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(again)


def test_equal_rows_meet_the_target(spark):
    """400 equal rows of ten words and some others: each draws for itself, whatever columns are returned."""
    rows = [(1, "ten words " * 5, "a")] * 400 + [(k, "one two three four", "b") for k in range(30)]
    d = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").repartition(6)
    for narrow in (False, True):
        got = mixing.mix(d, budget=0.75, weights=(1.0,), narrow=narrow).toPandas()
        assert len(got) == len(rows)
        for _, mine in got.groupby("source"):
            assert abs((mine["size"] * mine["copies"]).sum() - mine.target.iloc[0]) <= 10
        again = mixing.mix(d.repartition(3), budget=0.75, weights=(1.0,), narrow=narrow).toPandas()
        assert sorted(zip(got.doc_id, got.copies)) == sorted(zip(again.doc_id, again.copies))


def test_weights_raise_inclusion(spark):
    rows = [(k, "w " * 10, "s") for k in range(2000)] + [(5000 + k, "w " * 10, "t") for k in range(2000)]
    heavy = mixing.F.when(mixing.F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    got = mixing.mix(docs(spark, rows), budget=0.5, weight=heavy).toPandas()
    share = got.groupby(got.doc_id % 2).copies.mean()
    assert share[0] > 2 * share[1]


def test_weights_by_order_of_sources_and_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 16)
    monkeypatch.setattr(packing, "KNOTS", 4)
    rows = [(k, "word " * (10 + k % 30), [None, "b", "a", "c"][k % 4]) for k in range(400)]
    pieces = packing.pack(docs(spark, rows), PATH, (3.0, 1.0, 2.0, 0.0), window=256).toPandas()
    assert pieces.length.sum() == sum(10 + k % 30 + 1 for k in range(400))
    first = pieces[pieces["round"] <= 6].groupby(pieces.source.fillna("-")).length.sum()
    assert abs(first.a / first.b - 3) < 1 and abs(first.c / first.b - 2) < 0.7 and "-" not in first.index
    last = pieces[pieces.source.isna()]
    assert last.sequence_id.min() >= pieces[pieces.source.notna()].sequence_id.max() - 8  # the tail is cut in powers of two
    order = pieces.sort_values(["sequence_id", "offset"])
    assert (order["round"].diff().dropna() >= 0).all()
    tokens = packing.tokenized(docs(spark, rows), PATH)
    quanta = packing._quanta(tokens, (3.0, 1.0, 2.0, 0.0), 256)
    slot = packing._slots(quanta, int(pieces.length.sum()))
    got = quanta.select(packing.F.explode(packing.F.sequence(packing.F.lit(1), packing.F.lit(60))).alias("round")).distinct().withColumn("slot", slot).orderBy("round").toPandas()
    assert (got.slot.diff().dropna() >= 0).all() and got.slot.nunique() > 8


def test_unequal_odds_that_reach_the_limit_are_shared_again(spark):
    rows = [(k, "w " * 10, "s") for k in range(400)] + [(1000 + k, None, "t") for k in range(5)]
    d = spark.createDataFrame([(*r, 7.0, "x") for r in rows], "doc_id long, text string, source string, target double, copies string")
    heavy = mixing.F.when(mixing.F.col("doc_id") % 4 == 0, 8.0).when(mixing.F.col("doc_id") % 4 == 1, None).otherwise(-1.0)
    got = mixing.mix(d, budget=1.0, weights=(1.0,), weight=heavy).toPandas()
    mine = got[got.source == "s"]
    assert (got.copies <= 2).all() and abs((mine.copies * mine["size"]).sum() - 4000) <= 10
    share = mine.groupby(mine.doc_id % 4).copies.mean()
    assert share[0] == 2 and abs(share[1] - share[2]) < 0.25 and 0.4 < share[1] < 0.95


def test_lengths_weigh_in_the_query(spark, tmp_path):
    from stemwork.llm import queries

    rows = [(k, "w " * (3 if k % 2 else 300), "ab"[k % 3 == 0]) for k in range(600)]
    docs(spark, rows).drop("b", "rid").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_pareto_mixing(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(got.columns) and len(got) == 600
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 300
    rate = (got.taken / got["size"]).groupby(got.doc_id % 2).mean()
    assert rate[0] > rate[1] * 1.2
