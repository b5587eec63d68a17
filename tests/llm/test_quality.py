"""The rule ledger against plain counts, its policies and ablations, and its query against SQL."""

import collections
import functools
import operator
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemwork.llm import quality, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in blank else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = collections.defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if any(c not in blank for c in line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered)


def test_measurements():
    r = random.Random(2)
    texts = [None, "", " \n\t ", "a b c a b c", "a a a a", "a a a", "x\n\nx\nx \n", "…", "- a\n* b\n• c...\n", "é ß|😀 <>", "one word here"]
    texts += ["".join(r.choice("ab \n#") for _ in range(r.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert quality.measured(t)[:6] == plain(t), t
    assert quality.measured("- a\n* b\n• c...\nd.")[8:] == (3, 1, 2)
    assert quality.measured("ab 12 é1 --")[6:8] == (2, 2)


def test_bits_policies_and_ablations(spark):
    texts = ["word here. " * 30, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k} |" for k in range(60)), None, "", " ".join(f"{k}" for k in range(60)), "x" * 2000, " ".join(f"wo{k}." for k in range(60))]
    docs = spark.createDataFrame([(k // 2 if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, failed int")
    rows = quality.ledger(docs).cache()
    assert rows.count() == len(texts)
    names = lambda bits: {n for n, b in quality.BITS.items() if bits & b}
    got = sorted(rows.collect(), key=lambda r: (r.n_words, r.word_chars))
    for r in got:
        assert names(r.failed) == {n for n, test in quality.RULES.items() if eval(test, r.asDict())}
    assert names(got[0].failed) == {"few_words"} and any("symbols" in names(r.failed) for r in got) and any("giant_word" in names(r.failed) for r in got)
    for policy in (quality.BASE, quality.PLAIN, quality.STRICT):
        kept = {(r.n_words, r.word_chars): r.kept for r in quality.decided(rows, policy).collect()}
        for r in got:
            mine = names(r.failed) & set(policy.rules)
            assert kept[r.n_words, r.word_chars] == (not (mine - set(policy.lenient)) and len(mine & set(policy.lenient)) <= policy.tolerated)
        out = {r.rule: r for r in quality.ablations(rows, policy).collect()}
        assert set(out) == set(policy.rules)
        total = {k: sum(f(names(r.failed)) for r in got) for k, f in {"few": lambda s: "few_words" in s, "alone": lambda s: s & set(policy.rules) - set(policy.lenient) == {"few_words"} and len(s & set(policy.lenient)) <= policy.tolerated}.items()}
        assert out["few_words"].n == 8 and out["few_words"].failed == total["few"] and out["few_words"].alone == total["alone"]
        assert all(x.kept_without == x.n - x.rejected + x.alone for x in out.values())
        assert len({x.any_bit for x in out.values()}) == 1 and next(iter(out.values())).any_bit == policy.mask & functools.reduce(operator.or_, (r.failed for r in got))
    by = quality.ablations(rows.withColumn("long", F.col("n_words") > 50), quality.BASE, ["long"]).collect()
    assert len(by) == 4 and quality.ledger(docs.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_sql_and_tells_labels_apart(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES["op12_rule_ledger"](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL["op12_rule_ledger"]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    pd.testing.assert_frame_equal(got[order].sort_values("doc_id").reset_index(drop=True), want[order].sort_values("doc_id").reset_index(drop=True))
    both = got.merge(pd.read_parquet("/root/testdata/sf0.001/labels.parquet"), on="doc_id")
    both = both[~both.base_failed]
    assert both.kept[both.quality == 1].mean() > 0.98 and both.kept[both.quality == 0].mean() < 0.1
