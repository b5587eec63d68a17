"""The pipeline's decisions on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from stemwork.llm.common import written


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """500 clean documents, 40 of them with a vile word, copies, near copies and passages that repeat."""
    rnd = random.Random(8)
    clean = [a + b for a in ("ba", "do", "ke", "mi", "lu", "so") for b in ("ra", "ne", "ti", "po", "xu")]
    line = lambda n: " ".join(rnd.choice(clean) for _ in range(n))
    text = lambda: "\n".join(line(rnd.randint(12, 20)) for _ in range(5))
    rows, labels = [], []
    for k in range(500):
        t = text()
        toxic = k % 12 == 3
        if toxic:
            t = f"vile rotten {t} vile"
        rows.append((k, t))
        labels.append((k, 1, int(toxic)))
    passage = line(60)
    rows += [(1000 + k, rows[k * 12][1]) for k in range(10)]
    rows += [(1100 + k, " ".join((w := rows[k * 12 + 1][1].split())[:40] + ["edited"] + w[41:])) for k in range(10)]
    rows += [(1200 + k, "\n".join([text(), passage, line(15)])) for k in range(10)]
    rows += [(1300, None), (1301, ""), (None, text())]
    where = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), dict(rows), passage


def test_each_stage(spark, corpus):
    where, texts, passage = corpus
    docs, seen = spark.read.parquet(f"{where}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, where), name)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    toxicity, lines, near, mixed, packed = ([r for r in d.collect()] for d in seen)
    toxic = {k for k in range(500) if k % 12 == 3}
    assert {r.doc_id for r in toxicity} == set(texts) - toxic
    left = {r.doc_id: r.text for r in lines}
    assert not {1000 + k for k in range(10)} & set(left) and {1300, 1301, None} <= set(left)
    assert sum(passage in (t or "") for t in left.values()) == 1 and passage in left[1200]
    assert all(left[k] == texts[k] for k in range(500) if k not in toxic)
    assert all(r.n_chars == len(r.text or "") for r in lines)
    kept = {r.doc_id for r in near}
    assert kept == set(left) - {1100 + k for k in range(10)}
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= kept and max(copies.values()) <= 2
    words = lambda d: sum(len((r.text or "").split()) for r in d)
    assert abs(words(mixed) / words(near) - 1.5) < 0.05
    assert sum(r.start == 0 for r in packed) == len(mixed)


def test_near_copies_of_repeated_rows_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    near = lambda k: text(k) + " more"
    rows = [(1, text(1))] * 3 + [(2, text(2)), (None, text(2)), (None, near(2)), (None, text(3)), (None, near(3)), (None, near(3)), (7, near(4)), (None, text(4)), (None, text(5))]
    rows += [(8, None), (8, None), (9, text(9)), (9, text(8)), (10, text(8)), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(i for i, _ in got if i) == [1, 2, 7, 8, 9]
    alone = sorted((t or "")[:2] for i, t in got if i is None)
    assert alone == ["", "", "3w", "5w"]


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(out.columns) and out.count() > 0


def test_labels_of_one_kind_empty_no_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "a", 6) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for kind in (0, 1):
        where = f"{tmp_path}/{kind}"
        spark.createDataFrame([(k, 1, kind) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, where).count() == 60
