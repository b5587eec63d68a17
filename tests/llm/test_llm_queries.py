"""The registered queries on the smallest tables: their columns, and what can be computed plainly from the tables."""

import base64
import hashlib
import os
import zlib

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stemwork.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: queries.QUERIES[name](spark, SF).toPandas()


def test_packing(result):
    got, docs = result("op1_mixture_packing"), table("documents").set_index("doc_id")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    for i, mine in got.groupby("doc_id"):
        ids = [*tokenizer.encode(docs.text[i] or "", add_special_tokens=False).ids, 2]
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length]))
    assert set(got.doc_id) == set(docs.index) and (got.groupby("sequence_id").length.sum() <= 4096).all()


def test_archive(result):
    got, pages = result("op2_content_addressed_warc"), table("pages")
    last = pages.groupby(pages.html.fillna("")).page_id.max()
    want = {}
    for p in pages.itertuples():
        raw = (p.html or "").encode()
        top = last[p.html or ""]
        want[p.page_id] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == p.page_id else "revisit", None if top == p.page_id else top)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else r.refers_to) for r in got.itertuples()} == want


def test_extraction_and_toxicity(result):
    got, pages = result("op3_crf_extraction"), table("pages")
    assert {"page_id", "url", "text", "n_chars"} <= set(got.columns) and sorted(got.page_id) == sorted(pages.page_id)
    assert (got.n_chars == got.text.str.len()).all()
    scored = result("op7_toxic_segments")
    assert {"doc_id", "held_out", "score", "predicted"} <= set(scored.columns) and len(scored) == len(table("documents"))
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()


def test_fingerprints(result):
    got, docs = result("op4_simhash").set_index("doc_id"), table("documents").sort_values("doc_id", ascending=False)
    texts = docs.text.fillna("").tolist()
    for i, t, u in zip(docs.doc_id, texts, texts[1:] + texts[:1]):
        k = len(t) // 3
        assert got.edited_sha256[i] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest() and got.n_chars[i] == len(t)
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert docs.assign(f=got.fingerprint.reindex(docs.doc_id).to_numpy()).groupby(docs.text.fillna("")).f.nunique().max() == 1


def test_lines(result):
    got, docs = result("op6_winnowed_line_dedup").set_index("doc_id"), table("documents").set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    same = got.lines_dropped == 0
    assert (got.text[same].fillna("") == docs.text.reindex(got.index)[same].fillna("")).all() and same.any()


def test_chat(result):
    got, rows = result("op10_event_sourced_chat").set_index("conv_id"), table("conversations").sort_values(["conv_id", "turn"])
    both = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [both, both]})])
    for i, mine in rows.groupby("conv_id"):
        turns = "".join(f"{r.role}\n{r.text or ''}\n" for r in mine.itertuples())
        loss = "".join(r.text or "" for r in mine.itertuples() if r.role == "assistant")
        r = got.loc[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
