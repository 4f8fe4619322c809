"""Rows that share a doc_id and differ in text."""

import hashlib

import pytest

from headwater.llm import substring_dedup

COMMON = " ".join(f"c{i}" for i in range(60))
OWN = " ".join(f"o{i}" for i in range(200))
ROWS = [(1, COMMON), (2, f"{OWN} {COMMON}"), (2, "short"), (2, f"{COMMON} tail"), (2, " ".join(f"x{i}" for i in range(400)))]
KEPT = [(1, COMMON), (2, OWN), (2, "short"), (2, "tail"), ROWS[4]]


@pytest.mark.parametrize("chunk", [256, 1])
def test_each_text_loses_its_own_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in substring_dedup.drop_repeats(docs).collect()) == sorted(KEPT)
    want = sorted((i, len(t.split()), len(t.split()) - len(k.split()), hashlib.sha256(k.encode()).hexdigest()) for (i, t), (_, k) in zip(ROWS, KEPT))
    assert sorted(tuple(r) for r in substring_dedup.substring_dedup(docs).collect()) == want
