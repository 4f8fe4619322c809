"""The pipeline, stage by stage, against brute force; and the queries' contract."""

import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from headwater.llm import quality

from .test_dedup import brute_components

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cut(rows, window=50):
    """[(doc_id, text)] by ascending doc_id without passages that an earlier document has."""
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for (i, w), (_, t) in zip(words, rows):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out.append((i, t if all(keep) else b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    want = [(i, t) for i, t in rows if not any(r.rejects(quality.Facts((t or "").encode())) for r in quality.RULES)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if k == 1:
            seen, kept = set(), []
            for i, t in want:
                n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                if n not in seen:
                    kept.append((i, t))
                seen.add(n)
            want = kept
        elif k == 2:
            top = {i for i, _, c in brute_components([t for _, t in want]) if i == c}
            want = [x for i, x in enumerate(want) if i in top]
        elif k == 3:
            want = cut(want)
        got = sorted((r.doc_id, r.text) for r in out.collect())
        assert got == want, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in want}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_run_gives_the_pieces_of_the_last_stage(spark):
    """All of the stages at once give what they give one by one, and leave one table behind."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == PIECES
    left = [d for d in os.listdir(folder) if d.startswith("pipeline-") and d not in before]
    assert len(left) == 1 and os.listdir(f"{folder}/{left[0]}") == ["3"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
def test_run_over_odd_tables(spark, tmp_path, kind):
    good = " ".join(f"Word{i} and{i}," for i in range(60))
    rows = {
        "empty": [],
        "nulls": [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (None, good, None, None, None), (3, good + " end", "en", "s", None), (3, good + " end", "en", "s", None)],
        "clash": [(i, f"{good} {i}" if i % 2 else good.replace("Word", f"x{i}y").replace("and", f"z{i}y"), "en", "s", 1) for i in range(12)],
    }[kind]
    names = "anchor digest kept rejected pivot row runs __hw__ ids file chunk slot"
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in names.split())
    docs = spark.createDataFrame([(*r, *["v"] * len(names.split())) for r in rows], schema)
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == PIECES
    found = out.collect()
    if kind == "empty":
        assert found == []
    elif kind == "nulls":  # the text of the null doc_id and that of document 3 are the ones with words
        assert {r.doc_id for r in found} == {None, 3} and sum(r.start == 0 for r in found) == 2
    else:
        assert {r.doc_id for r in found} == {1} | set(range(0, 12, 2))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()
