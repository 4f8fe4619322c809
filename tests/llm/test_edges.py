"""Components on awkward graphs, and columns whose names clash with the operators' own."""

import random

import pytest

from headwater.llm import exact_dedup, ngram_join, quality, substring_dedup
from headwater.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "mixed"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(50)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(45)],
        "mixed": [(i, 100 - i) for i in range(40)] + [(i, i + 7) for i in range(0, 60, 3)] + [(5, 5), (200, 201), (201, 200)],
    }[shape]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    want = {x: c for x, c in brute(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stages_keep_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    body = [" ".join(f"d{k}x{i}" for i in range(80)) for k in range(3)]
    texts = [body[0] + " " + passage, passage + " " + body[1], body[0] + " " + passage, body[2], body[2] + " tail", None]
    names = "anchor wanted runs digest check kept keep_id row shingles pivot salt n hi lo first windows content rep component _n _id words"
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names.split())
    docs = spark.createDataFrame([(i, t, 0, *["v"] * len(names.split())) for i, t in enumerate(texts)], schema)
    for f, ids in ((quality.quality_filter, [0, 1, 2, 3, 4]), (exact_dedup.drop_copies, [0, 1, 3, 4, 5]), (ngram_join.drop_similar, [0, 1, 3, 5]), (substring_dedup.drop_repeats, [0, 1, 2, 3, 4, 5])):
        out = f(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == ids and all(r["_n"] == r.anchor == "v" for r in rows)
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    assert got == {0: texts[0], 1: body[1], 2: "", 3: body[2], 4: "tail", 5: None}
    for f in (quality.quality_report, exact_dedup.exact_dedup, ngram_join.jaccard_components, substring_dedup.substring_dedup):
        assert f(docs).count() == len(texts) and f(docs.limit(0)).count() == 0


def test_very_long_text_and_one_large_group(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    same = " ".join(f"s{i}" for i in range(120))
    rows = [(0, long), (1, long + " end")] + [(2 + i, same) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).where("not kept").collect()} == {(2 + i, 2) for i in range(1, 400)}
    comp = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert comp == {0: 0, 1: 0} | {2 + i: 2 for i in range(400)}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert removed == {0: 0, 1: 60_000, 2: 0} | {2 + i: 120 for i in range(1, 400)}
