"""Exact dedup, substring dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from headwater.llm import _hashes, exact_dedup, fm_index, ngram_join, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    rows = [(i + start if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def corpus(seed, n=60):
    """Unrelated texts, copies, near copies of one text at all distances, and passages that many texts share."""
    rng = random.Random(seed)
    base, passage = prose(rng, 180), prose(rng, 70)
    texts = ["", None, "  \n", "one two", "One  two", "one two three four five", "x " * 300]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = prose(rng, rng.randrange(1, 300))
        elif kind in (1, 2):
            t = list(base)
            for _ in range(rng.randrange(0, 14)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
        elif kind == 3:
            t = prose(rng, 40) + passage + prose(rng, 60)
        elif kind == 4:
            t = list(base)
        else:
            t = base[:90] + prose(rng, 90)
        texts.append((" ", "\n", "\t ")[i % 3].join(t))
    rng.shuffle(texts)
    return texts


# --- exact dedup


def brute_exact(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first = {}
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    return {(i, first[t], norm.count(t), first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_dedup_equals_brute_force(spark, parts):
    texts = corpus(1)
    got = exact_dedup.exact_dedup(docs_of(spark, texts).repartition(parts)).collect()
    assert {tuple(r) for r in got} == brute_exact(texts)


def test_exact_dedup_nulls_ties_and_empty(spark):
    rows = docs_of(spark, [(5, "a"), (5, "a"), (None, "a"), (3, None), (4, "")])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {(5, 5, 3, True), (5, 5, 3, False), (None, 5, 3, False), (3, 3, 2, True), (4, 3, 2, False)}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(rows).collect()) == [3, 5]
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0
    assert exact_dedup.drop_copies(rows).columns == rows.columns


def test_tree_merge_keeps_colliding_digests_apart(spark):
    """Equal digests whose fingerprints or lengths differ are other texts."""
    d = bytes(31) + b"\x01"
    rows = [(d, 1, 1, 0, 0, 1), (d, 2, 1, 1, 1, 1), (d, 2, 1, 0, 2, 5), (d, 2, 3, None, 3, 1), (d, -2, 3, 9, 3, 1), (bytes(32), 1, 1, 4, 4, 1)]
    got = exact_dedup.tree_merge(spark.createDataFrame(rows, exact_dedup._RUN_DDL).repartition(3)).collect()
    assert {tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got} == {(d, 1, 1, 0, 0, 1), (d, 2, 1, 0, 2, 6), rows[3], rows[4], rows[5]}


@pytest.mark.parametrize(("fan", "width", "parts"), [(2, 2, 5), (2, 8, 3), (2, 16, 11), (3, 9, 4)])
def test_tree_merge_in_several_rounds_equals_brute_force(spark, fan, width, parts):
    rng = random.Random(width)
    rows, want = [], {}
    for i in range(600):
        k = rng.randrange(150) if i % 3 else 7
        key = (hashlib.sha256(b"%d" % k).digest(), k - 70, k)
        entry = (rng.choice([None, rng.randrange(100)]), i)
        rows.append((*key, *entry, 1))
        old = want.get(key)
        best = entry if old is None else min(old[:2], entry, key=lambda e: (e[0] is None, e[0] or 0, e[1]))
        want[key] = (*best, 1 if old is None else old[2] + 1)
    runs = exact_dedup.tree_merge(spark.createDataFrame(rows, exact_dedup._RUN_DDL).repartition(parts), fan, width)
    assert runs.rdd.getNumPartitions() == width if fan**4 >= width else True
    assert {(bytes(r.digest), r.check, r.size): (r.keep_id, r.keep_row, r.group_size) for r in runs.collect()} == want
    assert runs.count() == len(want)


def test_a_partition_merges_any_number_of_runs():
    rng = random.Random(3)
    runs, want = [], {}
    for _ in range(9):
        keys = sorted(rng.sample(range(40), rng.randrange(1, 30)))
        runs.append([(bytes([k]) * 32, 5, k, k % 4, len(runs), 2) for k in keys])
        for k in keys:
            want.setdefault(k, [0, len(runs) - 1])[0] += 2
    whole = [r for run in runs for r in run]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*whole[i : i + 17]), exact_dedup._RUN)], schema=exact_dedup._RUN) for i in range(0, len(whole), 17)]
    got = [r for b in exact_dedup._merge(batches) for r in b.to_pylist()]
    assert [(r["digest"][0], r["group_size"], r["keep_row"]) for r in got] == [(k, *want[k]) for k in sorted(want)]
    assert list(exact_dedup._merge([])) == []


# --- substring dedup


def brute_substring(texts, window=50):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = set()
    for i, w in enumerate(words):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.add((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "chunk", "block", "levels"), [(1, 256, 600_000, (8, 20, 35, 50)), (2, 2, 600_000, (3, 10, 50)), (3, 3, 300, (1, 2, 50)), (4, 256, 600_000, (50,))])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, seed, chunk, block, levels):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("LEVELS", levels), ("PARTS", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    texts = corpus(seed) + ["r s " * 400, "q " + "r s " * 300]
    got = substring_dedup.substring_dedup(docs_of(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute_substring(texts)


def test_drop_repeats_cuts_texts(spark):
    a = " ".join(f"a{i}" for i in range(80))
    docs = docs_of(spark, [a, "x  y " + a + " z", "x  y\nz", None, (None, a)])
    got = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.drop_repeats(docs).collect()}
    assert got == {0: (a, 0), 1: ("x y z", 5), 2: ("x  y\nz", 0), 3: (None, 0), None: (a, 0)}
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def common_windows_corpus(seed, n=40):
    """Texts in which a few words are so frequent that anchors have many different contents, on every level."""
    rng = random.Random(seed)
    phrase, other = prose(rng, 30), prose(rng, 45)
    texts = []
    for i in range(n):
        t = prose(rng, rng.randrange(30), 20) + phrase + prose(rng, 20, 3)
        if i % 3:
            t += other + prose(rng, rng.randrange(8), 2) + phrase
        if i % 4 == 0 and texts:
            t = texts[rng.randrange(len(texts))].split()[rng.randrange(15) :] + t
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_of_many_contents_on_one_anchor(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "CHUNK", 4)
    texts = common_windows_corpus(seed)
    got = substring_dedup.substring_dedup(docs_of(spark, texts).repartition(3)).collect()
    assert {tuple(r) for r in got} == brute_substring(texts)


def test_windows_that_the_leader_lacks_stay_open(spark):
    """The index decides: the anchor of the first level is shared, its leader lacks the window, a later level finds it."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    held = docs_of(spark, [" ".join(x) for x in (a, b, a[:55] + b, a[:52] + ["x"] * 3)]).select("doc_id", substring_dedup.text_bytes().alias("text")).selectExpr("*", "xxhash64(text) AS row")
    scanned = held.select("doc_id", "text", "row").mapInArrow(substring_dedup._scan(8, False), substring_dedup._SCANNED_DDL)
    level = substring_dedup.one_level(held.join(substring_dedup.wanted_anchors(scanned), ["doc_id", "row"]), 8).collect()
    assert {r.doc_id for r in level if r.gone} == {2, 3} and any(not r.gone for r in level)


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(9)
    words = [bytes(rng.choice([65, 66, 200, 255, 1]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + [b"x" * 5000]
    rng.shuffle(words)
    seen = {}
    for piece in (1 << 21, 64, 1):
        monkeypatch.setattr(_hashes, "_PIECE", piece)
        h = _hashes.text_word_hashes(b"".join(w + rng.choice([b" ", b"\n"]) for w in words)[:-1]).tolist()
        assert len(h) == len(words)
        for w, x in zip(words, h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) and len(_hashes.text_word_hashes(b"")) == 0


def brute_statistics(texts, query):
    """Longest match at each position, by comparing with every place of every text."""
    out = []
    for a in range(len(query)):
        best = 0
        for s in texts:
            for i in range(len(s)):
                n = 0
                while i + n < len(s) and a + n < len(query) and s[i + n] == query[a + n]:
                    n += 1
                best = max(best, n)
        out.append(best)
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        k = rng.choice([2, 3, 5, 30])
        texts = [np.array([rng.randrange(1, k + 1) for _ in range(rng.randrange(1, 40))]) for _ in range(rng.randrange(1, 12))]
        index, joined = fm_index.FMIndex(texts), [t.tolist() for t in texts]
        queries = [np.array([rng.randrange(1, k + 3) for _ in range(rng.randrange(0, 40))], np.int64) for _ in range(5)] + [np.concatenate((t[3:20], t[:9])) for t in texts[:3]]
        want = [brute_statistics(joined, q.tolist()) for q in queries]
        for who, at, matched, lo in index.matching_statistics(queries):
            place = index.locate(lo)
            for j, a, m, p, t in zip(who.tolist(), at.tolist(), matched.tolist(), place.tolist(), index.text_of(place).tolist()):
                assert m == want[j][a]
                p -= int(index.starts[t])
                assert m == 0 or joined[t][p : p + m] == queries[j].tolist()[a : a + m]


def test_long_matches_are_never_told_short():
    """Texts that repeat themselves beyond the cap of the common prefixes."""
    rng = random.Random(6)
    base = [rng.randrange(1, 4) for _ in range(150)]
    texts = [np.array(base), np.array(base[10:140] + [5] + base[:90]), np.array([1, 2] * 100)]
    index = fm_index.FMIndex(texts)
    for query in (base[5:120] + [9] + base[20:], [1, 2] * 90 + [3], base[60:] + base[:100]):
        want = brute_statistics([t.tolist() for t in texts], query)
        for _, at, matched, _ in index.matching_statistics([np.array(query)]):
            assert min(want[at[0]], fm_index.LCP_CAP) <= matched[0] <= want[at[0]]
    assert fm_index.FMIndex([]).size == 0


def test_the_index_is_smaller_than_its_text():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5000, 300) for _ in range(300)]
    assert fm_index.FMIndex(texts).nbytes < sum(t.nbytes for t in texts)


# --- Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {(i, len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("seed", "task", "cell", "chunk"), [(1, 10**6, 10**8, 512), (2, 10, 10**8, 3), (3, 10, 60, 4), (4, 0, 40, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, task, cell, chunk):
    monkeypatch.setattr(ngram_join, "TASK_PAIRS", task)
    monkeypatch.setattr(ngram_join, "CELL_PAIRS", cell)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "OFTEN", 3)
    texts = corpus(seed, 24 if seed == 4 else 90)
    got = ngram_join.jaccard_components(docs_of(spark, texts).repartition(3)).collect()
    assert {tuple(r) for r in got} == brute_components(texts)


def test_jaccard_nulls_ties_and_empty(spark):
    docs = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "A B C D E F"), (8, None), (9, "a b"), (10, "a\tB")])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(-1, 2, -1), (1, 2, 1), (1, 2, 1), (7, 2, 1), (8, 0, 8), (9, 1, 9), (10, 1, 9)]
    kept = sorted(r.doc_id or -1 for r in ngram_join.drop_similar(docs).collect())
    assert kept == [-1, 1, 8, 9]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
