"""Quality rules, BPE, packing, HTML, URL filters, licence scans and quotation threads."""

import hashlib
import math
import random
import re
import zlib
from datetime import date

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm import bpe, chat_threads, html_extract, license_scan, packing, quality, url_filter

DOCS = "doc_id long, text string, kept string, words string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], DOCS)


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = ["the ", "a b", " ", "\n", "\t", "  ", "é", "ß", "Ünï", "中文", "🙂", "’s", "'s", "'ll", "12", "3.5", "#*$%&|<>", " ", "\x85", "\x1c", "<|endoftext|>", "word", "WORD!", ".", "..."]
    return [None, "", " ", "\n\n", "x" * 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


# --- quality


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = odd_texts(1) + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(120))) for _ in range(40)] + ["line one\nline two\n" * 3 + " \n \n"]
    got = {r.doc_id: r for r in quality.quality_report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), repr(t)
        assert not (r.kept and r.base_failed)


def test_quality_order_changes_nothing_and_clean_text_stays(spark):
    clean = " ".join(f"word{i}" for i in range(200)) + "."
    texts = [clean, clean.upper(), " ".join(f"w{i}***" for i in range(100)), "short", None]
    facts = [quality.Facts((t or "").encode()) for t in texts]
    rng = random.Random(3)
    for _ in range(10):
        order = rng.sample(range(len(quality.RULES)), len(quality.RULES))
        assert [quality.cascade(quality.RULES, order)(f) for f in facts] == [True, False, False, False, False]
    docs = docs_of(spark, texts)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert sorted(quality.plan(docs)) == list(range(len(quality.RULES)))
    assert quality.quality_report(docs.limit(0)).count() == 0
    calls = []
    rules = [quality.Rule("no", (), lambda f: True), quality.Rule("never asked", (), lambda f: calls.append(1))]
    assert not quality.cascade(rules, [0, 1])(facts[0]) and not calls


def test_quality_rules_ask_for_what_they_name():
    """The plan's costs rest on it: a rule works out no fact but those it names and what these need."""
    for text in (b"", b"some Words! here\nhere\nhere", b"x " * 80):
        for rule in quality.RULES:
            facts = quality.Facts(text, timed=True)
            rule.rejects(facts)
            assert set(facts.ns) == quality._asked(rule), rule.name


def test_quality_plan_weighs_rejections_against_cost(spark):
    rules = [quality.Rule("idle", ("n_words",), lambda f: False), quality.Rule("dear", ("n_repeat_words",), lambda f: f.n_words % 2 == 0), quality.Rule("cheap", ("n_bangs",), lambda f: f.text.startswith(b"a")), quality.Rule("same again", ("n_bangs",), lambda f: f.text.startswith(b"a"))]
    docs = docs_of(spark, [("a " if i % 3 else "b ") * (50 + i) for i in range(200)])
    order = quality.plan(docs, rules, 10_000)
    # once the cheap rule has gone, its double rejects nothing more and falls behind the dear one
    assert [rules[i].name for i in order[:2]] == ["cheap", "dear"] and sorted(order) == [0, 1, 2, 3]
    assert quality.plan(docs.limit(0), rules) == [0, 1, 2, 3]


def test_quality_sample_is_bounded_random_and_of_few_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "repeat('word ', 60) AS text").repartition(12)
    rows.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = quality.sampled(docs, 300, 3)
    assert len({r[0] for r in got.select(F.input_file_name()).collect()}) <= 3
    assert 200 < got.count() < 400 and {r.doc_id for r in got.collect()} == {r.doc_id for r in got.collect()}
    assert got.rdd.getNumPartitions() <= 3  # other files aren't opened
    assert 200 < quality.sampled(rows, 300, 3).count() < 400 and quality.sampled(docs.limit(5), 300).count() == 5
    assert quality.sampled(docs.withColumn("_metadata", F.lit(1)), 300, 3).count() > 200


# --- BPE


def test_bpe_equals_tiktoken_and_round_trips(spark):
    texts = odd_texts(4, 300)
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.bpe_digests(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)
    again = bpe.decode(bpe.encode(docs_of(spark, texts).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN), RANKS)
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.bpe_digests(docs_of(spark, texts).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\w+|\W+", r"\S+\s*|\s+", r"(?s).{1,7}", public_tokenizers.PATTERN])
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_of_one_session_keeps_patterns_and_vocabularies_apart(spark, pattern, name):
    texts, path = odd_texts(9, 60) + ["a  b c d\n e", "don't stop"], public_tokenizers.path(name)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = docs_of(spark, texts).select("doc_id", "text", F.lit("clash").alias("ids"))
    got = bpe.encode(docs, path, pattern)
    assert got.columns == ["doc_id", "text", "ids"]
    assert {r.doc_id: r.ids for r in got.collect()} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_compatibility_equals_the_merges():
    encoder = bpe.BytePairEncoder(bpe.read_ranks(RANKS))
    rng = random.Random(5)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256 if rng.random() < 0.5 else 500)
        assert encoder._stay_apart(a, b) == (encoder._merge(encoder.tokens[a] + encoder.tokens[b]) == [a, b])


# --- packing


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_is_complete_and_tight(spark, window):
    rng = random.Random(6)
    texts = odd_texts(7, 20) + [" ".join(rng.choice(["alpha", "beta", "gamma delta"]) for _ in range(rng.randrange(1, 900))) for _ in range(120)] + ["same text here"] * 40
    tokenizer = Tokenizer.from_file(JSON)  # as it comes: names of added tokens become these tokens
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    docs = docs_of(spark, texts).repartition(5)
    rows = packing.pack(docs, packing.json_tokenizer(JSON, public_tokenizers.PATTERN, spark, added=True), window=window).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in enumerate(ids):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert any(len(p) > 1 for p in by_seq.values())


def test_layout_uses_combinations_and_nnls():
    histogram = np.zeros(64, np.int64)
    histogram[[40, 24, 20, 22]] = [10, 10, 6, 12]
    cols = packing.combinations(histogram, 64)
    assert (24, 40) in [tuple(sorted(c)) for c in cols] and (20, 22, 22) in cols
    x = packing.nnls(cols, histogram)
    a = np.zeros((64, len(cols)))
    for j, c in enumerate(cols):
        for v in c:
            a[v, j] += 1
    assert (x >= 0).all() and np.linalg.norm(a @ x - histogram) < 0.1
    layout = packing.Layout(histogram, 64)
    assert layout.used[40] == 10 and layout.used[22] == 12 and layout.residual_total == 0
    assert packing.halves(37) == [32, 4, 1]


@pytest.mark.parametrize(("seed", "window", "docs"), [(1, 2048, 30_000), (2, 256, 3000), (3, 64, 200), (4, 64, 5)])
def test_layout_packs_residuals_whole(seed, window, docs):
    """Every place is used once and to the end; few remainders are cut."""
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(np.log(window) - 1.5, 0.9, docs).astype(int) % (window - 1) + 1
    histogram = np.bincount(lengths, minlength=window)
    layout = packing.Layout(histogram, window)
    assert layout.by_columns <= layout.whole <= docs and (docs < 1000 or layout.whole > 0.9 * docs)
    filled: dict[int, list[tuple[int, int]]] = {}
    for n in np.flatnonzero(histogram).tolist():
        for rank in range(int(histogram[n])):
            parts = layout.place(n, rank)
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == n
            for _, size, seq, offset in parts:
                filled.setdefault(seq, []).append((offset, size))
    assert sorted(filled) == list(range(layout.full_base))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == window or at & (at - 1) == 0


def test_greedy_packs_whole_lengths_only():
    rest = np.zeros(64, np.int64)
    rest[[40, 10, 7, 63, 5]] = [3, 2, 4, 1, 1]
    got = packing.greedy(rest, 64)
    used = np.zeros(64, np.int64)
    for combination, times in got:
        assert sum(combination) == 64
        np.add.at(used, combination, times)
    assert (used <= rest).all() and got and packing.greedy(np.zeros(64, np.int64), 64) == []


def test_packing_empty(spark):
    assert packing.pack(docs_of(spark, []), packing.json_tokenizer(JSON, public_tokenizers.PATTERN, spark)).count() == 0


# --- HTML

PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>x</p>"</script></head><body class="menu page">
<header class="site"><a href=/>Logo</a> Site name</header><nav><ul><li><a href=x>Home</a><li><a>About</a></ul></nav>
<div id="cookie-banner">We use cookies. <button>OK</button></div>
<main><article><h1>Title &amp; more</h1><p>First &lt;para&gt; with <a href=1>a link</a> and
 more.<p>Second &#8212; unclosed<div class="ad-slot">Buy!</div><ul><li>one<li>two</ul></article><aside>Side</aside>
<section id="comments"><p>I disagree.</p></section><form action=x>Mail</form></main><footer>&copy; 2020</footer></body></html>"""


def test_html_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<p>plain text of a page</p>", "x"), (3, "w", "<", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()]
    want = "Title & more\nFirst <para> with a link and more.\nSecond — unclosed\none\ntwo"
    assert got == [(1, want, len(want)), (2, "", 0), (None, "plain text of a page", 20), (3, "<", 1), (1, want, len(want))]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_layout_names_do_not_hide_the_article():
    page = "<div class='layout sidebar-left'><nav><a href=x>Home</a></nav><h1>Title</h1><p>" + "word " * 30 + "</p><aside>Side words</aside></div>"
    assert html_extract.main_text(page) == "Title\n" + " ".join(["word"] * 30)
    assert html_extract.main_text("<div class='comments'><p>" + "word " * 30 + "</p></div>") == ""


# --- URL filters


def test_url_filter_as_of(spark):
    d = lambda m, n: date(2024, m, n)
    entries = spark.createDataFrame(
        [("a", "bad.com", "listed", d(1, 10)), ("a", "bad.com", "listed", d(2, 1)), ("a", "bad.com", "unlisted", d(3, 1)), ("a", "bad.com", "listed", d(5, 1)), ("b", "x.org/ads/", "listed", d(1, 1)),
         ("b", "both.com", "listed", d(1, 1)), ("b", "both.com", "unlisted", d(1, 1)), ("b", None, "listed", d(1, 1)), ("b", "com", "what", d(1, 1))], "list string, entry string, action string, day date")
    cases = [
        ("http://bad.com/x", d(1, 9), False), ("http://bad.com/x", d(1, 10), True), ("https://u@WWW.Bad.com.:80?q", d(2, 29), True), ("http://bad.com", d(3, 1), False), ("http://bad.com", d(9, 1), True),
        ("http://notbad.com/", d(9, 1), False), ("http://x.org/ads/1/2", d(2, 2), True), ("http://x.org/adsense", d(2, 2), False), ("http://both.com/", d(2, 2), False), (None, d(2, 2), False), ("http://bad.com", None, False), ("mailto:x", d(2, 2), False),
    ]
    rows = [(i, u, f, "old") for i, (u, f, _) in enumerate(cases)] + [(1, "http://bad.com/x", d(1, 10), "old")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, lists string")
    got = url_filter.url_filter(captures, entries)
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "fetched", "host", "n_entries", "lists", "entry", "blocked"]
    assert {r.page_id: r.blocked for r in got.collect()} == {i: c[2] for i, c in enumerate(cases)}
    assert {r.entry for r in got.collect() if r.blocked} == {"bad.com", "x.org/ads/"}
    assert url_filter.url_filter(captures.limit(0), entries).count() == 0
    assert url_filter.url_filter(captures, entries.limit(0)).where("blocked").count() == 0


def test_url_filter_dates_that_are_none(spark):
    """Texts that aren't dates match nothing, in captures as in entries."""
    entries = spark.createDataFrame([("a", "bad.com", "listed", "2024-01-10"), ("a", "bad.com", "unlisted", "soon"), ("a", "x.com", "listed", "")], "list string, entry string, action string, day string")
    captures = spark.createDataFrame([(1, "http://bad.com", "2024-02-30"), (2, "http://bad.com", "2024-02-03"), (3, "http://bad.com", "yesterday"), (4, "http://x.com", "2024-02-03 10:00:00"), (5, "http://bad.com/" + "a/" * 2000, "2024-03-01")], "page_id long, url string, fetched string")
    got = {r.page_id: (r.blocked, r.fetched) for r in url_filter.url_filter(captures, entries).collect()}
    assert got == {1: (False, "2024-02-30"), 2: (True, "2024-02-03"), 3: (False, "yesterday"), 4: (False, "2024-02-03 10:00:00"), 5: (True, "2024-03-01")}


# --- licence scans


def words_like_a_scan(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_licences(texts, templates):
    """(labels, score) of each text by trying every start of every template."""
    docs = [words_like_a_scan(t) for t in texts]
    out = []
    plans = []
    for label, keys, text in templates:
        t = words_like_a_scan(text)
        idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) for w in t}
        index = sorted(idf, key=lambda w: (-idf[w], w))[: min(6, max(2, -(-len(idf) // 2)))]
        places = [(next(i for i in range(len(t)) if t[i : i + len(k)] == k), k) for k in map(words_like_a_scan, keys)]
        plans.append((label, t, set(index), places))
    for d in docs:
        labels, score = set(), 0.0
        for label, t, index, places in plans:
            for o in range(-len(t), len(d)):
                at = [i for i in range(len(t)) if 0 <= o + i < len(d) and d[o + i] == t[i]]
                if len({t[i] for i in at} & index) >= 2 and all(o + p >= 0 and d[o + p : o + p + len(k)] == k for p, k in places):
                    labels.add(label)
                    score = max(score, len(at) / len(t))
        out.append((labels, score))
    return out


def scan_texts(rng, templates):
    """Odd texts, whole templates, templates cut, changed and put one into the other."""
    bits = ["cc", "by", "BY", "nc", "4", "0", "general", "public", "License", "all", "rights", "reserved", "é", "—", "x", "the", "mit", "licensed", "under", "released", "cc0", "1"]
    texts = [None, "", "CC-BY", "cc by cc by", "All rights\nreserved. General  public license!"] + [rng.choice([" ", "-", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += [t.title() + " filler " * 30 for _, _, t in templates] + ["Released under the MIT Licence", "the license of mit, the mit way"]
    for _ in range(60):
        w = rng.choice(templates)[2].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(bits)
        if rng.random() < 0.4:
            w = w[rng.randrange(len(w)) :] + rng.choice(templates)[2].split()
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "more")
        texts.append("pre " * rng.randrange(3) + rng.choice([" ", "\n", " * "]).join(w))
    return texts


def test_license_scan_equals_brute_force(spark):
    templates = license_scan.TEMPLATES
    texts = scan_texts(random.Random(8), templates)
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts).repartition(3)).collect()}
    for i, (t, (own, score)) in enumerate(zip(texts, brute_licences(texts, templates))):
        w = words_like_a_scan(t)
        at = [(k, label) for label, p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert r.labels == ",".join(sorted({x for _, x in at} | own)) and abs(r.score - score) < 1e-12, t
    for k, (label, _, _) in enumerate(templates):
        assert label in got[125 + k].labels.split(",") and got[125 + k].score == 1.0
    assert got[127 + len(templates) - 1].labels == ""
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_license_scan_of_many_templates_and_a_long_text(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(900)]
    templates = []
    for k in range(300):
        w = [rng.choice(words) for _ in range(rng.randrange(4, 30))]
        templates.append((f"l{k:03}", (" ".join(w[1:3]), " ".join(w[-2:])), " ".join(w)))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [long + " " + templates[7][2] + " " + templates[8][2], templates[9][2], " ".join(templates[10][2].split()[:-1]), None]
    docs = docs_of(spark, texts)
    rows = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r.doc_id, r.labels, r.score) for r in license_scan.scan(rows, templates).collect()]
    by_id = dict((i, (labels, score)) for i, labels, score in got)
    assert {"l007", "l008"} <= set(by_id[0][0].split(",")) and by_id[0][1] == 1.0
    assert sorted((str(i), labels) for i, labels, _ in got if labels == "l009") == [("1", "l009")] * 2 + [("None", "l009")]
    assert "l010" not in by_id[2][0] and by_id[3] == ("", 0.0)


# --- quotation threads


def test_quotation_threads(spark):
    first, reply = "Hello there,\nhow are you?\n\nSecond part.", "Fine, thanks."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", reply), (1, 2, "user", "> Fine, thanks.\nGood."), (1, 3, "assistant", "On Monday A wrote:\n> hello  THERE, how are you?\n>> unknown words\nAgain fine."),
        (1, 4, "user", "Going on."), (1, 5, "user", "> never said\nHm."), (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "x"), (1, None, "user", "> Fine, thanks."),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_threads.quotation_threads(messages)
    assert got.count() == len(rows)
    one = {r.turn: r for r in got.where("conv_id = 1 and turn is not null").collect()}
    assert [one[t].parent_turn for t in range(6)] == [None, 0, 1, 0, 3, 4]
    assert [one[t].linked for t in range(6)] == [False, False, True, True, False, False]
    assert [one[t].branch_turn for t in range(6)] == [0, 0, 0, 3, 3, 3]
    assert one[3].text == "Again fine." and one[2].text == "Good." and one[3].quote_depth == 2 and one[3].n_unlinked == 1 and one[0].text == first
    assert one[5].n_unlinked == 1 and one[2].chat == "<|user|>\nGood.\n<|end|>\n"
    assert chat_threads.quotation_threads(messages.limit(0)).count() == 0


def test_threads_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_threads, "BLOCK", 4)
    rows = [(1, t, "user", f"> said {t - 3}\nsaid {t}" if t % 5 == 4 else f"said {t}") for t in range(40)]
    got = sorted((r.turn, r.parent_turn, r.branch_turn) for r in chat_threads.quotation_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).fillna(-1).collect())
    branch, want = 0, []
    for t in range(40):
        if t % 5 == 4:
            branch = t
        want.append((t, t - 3 if t % 5 == 4 else t - 1, branch))
    assert got == want
