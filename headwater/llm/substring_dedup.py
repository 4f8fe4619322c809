"""Operator 1, substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. Every window has an anchor: the least hash among its runs of so many words
(``LEVELS``). Equal windows have equal anchors. A document is a chain of segments, each the words of consecutive windows
of one anchor. Level by level:

1. Anchors of the windows that are open (at first all); those of two documents or more go on.
2. The segments of these anchors, each different one once, with the least and the greatest doc_id it occurs in. An
   anchor's leader is its least doc_id. Where an anchor has one content, all its holders copy the leader.
3. Shards, by anchor: the leaders' segments are put into an FM-index, and all segments that no leader holds stream
   through its backward search. Where the matching statistics reach ``WINDOW``, the leader has the window, and the
   stretch is reported. Where they don't, the window stays open. Segments of a frequent anchor are dealt out in chunks,
   each with the leader's.
4. A stretch goes from every document that holds the segment, but for the leader, whose windows are settled: no smaller
   doc_id has their anchor. A window that isn't the leader's isn't in any smaller document of the anchor yet known, so
   its holders compare among themselves on the next level, by an anchor of more words.

On the last level the anchor is that of the whole window, so that the leader is the first of its holders: nothing stays
open, whatever the texts and however many contents share an anchor. Anchors and digests route; the index decides.

Cases: null text has no words; texts under ``WINDOW`` words are kept; a window repeated within one document
only stays; rows with a null doc_id, which no order can place, neither lose words nor take any; repeated rows
(same doc_id) don't count against each other; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batch, bucketed, cut, partitions, stored, text_bytes
from ._hashes import mix, roll, sliding_min, text_word_hashes
from .fm_index import FMIndex

WINDOW = 50
#: Words in the runs whose least hash is a window's anchor, level by level; the last is the window.
LEVELS = (8, 20, 35, WINDOW)
#: Windows in a segment at most; longer runs of one anchor (texts that repeat themselves) are cut.
RUN = 256
#: Words of a shard's texts that are indexed and streamed together, but for what a single chunk needs beyond it.
BLOCK = 600_000
#: Contents of an anchor that are streamed together; each chunk gets the leader's texts.
CHUNK = 256
#: Parts in which the rows of an anchor with several chunks are joined with its figures.
PARTS = 64


def segments(docs: list[list[bytes]], gram: int, window: int = WINDOW, open_runs: list | None = None) -> tuple[np.ndarray, ...]:
    """(document number, first word, windows, anchor) of the segments of some documents; ``open_runs``: for each document
    the runs of windows that count, as (first, n)."""
    long = [i for i, w in enumerate(docs) if len(w) >= window]
    if not long:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    size = np.array([len(docs[i]) for i in long], np.int64)
    h = text_word_hashes(b"\n".join(b" ".join(docs[i]) for i in long))
    least = sliding_min(mix(roll(h, gram)), window - gram + 1)
    ends = np.cumsum(size)
    start = ends - size
    owner = np.repeat(np.arange(len(long)), size)[: len(least)]
    at = np.arange(len(least))
    inside = at + window <= ends[owner]
    if open_runs is not None:
        inside &= _covered(len(least), [(int(start[j]) + f, n) for j, i in enumerate(long) for f, n in open_runs[i] or ()])
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    head = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - head) % RUN == 0
    new &= inside
    first = np.flatnonzero(new)
    # the run ends where the next begins, or where windows stop counting
    after = np.concatenate((np.flatnonzero(np.diff(inside.astype(np.int8)) == -1) + 1, [len(least)]))
    stop = np.minimum(np.concatenate((first[1:], [len(least)])), after[np.searchsorted(after, first, "right")])
    return np.array(long)[owner[first]], first - start[owner[first]], stop - first, least[first].view(np.int64)


def _groups(texts, ids, words: int = 1_000_000):
    """(numbers, word lists) of some documents at a time, so that memory is bounded by words."""
    held, numbers, n = [], [], 0
    for i, t in enumerate(texts):
        w = t.split() if ids[i] is not None else []
        held.append(w)
        numbers.append(i)
        n += len(w)
        if n >= words:
            yield numbers, held
            held, numbers, n = [], [], 0
    if held:
        yield numbers, held


def _covered(n: int, runs) -> np.ndarray:
    """True for the places of ``n`` that a run (first, length) covers."""
    change = np.zeros(n + 1, np.int64)
    for first, k in runs:
        change[first] += 1
        change[first + k] -= 1
    return np.cumsum(change[:-1]) > 0


_SCANNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("anchor", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string())])
_SCANNED_DDL = "doc_id long, row long, anchor long, n_words long, sha256 string"
_SEGMENT = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("digest", pa.binary()), ("content", pa.binary()), ("row", pa.int64())])
_SEGMENT_DDL = "anchor long, doc_id long, first int, windows int, digest binary, content binary, row long"
_FOUND = pa.schema([("digest", pa.binary()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("gone", pa.list_(pa.bool_())), ("source", pa.int64())])
_FOUND_DDL = "digest binary, at array<int>, n array<int>, gone array<boolean>, source long"


def _pairs(runs) -> list | None:
    return None if runs is None else [(r["first"], r["n"]) for r in runs]


def _scan(gram: int, summaries: bool):
    """Rows (doc_id, row, anchor) for the segments and, with ``summaries``, (doc_id, row, n_words, sha256) for each row, from
    (doc_id, text, row). A fourth column tells the open runs of windows; without it all are open."""

    def run(batches):
        for b in batches:
            ids, texts, rows = (b.column(i).to_pylist() for i in range(3))
            told = b.column(3).to_pylist() if b.num_columns > 3 else None
            for numbers, docs in _groups(texts, ids):
                owner, _, _, anchor = segments(docs, gram, open_runs=told and [_pairs(told[i]) for i in numbers])
                of, row = np.array([ids[i] or 0 for i in numbers], np.int64), np.array([rows[i] for i in numbers], np.int64)
                none = [None] * len(anchor)
                yield batch(_SCANNED, of[owner], row[owner], anchor, none, none)
                if summaries:
                    words = [w if ids[i] is not None else texts[i].split() for i, w in zip(numbers, docs)]
                    none = [None] * len(words)
                    yield batch(_SCANNED, [ids[i] for i in numbers], row, none, [len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words])

    return run


def _candidates(gram: int):
    """Segments of the documents' anchors that others have; a content goes out once from each task."""

    def run(batches):
        sent: set[bytes] = set()
        for b in batches:
            ids, texts, wanted, rows = (b.column(i) for i in range(4))
            ids, texts, rows = ids.to_pylist(), texts.to_pylist(), rows.to_pylist()
            told = b.column(4).to_pylist() if b.num_columns > 4 else None
            for numbers, docs in _groups(texts, ids):
                owner, first, windows, anchor = segments(docs, gram, open_runs=told and [_pairs(told[i]) for i in numbers])
                out = []
                cuts = np.searchsorted(owner, np.arange(len(numbers) + 1))
                for j, i in enumerate(numbers):
                    lo, hi = cuts[j], cuts[j + 1]
                    if lo == hi or not wanted[i].is_valid:
                        continue
                    for k in (lo + np.flatnonzero(np.isin(anchor[lo:hi], np.asarray(wanted[i].values)))).tolist():
                        content = b" ".join(docs[j][first[k] : first[k] + windows[k] + WINDOW - 1])
                        digest = hashlib.blake2b(content, digest_size=16).digest()
                        if len(sent) > 2_000_000:
                            sent.clear()
                        new = digest not in sent
                        sent.add(digest)
                        out.append((int(anchor[k]), ids[i], int(first[k]), int(windows[k]), digest, content if new else None, rows[i]))
                if out:
                    yield batch(_SEGMENT, *zip(*out))

    return run


def search_block(indexed: list[tuple[int, list[bytes]]], streamed: list[tuple[int, list[bytes]]], window: int = WINDOW):
    """Windows of the streamed texts that indexed texts of the same anchor have, as (number of the text, at, n, gone):
    stretches of windows in order, found or not. Texts come as (anchor, words)."""
    number: dict[bytes, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number) + 1) for w in c), np.int64, len(c)) for _, c in indexed]
    index = FMIndex(texts)
    del texts
    queries = [np.fromiter((number.get(w, 0) for w in c), np.int64, len(c)) for _, c in streamed]
    n_windows = np.array([max(0, len(q) - window + 1) for q in queries], np.int64)
    base = np.concatenate(([0], np.cumsum(n_windows)))
    found = np.zeros(int(base[-1]), bool)
    place = np.zeros(int(base[-1]), np.int64)
    for who, at, matched, lo in index.matching_statistics(queries):
        hit = matched >= window
        slot = base[who[hit]] + at[hit]
        found[slot] = True
        place[slot] = lo[hit]
    edge = np.zeros(len(found) + 1, bool)
    edge[base] = True
    edge[1:-1] |= found[1:] != found[:-1]
    starts = np.flatnonzero(edge[:-1])
    size = np.diff(np.concatenate((starts, [len(found)])))
    owner = np.searchsorted(base, starts, "right") - 1
    # where the index has a stretch: the text there must be of the same anchor, as equal windows are
    gone = found[starts]
    told = np.array([a for a, _ in indexed], np.int64)[index.text_of(index.locate(place[starts[gone]]))] if gone.any() else np.zeros(0, np.int64)
    if np.any(told != np.array([a for a, _ in streamed], np.int64)[owner[gone]]):
        raise ValueError("equal windows with different anchors")
    return owner, starts - base[owner], size, gone


def _shard(block: int):
    """Over rows (anchor, chunk, digest, content, leads, streams, source) sorted by anchor and chunk, leaders first; a
    chunk stays together."""

    def run(batches):
        indexed, streamed, names, same, words, key = [], [], [], [], 0, None
        own: list[bytes] = []  # texts of the open chunk's leader; they are indexed if something is to be looked up in them

        def done():
            rows = [(digest, [0], [n], [True], source) for digest, n, source in same]
            if streamed:
                owner, at, n, gone = search_block(indexed, streamed)
                cuts = np.searchsorted(owner, np.arange(len(streamed) + 1)).tolist()
                rows += ((names[j][0], at[a:b], n[a:b], gone[a:b], names[j][1]) for j, (a, b) in enumerate(zip(cuts, cuts[1:])))
            return batch(_FOUND, *zip(*rows)) if rows else None

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                anchor, chunk, digest, content, leads, streams, source = row
                if key != (anchor, chunk):
                    key, own = (anchor, chunk), []
                    if words >= block:
                        if (out := done()) is not None:
                            yield out
                        indexed, streamed, names, same, words = [], [], [], [], 0
                if leads:  # they come first
                    own.append(content)
                    if streams:  # others hold the very text
                        same.append((digest, content.count(b" ") + 2 - WINDOW, source))
                else:
                    texts = [content.split(b" ")]
                    streamed.append((anchor, texts[0]))
                    names.append((digest, source))
                    if own:
                        texts += (leader := [x.split(b" ") for x in own])
                        indexed += ((anchor, x) for x in leader)
                        own = []
                    words += sum(map(len, texts))
        if (out := done()) is not None:
            yield out

    return run


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("row", F.xxhash64("text"))


def wanted_anchors(scanned: DataFrame) -> DataFrame:
    """(doc_id, row, wanted): each text's anchors that another document has too."""
    anchors = scanned.where("anchor is not null").select("doc_id", "row", "anchor")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    return cut(anchors.join(shared.select("anchor"), "anchor", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("wanted")))


def _routes(parts: DataFrame) -> DataFrame:
    """(digest, anchor, source, leads, streams, home, chunks, alone, windows) of each content; ``alone``: its anchor has no
    other. Rows of an anchor with several chunks meet
    its figures in ``PARTS`` parts; no text moves."""
    keys = parts.groupBy("digest").agg(F.first("anchor").alias("anchor"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("windows").alias("windows"))
    keys = cut(keys.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int")))
    # two steps: the parts of an anchor, then the anchor
    figures = keys.groupBy("anchor", "part").agg(F.min("first").alias("source"), F.count("*").alias("n"))
    figures = figures.groupBy("anchor").agg(F.min("source").alias("source"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"), (F.sum("n") == 1).alias("alone"), F.collect_list("part").alias("parts"))
    told = keys.join(figures.select("anchor", "source", "chunks", "alone", F.explode("parts").alias("part")), ["anchor", "part"])
    return told.select(
        "digest", "anchor", "source", "chunks", "alone", "windows",
        (F.col("first") == F.col("source")).alias("leads"),
        (F.col("last") > F.col("source")).alias("streams"),
        F.pmod(F.xxhash64("digest", F.lit(1)), "chunks").cast("int").alias("home"),
    )


def _sharded(parts: DataFrame, routes: DataFrame) -> DataFrame:
    """(anchor, chunk, digest, content, leads, streams, source): the rows of the shards, by anchor and chunk. A leader's
    text goes to all chunks of its anchor; its other holders are told in one of them."""
    text = parts.where("content is not null").groupBy("digest").agg(F.first("content").alias("content"))
    copies = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("home"))
    rows = text.join(routes, "digest").select("*", F.explode(copies).alias("chunk")).withColumn("streams", F.col("streams") & (F.col("home") == F.col("chunk")))
    rows = rows.select("anchor", "chunk", "digest", "content", "leads", "streams", "source")
    return rows.repartition(partitions(parts.sparkSession), "anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("leads"))


def one_level(held: DataFrame, gram: int) -> DataFrame:
    """(doc_id, row, first, n, gone): stretches of windows of documents that aren't leaders of their anchor, found in
    the leader or not. ``held``: doc_id, text, wanted, row and, if not all windows are open, runs."""
    rest = ["runs"] if "runs" in held.columns else []
    parts = stored(held.select("doc_id", "text", "wanted", "row", *rest).mapInArrow(_candidates(gram), _SEGMENT_DDL))
    # repeated rows of a document give the same segments, which changes nothing
    routes = cut(_routes(parts))
    found = _sharded(parts, routes.where("not alone")).mapInArrow(_shard(BLOCK), _FOUND_DDL)
    copied = routes.where("alone and streams").select("digest", F.array(F.lit(0)).alias("at"), F.array("windows").alias("n"), F.array(F.lit(True)).alias("gone"), "source")
    found = found.unionByName(copied)
    places = parts.select("digest", "doc_id", "row", F.col("first").alias("at0"))
    hits = places.join(found, "digest").where("doc_id > source").select("doc_id", "row", "at0", F.explode(F.arrays_zip("at", "n", "gone")).alias("r"))
    return stored(hits.select("doc_id", "row", (F.col("at0") + F.col("r.at")).alias("first"), F.col("r.n").alias("n"), F.col("r.gone").alias("gone")))


def _runs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("runs"))


def repeated_windows(held: DataFrame) -> DataFrame:
    """(doc_id, row, runs array<struct<first, n>>): runs of windows that go, for rows that lose some. ``held``: the
    documents that have anchors of the first level in common with others (doc_id, text as bytes, row, wanted), in buckets of
    doc_id and row, so that texts don't move again. ``row`` is a hash of the text: rows of one doc_id that differ in text
    each have their own runs."""
    gone = None
    for k, gram in enumerate(LEVELS):
        if k:  # what is still open, with the anchors that it shares on this level
            left = held.select("doc_id", "text", "row").join(cut(_runs(level.where("not gone"))), ["doc_id", "row"])
            now = left.join(wanted_anchors(cut(left.select("doc_id", "text", "row", "runs").mapInArrow(_scan(gram, False), _SCANNED_DDL))), ["doc_id", "row"])
        else:
            now = held
        level = one_level(now, gram)
        gone = level.where("gone") if gone is None else gone.unionByName(level.where("gone"))
        if level.where("not gone").isEmpty():
            break
    return _runs(gone)


def keep_mask(n_words: int, runs, window: int = WINDOW) -> np.ndarray:
    """False for words that a removed window covers."""
    change = np.zeros(n_words + 1, np.int64)
    for r in runs or ():
        change[r["first"]] += 1
        change[r["first"] + r["n"] + window - 1] -= 1
    return np.cumsum(change[:-1]) == 0


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = text.split()
                if runs:
                    keep = keep_mask(len(words), runs)
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    kept = words
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield batch(schema, *(zip(*rows) if rows else [[]] * 4))

    base = _base(docs)
    scanned = cut(base.select("doc_id", "text", "row").mapInArrow(_scan(LEVELS[0], True), _SCANNED_DDL))
    wanted = wanted_anchors(scanned)
    # of documents that share no anchor the scan has told all
    held = bucketed(base.join(wanted, ["doc_id", "row"]), "doc_id", "row")
    cut_texts = held.select("doc_id", "row", "text").join(repeated_windows(held), ["doc_id", "row"], "left").select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    whole = scanned.where("anchor is null").join(wanted.select("doc_id", "row"), ["doc_id", "row"], "left_anti")
    return whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256")).unionByName(cut_texts)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages: texts that lose words become their kept words joined by one
    space (``n_chars``, if there, follows); all others stay as they are."""
    base = _base(docs)
    wanted = wanted_anchors(cut(base.select("doc_id", "text", "row").mapInArrow(_scan(LEVELS[0], False), _SCANNED_DDL)))
    held = bucketed(base.join(wanted, ["doc_id", "row"]), "doc_id", "row")
    runs = repeated_windows(held).select(F.col("doc_id").alias("__hw_id"), F.col("row").alias("__hw_row"), F.col("runs").alias("__hw_runs"))
    joined = docs.join(runs, (F.col("doc_id").cast("long") == F.col("__hw_id")) & (F.xxhash64(text_bytes()) == F.col("__hw_row")), "left").drop("__hw_id", "__hw_row")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, runs in enumerate(b.column(len(names)).to_pylist()):
                if runs:
                    words = texts[i].encode().split()
                    texts[i] = b" ".join(w for w, k in zip(words, keep_mask(len(words), runs).tolist()) if k).decode()
            columns = [pa.array(texts, pa.string()) if j == at else b.column(j) for j in range(len(names))]
            if "n_chars" in names:
                j = names.index("n_chars")
                lost = [r is not None for r in b.column(len(names)).to_pylist()]
                columns[j] = pa.array([len(t) if x else o for t, x, o in zip(texts, lost, b.column(j).to_pylist())], b.column(j).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
