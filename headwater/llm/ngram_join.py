"""Operator 4, n-gram Jaccard join in a metric space.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric. Two documents link at d <= 0.2 (similarity 0.8).

Sieve. Equal sets count as one from here on. In any one order of all shingles, two linked sets share at least l
shingles among the first n - ceil(0.8 n) + l of each. With l a tenth of the set, a set of which fewer shingles of that
prefix occur in any other set's prefix links with nothing; that leaves the sets with near copies and little else.

Regions. A region isn't all documents that are nearest to a random pivot: nearly all are almost as far from any
pivot as from the nearest, so that the windows of the triangle inequality replicate a document to most regions (the README
has figures). But of two linked sets the first fifth of the shingles of each share a shingle (l = 1). So the documents
that have a shingle in that prefix elect a pivot, the least of them, and the pivot's region is all documents that elected
it: any two that link meet in a region. The order puts frequent shingles last, so prefixes touch few regions.

1. Prefixes elect pivots; the distance of every member to its pivot is worked out from the full sets. Members
   within 0.2 link with the pivot and so are one class: pairs inside that ball need no look.
2. What is left are members outside the ball, and by the triangle inequality only members whose distance to the
   pivot differs by at most 0.2 can link with them. Those boundary members are replicated with them.
3. Each such region joins recursively: small ones in a task, where an unresolved member becomes the next
   pivot, the window of distances picks whom it is compared with, and it is resolved. Larger ones are cut into rings
   of equal distance to the pivot, rings into chunks; each chunk's unresolved members are the pivots of a cell that
   every chunk within the window is replicated to, and cells join like small regions. Still larger ones elect new
   pivots among their unresolved members by the shingles of their prefixes and go back to step 1; every round
   resolves a pivot of each of them, so the recursion ends. No pair within a window is left out.

Frequencies are counted over the prefixes of all documents; the order steers the cost only. Hot regions are
measured in salted chunks, with the pivot's set copied to each. Shingles are compared by 64-bit hashes, sets by
128-bit digests.

Cases: null and empty texts have no shingle and link with nothing; texts with fewer than five words are one
shingle; rows with a null doc_id get component null and link with nothing; repeated rows share a component;
other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batch, cut, partitions, stored, text_bytes
from ._hashes import WordHashes, mix, roll
from .components import components

WORDS = 5
#: Similarity as a fraction: links need DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Shingles at the end of the order at most: the most frequent ones (a broadcast of half a megabyte).
FREQUENT = 65_536
#: A shingle counts as frequent from so many different sets.
OFTEN = 8
#: Members in a chunk of a hot region. Comparisons (unresolved members times members) and shingles of a region that one
#: task joins at most; comparisons of a region that is cut into cells at most, beyond which it elects new pivots.
CHUNK, TASK_PAIRS, TASK_SHINGLES, CELL_PAIRS = 512, 1_000_000, 4_000_000, 400_000_000
#: Shingles, about, in each of the two chunks of a cell, so that chunks of long documents hold fewer of them.
CHUNK_SHINGLES = 2_000_000
#: Width of a ring; two members within the window lie at most REACH_RINGS rings apart.
RING, REACH_RINGS = 0.05, 5


def shingle_set(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles, from the hashes of the words."""
    n = len(h)
    if n == 0:
        return h
    if n < words:
        return mix(roll(h, n) + np.uint64(n))
    return np.unique(mix(roll(h, words)))


def least_shared(n: int) -> int:
    """Shingles that a set of size n shares at least with a set it links with."""
    return -(-NUM * n // DEN)


def prefix_size(n: int, shared: int = 1) -> int:
    """Of two sets that link, the first so many shingles of each have ``shared`` in common."""
    return min(n, n - least_shared(n) + shared)


def tenth(n: int) -> int:
    return -(-n // 10)


def prefix(s: np.ndarray, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The set's first shingles: those not frequent by hash, then the frequent ones by count and hash."""
    k = prefix_size(len(s))
    if not len(frequent):
        return s[:k]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often]
    if len(rare) >= k:
        return rare[:k]
    last, w = s[often], weight[at[often]]
    return np.concatenate((rare, last[np.argsort(w, kind="stable")][: k - len(rare)]))


def links(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * inter >= NUM * (a + b - inter)


def _sets(texts):
    """The shingle set of each text (bytes)."""
    hashes = WordHashes()
    for t in texts:
        yield shingle_set(hashes.of(t.lower().split()))


def _digested(batches):
    """(doc_id, set, digest as two integers) of the rows of a stream, a text at a time."""
    for b in batches:
        for doc_id, s in zip(b.column(0).to_pylist(), _sets(t.as_py() for t in b.column(1))):
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            yield doc_id, s, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


_PROFILE = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "hi", "lo")])
_PROFILE_DDL = "doc_id long, n long, hi long, lo long"


def _profiles(batches):
    docs = []
    for doc_id, s, hi, lo in _digested(batches):
        docs.append((doc_id, len(s), hi, lo))
        if len(docs) >= 10_000:
            yield batch(_PROFILE, *zip(*docs))
            docs = []
    if docs:
        yield batch(_PROFILE, *zip(*docs))


_SEEN = pa.schema([(c, pa.int64()) for c in ("shingle", "hi", "lo")])
_SEEN_DDL = "shingle long, hi long, lo long"


def _long_prefixes(batches):
    """(shingle, hi, lo) of the sets' prefixes in hash order, once for each different set of the task."""
    sent, rows, n = set(), [], 0
    for doc_id, s, hi, lo in _digested(batches):
        if doc_id is None or not len(s) or (hi, lo) in sent:
            continue
        if len(sent) > 1_000_000:
            sent.clear()
        sent.add((hi, lo))
        p = s[: prefix_size(len(s), tenth(len(s)))].view(np.int64)
        rows.append((p, np.full(len(p), hi), np.full(len(p), lo)))
        n += len(p)
        if n >= 100_000:
            yield batch(_SEEN, *(np.concatenate(c) for c in zip(*rows)))
            rows, n = [], 0
    if rows:
        yield batch(_SEEN, *(np.concatenate(c) for c in zip(*rows)))


_SHARED = pa.schema([(c, pa.int64()) for c in ("hi", "lo", "shingle", "sets")])
_SHARED_DDL = "hi long, lo long, shingle long, sets long"


def _shared(batches):
    """From rows (shingle, hi, lo) sorted by all: a row (hi, lo) for each shingle of a set that another set has
    too, and a row (shingle, sets) for frequent shingles. Holds a batch and one row."""
    last = pending = None  # the last row; the first of its shingle while it stands alone
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        t, hi, lo = (b.column(i).to_numpy() for i in range(3))
        before = (t[0], hi[0] - 1, lo[0]) if last is None else last
        pt, ph, pl = (np.concatenate(([x], a[:-1])) for x, a in zip(before, (t, hi, lo)))
        first = t != pt
        if last is None:
            first[0] = True
        keep = first | (hi != ph) | (lo != pl)
        last = (t[-1], hi[-1], lo[-1])
        t, hi, lo, first = t[keep], hi[keep], lo[keep], first[keep]
        if not len(t):
            continue
        out_hi, out_lo = [], []
        if not first[0] and pending is not None:
            out_hi.append([pending[0]])
            out_lo.append([pending[1]])
        alone = first & np.concatenate((first[1:], [True]))
        pending = (hi[-1], lo[-1]) if alone[-1] else None
        out_hi.append(hi[~alone])
        out_lo.append(lo[~alone])
        starts = np.flatnonzero(first)
        head = starts[0] if len(starts) else len(t)
        count += int(head)
        often_t, often_n = [], []
        if len(starts):
            if count >= OFTEN:
                often_t.append(token)
                often_n.append(count)
            size = np.diff(np.concatenate((starts, [len(t)])))
            many = np.flatnonzero(size[:-1] >= OFTEN)
            often_t += t[starts[many]].tolist()
            often_n += size[many].tolist()
            count, token = int(size[-1]), int(t[-1])
        a, b_ = np.concatenate(out_hi), np.concatenate(out_lo)
        k, m = len(a), len(often_t)
        if k or m:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((a, np.zeros(m, np.int64))), pa.int64(), mask=np.arange(k + m) >= k), pa.array(np.concatenate((b_, np.zeros(m, np.int64))), pa.int64(), mask=np.arange(k + m) >= k),
                 pa.array([None] * k + often_t, pa.int64()), pa.array([None] * k + often_n, pa.int64())], schema=_SHARED)
    if count >= OFTEN:
        yield batch(_SHARED, [None], [None], [token], [count])


_TOKEN = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64())])


def _prefixes(order):
    """(shingle, doc_id) of the prefixes of stored sets (doc_id, shingles)."""

    def run(batches):
        frequent, weight = order.value
        for b in batches:
            ids = b.column(0).to_numpy()
            tokens = [prefix(np.frombuffer(r, np.uint64), frequent, weight) for r in b.column(1).to_pylist()]
            for k in range(0, len(ids), 1000):
                part = tokens[k : k + 1000]
                yield batch(_TOKEN, np.concatenate(part).view(np.int64), np.repeat(ids[k : k + 1000], [len(p) for p in part]))

    return run


_PAIR = pa.schema([("pivot", pa.int64()), ("doc_id", pa.int64())])


def _elect(batches):
    """Rows (shingle, doc_id) sorted by both: the first of a shingle is its pivot. Holds a batch."""
    token = pivot = None
    for b in batches:
        if not b.num_rows:
            continue
        t, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate(([token is None or t[0] != token], t[1:] != t[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
        p = np.where(at >= 0, d[np.maximum(at, 0)], 0 if pivot is None else pivot)
        token, pivot = t[-1], p[-1]
        other = p != d
        if other.any():
            pairs = np.unique(np.stack((p[other], d[other]), 1), axis=0)
            yield batch(_PAIR, pairs[:, 0], pairs[:, 1])


def _elect_again(batches):
    """Rows (region, shingle, fresh desc, doc_id) sorted: the first unresolved member is the new pivot."""
    key = pivot = None
    for b in batches:
        out = set()
        for region, shingle, resolved, d in zip(*(b.column(i).to_pylist() for i in range(4))):
            if key != (region, shingle):
                key, pivot = (region, shingle), None if resolved else d
            if pivot is not None and pivot != d:
                out.add((pivot, d))
        if out:
            yield batch(_PAIR, *zip(*sorted(out)))


_FETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])


def _fetch(batches):
    """Sets as bytes; some megabytes of them are held at a time, however many rows a batch has."""
    rows, held = [], 0
    for b in batches:
        for i, s in zip(b.column(0).to_pylist(), _sets(t.as_py() for t in b.column(1))):
            rows.append((i, len(s), s.tobytes()))
            held += s.nbytes
            if held >= 1 << 22 or len(rows) >= 500:
                yield batch(_FETCH, *zip(*rows))
                rows, held = [], 0
    if rows:
        yield batch(_FETCH, *zip(*rows))


_MEASURED = pa.schema([(c, pa.int64()) for c in ("pivot", "doc_id", "np", "n", "common")])


def _measure(batches):
    """Rows (pivot, salt, doc_id, shingles) sorted, the pivot's own first. Holds the pivot's set."""
    key, own = None, None
    for b in batches:
        out = []
        for pivot, salt, doc_id, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
            s = np.frombuffer(raw, np.uint64)
            if key != (pivot, salt):
                key, own = (pivot, salt), s
                if pivot != doc_id:
                    raise ValueError("a pivot's set is missing")
                continue
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            out.append((pivot, doc_id, len(own), len(s), int((own[at] == s).sum())))
        if out:
            yield batch(_MEASURED, *zip(*out))


def join_region(ids: list[int], sets: list[np.ndarray], dist: np.ndarray, resolved: np.ndarray, side: np.ndarray | None = None):
    """Links inside one region, exactly: pairs of different classes with at least one unresolved member.
    ``dist``: to the region's pivot. A member becomes the next pivot, is compared with the members in its
    window, and is resolved. The resolved members are one class already. With ``side``,
    only members of different sides are compared."""
    n = len(ids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ball = np.flatnonzero(resolved)
    for i in ball[1:].tolist():  # all linked with the region's pivot
        root[i] = int(ball[0])
    size = np.array([len(s) for s in sets], np.int64)
    done = np.zeros(n, bool)
    reach = (DEN - NUM) / DEN + 1e-9
    for q in np.flatnonzero(~resolved).tolist():
        near = ~done & (np.abs(dist - dist[q]) <= reach) & (DEN * np.minimum(size, size[q]) >= NUM * np.maximum(size, size[q]))
        if side is not None:
            near &= side != side[q]
        near[q] = False
        done[q] = True
        for i in np.flatnonzero(near).tolist():
            if find(i) == find(q):
                continue
            at = np.minimum(np.searchsorted(sets[q], sets[i]), size[q] - 1)
            if links(int((sets[q][at] == sets[i]).sum()), size[q], size[i]):
                root[find(i)] = find(q)
                yield ids[q], ids[i]


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _join_regions(keys: int):
    """Rows (``keys`` key columns, doc_id, dist, resolved, shingles, side) sorted by key; a key's rows are a region, or a
    cell whose sides are 0 and 1."""

    def run(batches):
        key, held = None, []

        def done():
            if len(held) < 2:
                return None
            ids, dist, resolved, raw, side = zip(*held)
            sides = None if side[0] is None else np.array(side)
            found = list(join_region(list(ids), [np.frombuffer(r, np.uint64) for r in raw], np.array(dist), np.array(resolved), sides))
            return batch(_LINK, *zip(*found)) if found else None

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(keys + 5))):
                if row[:keys] != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = row[:keys], []
                held.append(row[keys:])
        if (out := done()) is not None:
            yield out

    return run


def _cells(large: DataFrame) -> DataFrame:
    """(pivot, of, with, doc_id, dist, resolved, side): the members of each cell of large regions. In a cell, the unresolved
    members of chunk ``of`` are compared with all of chunk ``with``; a pair of chunks makes one cell if both hold
    unresolved members."""
    ring = F.floor(F.col("dist") / RING).cast("int")
    rows = large.withColumn("ring", ring)
    salts = rows.groupBy("pivot", "ring").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("salts"))
    rows = rows.join(salts, ["pivot", "ring"]).withColumn("chunk", F.col("ring") * 1_000_000 + F.pmod(F.xxhash64("doc_id"), "salts").cast("int"))
    chunks = rows.groupBy("pivot", "chunk").agg(F.max(~F.col("resolved")).alias("open"), F.max("ring").alias("ring"))
    a = chunks.where("open").select("pivot", F.col("chunk").alias("of"), F.col("ring").alias("r1"))
    b = chunks.select("pivot", F.col("chunk").alias("with"), F.col("ring").alias("r2"), "open")
    cells = a.join(b, "pivot").where((F.abs(F.col("r1") - F.col("r2")) <= REACH_RINGS) & (~F.col("open") | (F.col("of") <= F.col("with")))).select("pivot", "of", "with")
    own = rows.select("pivot", "chunk", "doc_id", "dist", "resolved")
    first = cells.join(own.withColumnRenamed("chunk", "of"), ["pivot", "of"]).withColumn("side", F.when(F.col("of") != F.col("with"), 0))
    second = cells.where(F.col("of") != F.col("with")).join(own.withColumnRenamed("chunk", "with"), ["pivot", "with"]).withColumn("side", F.lit(1))
    return first.unionByName(second)


def _member_prefixes(order):
    schema = pa.schema([("region", pa.int64()), ("shingle", pa.int64()), ("resolved", pa.bool_()), ("doc_id", pa.int64())])

    def run(batches):
        frequent, weight = order.value
        for b in batches:
            for region, doc_id, resolved, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                p = prefix(np.frombuffer(raw, np.uint64), frequent, weight).view(np.int64)
                yield batch(schema, [region] * len(p), p, [resolved] * len(p), [doc_id] * len(p))

    return run


def possible(base: DataFrame, profile: DataFrame):
    """The sieve: (doc_id) of one document for each set that may link with another, and the order of shingles."""
    spark = base.sparkSession
    seen = base.mapInArrow(_long_prefixes, _SEEN_DDL).repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "hi", "lo")
    both = cut(seen.mapInArrow(_shared, _SHARED_DDL).groupBy("hi", "lo", "shingle").agg(F.count("*").alias("shared"), F.max("sets").alias("sets")))
    top = both.where("shingle is not null").orderBy(F.desc("sets"), "shingle").limit(FREQUENT).select("shingle", "sets").collect()
    value = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    at = np.argsort(value)
    order = spark.sparkContext.broadcast((value[at], np.array([r["sets"] for r in top], np.int64)[at]))
    one = profile.where("doc_id is not null and n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    # a linked set has at least ceil(0.8 n) shingles, and the prefixes share a tenth of the smaller set
    least = F.ceil(F.ceil(F.col("n") * NUM / DEN) / 10)
    return one.join(both.where("shingle is null"), ["hi", "lo"]).where(F.col("shared") >= least).select("doc_id"), order


def similar_links(base: DataFrame, profile: DataFrame) -> DataFrame:
    """Links (u, v) between documents of different sets, each told by its least doc_id; enough of them to tie all
    classes together."""
    n = partitions(base.sparkSession)
    nodes, order = possible(base, profile)
    # repeated rows give their set twice; later steps then measure a pair twice, which changes nothing
    sets = stored(base.join(nodes, "doc_id", "left_semi").mapInArrow(_fetch, "doc_id long, n long, shingles binary"))
    tokens = sets.select("doc_id", "shingles").mapInArrow(_prefixes(order), "shingle long, doc_id long").repartition(n, "shingle").sortWithinPartitions("shingle", "doc_id")
    pairs = cut(tokens.mapInArrow(_elect, "pivot long, doc_id long").distinct())
    out = None
    while True:
        sizes = pairs.groupBy("pivot").agg(F.count("*").alias("members")).withColumn("chunks", F.ceil(F.col("members") / CHUNK))
        salted = pairs.join(sizes, "pivot").select("pivot", "doc_id", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("salt"))
        centres = sizes.select("pivot", F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("salt"))
        rows = salted.unionByName(centres.select("pivot", "doc_id", "salt")).join(sets.select("doc_id", "shingles"), "doc_id")
        grouped = rows.repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", (F.col("pivot") != F.col("doc_id")).cast("int"), "doc_id")
        measured = cut(grouped.select("pivot", "salt", "doc_id", "shingles").mapInArrow(_measure, "pivot long, doc_id long, np long, n long, common long"))
        union = F.col("np") + F.col("n") - F.col("common")
        table = measured.select("pivot", "doc_id", F.col("n").alias("size"), (1 - F.col("common") / union).alias("dist"), (F.lit(DEN) * F.col("common") >= F.lit(NUM) * union).alias("resolved"))
        linked = table.where("resolved").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v"))
        out = linked if out is None else out.unionByName(linked)
        # members outside the ball, and those within their windows
        far = table.where("not resolved").groupBy("pivot").agg(F.min("dist").alias("nearest"))
        reach = (DEN - NUM) / DEN + 1e-9
        open_ = table.join(far, "pivot").where(f"not resolved or dist >= nearest - {reach}")
        open_size = open_.groupBy("pivot").agg(F.count("*").alias("members"), (F.count("*") * F.count_if(~F.col("resolved"))).alias("pairs"), F.sum("size").alias("shingles")).where("members > 1")
        open_ = cut(open_.join(open_size, "pivot").select("pivot", "doc_id", "size", "dist", "resolved", "pairs", "shingles"))
        fits = (F.col("pairs") <= TASK_PAIRS) & (F.col("shingles") <= TASK_SHINGLES)
        small = open_.where(fits).select("pivot", "doc_id", "dist", "resolved").join(sets.select("doc_id", "shingles"), "doc_id")
        local = small.repartition(n, "pivot").sortWithinPartitions("pivot", "dist", "doc_id").select("pivot", "doc_id", "dist", "resolved", "shingles", F.lit(None).cast("int").alias("side"))
        out = out.unionByName(local.mapInArrow(_join_regions(1), "u long, v long"))
        middle, large = open_.where(~fits & (F.col("pairs") <= CELL_PAIRS)), open_.where(F.col("pairs") > CELL_PAIRS)
        if not middle.isEmpty():
            cells = _cells(middle).join(sets.select("doc_id", "shingles"), "doc_id")
            cells = cells.repartition(n, "pivot", "of", "with").sortWithinPartitions("pivot", "of", "with", "dist", "doc_id")
            out = out.unionByName(cells.select("pivot", "of", "with", "doc_id", "dist", "resolved", "shingles", "side").mapInArrow(_join_regions(3), "u long, v long"))
        out = cut(out)
        if large.isEmpty():
            return out
        again = large.select("pivot", "doc_id", "resolved").join(sets.select("doc_id", "shingles"), "doc_id").select(F.col("pivot").alias("region"), "doc_id", "resolved", "shingles")
        marked = again.mapInArrow(_member_prefixes(order), "region long, shingle long, resolved boolean, doc_id long")
        marked = marked.repartition(n, "region", "shingle").sortWithinPartitions("region", "shingle", "resolved", "doc_id")
        pairs = cut(marked.mapInArrow(_elect_again, "pivot long, doc_id long").distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    profile = cut(base.mapInArrow(_profiles, _PROFILE_DDL))
    found = similar_links(base, profile)
    rep = profile.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    named = profile.join(rep, ["hi", "lo"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    comp = components(found)
    return named.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component (its smallest doc_id, one row of it), with all
    their columns; rows with a null doc_id stay."""
    keep = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__hw_id")).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text_bytes())))
    kept = docs.join(keep, F.col("doc_id").cast("long") == F.col("__hw_id"), "left_semi").withColumn("__hw_n", first).where("__hw_n = 1").drop("__hw_n")
    return kept.unionByName(docs.where("doc_id is null"))
