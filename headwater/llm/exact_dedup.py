"""Operator 10, exact dedup: tree-merge of sorted digest runs.

Every input partition becomes a run: its digests in order, each with the smallest identifier and the number of rows.
Partitions then exchange runs in binomial rounds: in round k, the two partitions (``FAN``) whose numbers differ in bit k
alone send each other the entries whose digest has the receiver's bit there. A receiver gets sorted runs, finds where
each begins and merges them, two by two, into one sorted run; nothing is sorted again. Each round halves the digests
that a partition answers for, and after the last every digest has one entry. Groups of any size collapse to one entry a
run before anything moves, so no copy group gathers in a task.

At every level an entry is known by its digest together with a second, independent fingerprint and the length of its
text: entries merge only where all three agree, and texts that share a digest but not these stay apart.

A task holds the entries of its run, of some hundred bytes each: the different texts divided by the number of
partitions, whatever the groups. Partitions are the greatest power of two up to ``spark.sql.shuffle.partitions``.

Cases: null text counts as empty; texts are compared after each ``[\\x20\\x09-\\x0D]+`` is replaced by one
space (not trimmed); a null doc_id ranks after all others; of rows that tie in text and doc_id, the first
stays; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, partitions

#: Partitions that exchange in a round.
FAN = 2

_RUN = pa.schema(
    [
        ("digest", pa.binary()),
        ("check", pa.int64()),
        ("size", pa.int64()),
        ("keep_id", pa.int64()),
        ("keep_row", pa.int64()),
        ("group_size", pa.int64()),
    ]
)
_RUN_DDL = "digest binary, check long, size long, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest, check, size) of every row. ``row`` only tells repeated rows apart."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t-\r]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_norm")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("_norm", 256)).alias("digest"),
        F.xxhash64("_norm").alias("check"),
        F.octet_length("_norm").cast("long").alias("size"),
    )


@dataclass
class Entries:
    """A run in arrays. ``key``: digest, fingerprint and length as 48 bytes that compare like the three in turn."""

    key: np.ndarray
    null: np.ndarray  # the identifier is null; such rank last
    keep_id: np.ndarray
    keep_row: np.ndarray
    group_size: np.ndarray

    @classmethod
    def of(cls, got: pa.RecordBatch) -> Entries:
        n = got.num_rows
        key = np.empty((n, 48), np.uint8)
        key[:, :32] = np.frombuffer(b"".join(got.column(0).to_pylist()), np.uint8).reshape(n, 32)
        for k, at in ((1, 32), (2, 40)):
            number = np.asarray(got.column(k)).astype(np.int64)
            key[:, at : at + 8] = (number.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
        ids = got.column(3)
        return cls(key.view("S48").reshape(n), np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), np.asarray(got.column(4)), np.asarray(got.column(5)))

    def __len__(self) -> int:
        return len(self.key)

    def each(self, f: Callable[[np.ndarray], np.ndarray]) -> Entries:
        return Entries(*(f(getattr(self, x.name)) for x in fields(self)))

    def batches(self, rows: int = 20_000):
        for at in range(0, len(self), rows):
            e = self.each(lambda x: x[at : at + rows])  # noqa: B023
            raw = np.ascontiguousarray(e.key).view(np.uint8).reshape(len(e), 48)
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(raw[:, :32].tobytes())]).cast(pa.binary())
            check, size = ((np.ascontiguousarray(raw[:, k : k + 8]).view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for k in (32, 40))
            yield pa.RecordBatch.from_arrays([digest, pa.array(check), pa.array(size), pa.array(e.keep_id, mask=e.null), pa.array(e.keep_row), pa.array(e.group_size)], schema=_RUN)


def together(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate([getattr(p, x.name) for p in parts]) for x in fields(Entries)))


def merge_two(a: Entries, b: Entries) -> Entries:
    """One run from two; each is in the order of its keys, which occur once in it."""
    at = np.searchsorted(a.key, b.key)
    both = a.key[np.minimum(at, len(a) - 1)] == b.key if len(a) else np.zeros(len(b), bool)
    i, j = at[both], np.flatnonzero(both)
    a.group_size[i] += b.group_size[j]
    less = (b.null[j] < a.null[i]) | (b.null[j] == a.null[i]) & ((b.keep_id[j] < a.keep_id[i]) | (b.keep_id[j] == a.keep_id[i]) & (b.keep_row[j] < a.keep_row[i]))
    for name in ("null", "keep_id", "keep_row"):
        getattr(a, name)[i[less]] = getattr(b, name)[j[less]]
    return Entries(*(np.insert(getattr(a, x.name), at[~both], getattr(b, x.name)[~both]) for x in fields(Entries)))


def merge_runs(runs: list[Entries]) -> Entries:
    """All runs by rounds of pairs, so that an entry is moved once a round."""
    while len(runs) > 1:
        runs = [merge_two(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def _collapse(batches):
    """A sorted stream of entries to a run: the first of equal keys is the smallest. Holds a batch and one entry."""
    held = None
    for got in batches:
        if not got.num_rows:
            continue
        e = Entries.of(got)
        e = e if held is None else together([held, e])
        starts = np.flatnonzero(np.concatenate(([True], e.key[1:] != e.key[:-1])))
        total = np.add.reduceat(e.group_size, starts)
        e = e.each(lambda x: x[starts])  # noqa: B023
        e.group_size = total
        held = e.each(lambda x: x[-1:])
        yield from e.each(lambda x: x[:-1]).batches()
    if held is not None:
        yield from held.batches()


def _merge(batches):
    """The runs that a partition gets, one after the other, to one run."""
    got = [Entries.of(b) for b in batches if b.num_rows]
    if got:
        e = together(got)
        del got
        cuts = [0, *(np.flatnonzero(e.key[1:] <= e.key[:-1]) + 1).tolist(), len(e)]
        yield from merge_runs([e.each(lambda x: x[i:j].copy()) for i, j in zip(cuts, cuts[1:])]).batches()  # noqa: B023


def tree_merge(entries: DataFrame, fan: int = FAN, width: int | None = None) -> DataFrame:
    """One entry a key from ``entries`` (columns of a run). ``width``: wished number of partitions;
    the largest power of ``fan`` up to it is used, ``fan`` at least."""
    width = width or partitions(entries.sparkSession)
    rounds = 1
    while fan ** (rounds + 1) <= width:
        rounds += 1
    n = fan**rounds
    prefix = F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("long")
    order = ("digest", "check", "size", F.col("keep_id").asc_nulls_last(), "keep_row")
    runs = entries.sortWithinPartitions(*order).mapInArrow(_collapse, _RUN_DDL).withColumn("slot", F.pmod(F.spark_partition_id().cast("long"), F.lit(n)))
    for k in range(rounds):
        place = fan**k
        digit = lambda c: F.pmod(F.floor(c / F.lit(place)).cast("long"), F.lit(fan))  # noqa: B023, E731
        runs = runs.withColumn("slot", F.col("slot") + (digit(F.pmod(prefix, F.lit(n))) - digit(F.col("slot"))) * F.lit(place))
        moved = runs.repartitionById(n, F.col("slot").cast("int")).drop("slot")
        runs = moved.mapInArrow(_merge, _RUN_DDL).withColumn("slot", F.spark_partition_id().cast("long"))
    return runs.drop("slot")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``."""
    table = cut(digests(docs))
    entries = table.select("digest", "check", "size", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    kept = tree_merge(entries).select("digest", "check", "size", "keep_id", "keep_row", "group_size")
    return table.join(kept, ["digest", "check", "size"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts move by (doc_id, digest), so a
    large copy group is spread over the tasks."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__hw_id"), F.unhex("text_sha256").alias("__hw_digest"))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t-\r]+", " ")
    own = docs.withColumn("__hw_own", F.unhex(F.sha2(text, 256)))
    hit = own.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__hw_id")) & (F.col("__hw_own") == F.col("__hw_digest")), "left_semi")
    first = Window.partitionBy("doc_id", "__hw_own").orderBy(F.lit(1))
    return hit.withColumn("__hw_n", F.row_number().over(first)).where("__hw_n = 1").drop("__hw_n", "__hw_own")
