"""Operator 7, licence scans with a positional rare-token index, with DataFrame functions only.

Licence templates (``licences.TEMPLATES``) are word sequences with mandatory key phrases. Document frequencies of all their
words are counted over the whole corpus; the rarest words of each template are its index. Postings (word, template,
position) are a table. A file's words are looked up in it by a join, only those that the index has, which are its licence
words of highest IDF. Every hit votes for the place where the template would begin: its position less that of the
posting. Places for which several index words of a template vote are candidates; the file's words must then hold all key
phrases of the template at their places, word for word. The score is the best share of a template's words found at
their places.

A file is read once after the count. What goes on is a stored row for it, with its words only where it has enough index
words of some kind; the plan's size doesn't depend on the number of templates. Places found by plain phrases (``BASE``) are
counted too.

Cases: null text counts as empty; long texts are scanned whole; repeated rows are scanned one by one; a null
doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored
from .licences import TEMPLATES

#: Label and words of the plain phrases.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Words of a template in its index at most, and at most half of its different words; so many must agree on a place.
INDEX_WORDS, AGREE = 6, 2

_GAP = r"[\x00-/:-`{-\x7f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Template = tuple[str, Sequence[str], str]


def words_of(text: str = "text") -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, _GAP), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """The words of a template or key phrase, as those of a file."""
    return re.findall(r"[^\x00-/:-`{-\x7f]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _rows(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small table of given values."""
    structs = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, row))) for row in rows))
    return spark.range(1, numPartitions=1).select(F.inline(structs))


def frequencies(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of rows, and for each template word the number of rows that have it; over all rows."""
    vocabulary = sorted({w for _, _, t in templates for w in template_words(t)})
    present = F.array_intersect(words_of(), _strings(vocabulary))
    rows = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    got = {r["w"]: r["count"] for r in rows}  # at most the vocabulary
    return got.pop("", 0), {w: got.get(w, 0) for w in vocabulary}


def index_words(template: str, n: int, df: dict[str, int]) -> list[str]:
    """The template's rarest words by IDF, rarest first; ties by the alphabet."""
    own = set(template_words(template))
    idf = {w: math.log((1 + n) / (1 + df[w])) for w in own}
    return sorted(own, key=lambda w: (-idf[w], w))[: min(INDEX_WORDS, max(AGREE, -(-len(own) // 2)))]


def key_places(keys: Sequence[str], text: str) -> list[int]:
    """Where the key phrases first stand in their template."""
    words = template_words(text)
    return [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in map(template_words, keys)]


def _phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Positions (from 0) where the phrase's words stand consecutively."""
    first = F.transform(words, lambda w, i: F.when(w == phrase[0], i))
    here = F.filter(first, lambda i: i.isNotNull())
    return F.filter(here, lambda i: F.slice(words, i + 1, len(phrase)) == _strings(phrase))


def _has_all(words: Column, wanted) -> Column:
    out = F.lit(True)
    for w in dict.fromkeys(wanted):
        out = out & F.array_contains(words, w)
    return out


def postings(spark: SparkSession, templates: Sequence[Template], index: Sequence[Sequence[str]]) -> DataFrame:
    """(word, template, position) of the index words."""
    return _rows(spark, ("word", "template", "position"), [(w, k, p) for k, (_, _, text) in enumerate(templates) for p, w in enumerate(template_words(text)) if w in index[k]])


def candidates(files: DataFrame, posts: DataFrame) -> DataFrame:
    """(file, template, start): places that at least ``AGREE`` different index words of a template vote for. ``files``:
    file, hits array<struct<word, at>>."""
    hits = files.select("file", F.inline("hits"))
    votes = hits.join(posts, "word").select("file", "template", (F.col("at") - F.col("position")).alias("start"), "word")
    return votes.groupBy("file", "template", "start").agg(F.size(F.collect_set("word")).alias("votes")).where(F.col("votes") >= AGREE).drop("votes")


def verified(places: DataFrame, files: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(file, label, score) of the places at which all key phrases stand. ``files``: file, words."""
    spark = files.sparkSession
    rows = [(k, label, " ".join(template_words(text)), "|".join(" ".join(template_words(p)) for p in keys), ",".join(map(str, key_places(keys, text)))) for k, (label, keys, text) in enumerate(templates)]
    table = _rows(spark, ("template", "label", "text", "keys", "places"), rows)
    keys = F.arrays_zip(F.transform(F.split("keys", r"\|"), lambda p: F.split(p, " ")).alias("words"), F.split("places", ",").cast("array<int>").alias("at"))
    table = table.select("template", "label", F.split("text", " ").alias("wanted"), keys.alias("keys"))
    w, start = F.col("words"), F.col("start")
    stands = F.forall("keys", lambda k: F.when(start + k["at"] >= 0, F.slice(w, F.greatest(start + k["at"], F.lit(0)) + 1, F.size(k["words"])) == k["words"]).otherwise(False))
    here = F.filter(F.transform("wanted", lambda x, i: F.when(start + i >= 0, F.get(w, start + i) == x).otherwise(False)), lambda x: x)
    found = places.join(table, "template").join(files, "file").where(stands)
    return found.select("file", "label", (F.size(here) / F.size("wanted").cast("double")).alias("score"))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    n, df = frequencies(docs, templates)
    index = [index_words(text, n, df) for _, _, text in templates]
    vocabulary = sorted({w for ws in index for w in ws})
    w = F.col("words")
    none = F.array().cast("array<int>")
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(vocabulary), F.struct(x.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    starts = [F.when(_has_all(w, p.split()), _phrase_starts(w, p.split())).otherwise(none) for _, p in BASE]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of().alias("words"))
    rows = rows.select("doc_id", "words", hits.alias("hits"), *(s.alias(f"base{i}") for i, s in enumerate(starts)))
    close = F.size(F.array_distinct(F.transform("hits", lambda h: h["word"]))) >= AGREE
    # the number of a row holds once it is stored
    files = stored(
        rows.select(
            F.monotonically_increasing_id().alias("file"), "doc_id", F.size("words").cast("long").alias("n_words"), *(f"base{i}" for i in range(len(BASE))),
            F.when(close, F.col("hits")).alias("hits"), F.when(close, w).alias("words"),
        )
    )
    near = files.where("hits is not null")
    found = verified(candidates(near.select("file", "hits"), postings(docs.sparkSession, templates, index)), near.select("file", "words"), templates)
    best = found.groupBy("file").agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))  # as many as there are labels
    base = [F.col(f"base{i}") for i in range(len(BASE))]
    every = F.flatten(F.array(*base))
    named = F.array_compact(F.array(*(F.when(F.size(s) > 0, F.lit(label)) for s, (label, _) in zip(base, BASE))))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return files.select("file", "doc_id", "n_words", every.alias("every"), named.alias("base")).join(best, "file", "left").select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"), join(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
