"""Operator 9, chat formatting by quotation linking, with DataFrame functions.

Each message is parsed into lines with their quote level (leading ">" marks, spaces between them allowed). Lines of
one level in a row, up to a blank line, are a passage; passages are normalised (case and white space) and hashed.
A quoted passage of level 1 links its message to the original: the first message of the conversation that has the
passage in its own words. Deeper levels are quotes within quotes; they count but don't link when level 1 does.
Conversations are then rebuilt in reply order: a message that quotes one other than its predecessor starts a
branch there; the messages that follow without a quote go on with the branch. Quotes and the attribution lines
right above them are dropped.

Nothing gathers by conversation: originals are minima by (conversation, hash), joins split large keys, and the
running branch is worked out in blocks of turns, then between blocks.

Cases: null text counts as empty; rows with a null conv_id or turn link with nothing and are roots; rows that tie
in conversation and turn are told apart by their text only, equal ones get equal results; quotes of messages that
aren't in the conversation are counted in ``n_unlinked``; messages of any length are parsed whole; other columns, whatever
their names, stay out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a block of the two-step running maximum.
BLOCK = 4096

_MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quote: "... wrote:" or "... schrieb:" and the like.
_ATTRIBUTION = r"(?is)^.*\b(?:wrote|writes|said|schrieb|a écrit|escribió):\s*$"


def _lines(text: Column) -> Column:
    """array<struct<level, line>> of a message."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.trim(F.regexp_replace(line, _MARKS, "")).alias("line"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), one)


def _passages(lines: Column) -> Column:
    """array<struct<level, line>>: lines of one level in a row, joined by spaces; blank lines part them. A passage is cut
    out between its first line and the next one's, so that time is in proportion to the lines."""

    def first(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return F.when((i == 0) | (x.line == "") | (before.line == "") | (before.level != x.level), i)

    def joined(starts: Column) -> Column:
        bounds = F.arrays_zip(starts.alias("lo"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(lines))).alias("hi"))
        return F.transform(bounds, lambda b: F.struct(F.get(lines, b.lo).level.alias("level"), F.array_join(F.transform(F.slice(lines, b.lo + 1, b.hi - b.lo), lambda x: x.line), " ").alias("line")))

    starts = F.filter(F.transform(lines, first), lambda i: i.isNotNull())
    whole = F.get(F.transform(F.array(starts), joined), 0)  # the starts are worked out once
    return F.filter(whole, lambda p: p.line != "")


def _normal(passage: Column) -> Column:
    return F.sha2(F.trim(F.lower(F.regexp_replace(passage, r"\s+", " "))), 256)


def _own_text(lines: Column) -> Column:
    """The lines of level 0 without attributions that stand right above a quote."""
    n = F.size(lines)
    kept = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.level.alias("level"), x.line.alias("line"), F.when(i + 1 < n, F.get(lines, i + 1).level).otherwise(0).alias("next"))),
        lambda x: (x.level == 0) & ~((x.next > 0) & x.line.rlike(_ATTRIBUTION)),
    )
    joined = F.array_join(F.transform(kept, lambda x: x.line), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"))


def quotation_threads(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, linked, branch_turn, quote_depth, n_quotes, n_unlinked, chat) of every
    row; ``branch_turn``, then ``turn`` is the reply order within a conversation."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"))
    quoted = F.col("raw").rlike(r"(?m)^[ \t]*>")
    parsed = rows.withColumn("lines", _lines(F.col("raw"))).withColumn("id", F.sha2("raw", 256))
    # the words of its own that a message adds: only passages that some message quotes can matter
    own = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.filter(_passages(F.col("lines")), lambda p: p.level == 0)).alias("p"))
    first = own.groupBy("conv_id", _normal(F.col("p.line")).alias("hash")).agg(F.min("turn").alias("original"))
    quotes = parsed.where(quoted).select("conv_id", "turn", "id", F.explode(F.filter(_passages(F.col("lines")), lambda p: p.level > 0)).alias("p")).select("conv_id", "turn", "id", F.col("p.level").alias("level"), _normal(F.col("p.line")).alias("hash")).distinct()
    found = quotes.join(first, ["conv_id", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    links = found.groupBy("conv_id", "turn", "id").agg(
        F.count("*").alias("n_quotes"),
        F.count(F.when(F.col("original").isNull(), 1)).alias("n_unlinked"),
        F.max("level").cast("long").alias("quote_depth"),
        F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("original").alias("o")))).getField("o").alias("original"),
    )
    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = _previous(turns)
    told = links.groupBy("conv_id", "turn").agg(F.max("original").alias("answers"))
    starts = before.join(told, ["conv_id", "turn"], "left").select("conv_id", "turn", "previous", F.when(F.col("previous").isNull() | (F.col("answers") != F.col("previous")), F.col("turn")).alias("start"))
    branch = _running_max(starts)
    k = links.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("id").alias("_i"), "n_quotes", "n_unlinked", "quote_depth", "original")
    b = branch.select(F.col("conv_id").alias("_bc"), F.col("turn").alias("_bt"), "previous", "branch_turn")
    out = parsed.join(b, (F.col("conv_id") == F.col("_bc")) & (F.col("turn") == F.col("_bt")), "left").join(k, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")) & (F.col("id") == F.col("_i")), "left")
    text = F.when(quoted, _own_text(F.col("lines"))).otherwise(F.col("raw"))
    return out.select("conv_id", "turn", "role", text.alias("text"), F.coalesce("original", "previous").alias("parent_turn"), F.col("original").isNotNull().alias("linked"), "branch_turn",
        F.coalesce("quote_depth", F.lit(0)).cast("long").alias("quote_depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_unlinked", F.lit(0)).cast("long").alias("n_unlinked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("chat"))


def _previous(turns: DataFrame) -> DataFrame:
    """The turn before, within the conversation: inside blocks first, then from block to block."""
    block = F.floor(F.col("turn") / BLOCK)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    rows = turns.withColumn("block", block).withColumn("previous", F.lag("turn").over(inside))
    tops = turns.groupBy("conv_id", block.alias("block")).agg(F.max("turn").alias("top"))
    across = Window.partitionBy("conv_id").orderBy("block")
    tops = tops.select("conv_id", "block", F.lag("top").over(across).alias("carried"))
    return rows.join(tops, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("previous", "carried").alias("previous"))


def _running_max(starts: DataFrame) -> DataFrame:
    """``branch_turn``: the latest start up to the turn, in the same two steps."""
    block = F.floor(F.col("turn") / BLOCK)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.withColumn("block", block).withColumn("seen", F.max("start").over(inside))
    tops = starts.groupBy("conv_id", block.alias("block")).agg(F.max("start").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("conv_id", "block", F.max("top").over(earlier).alias("carried"))
    return rows.join(tops, ["conv_id", "block"]).select("conv_id", "turn", "previous", F.coalesce("seen", "carried").alias("branch_turn"))
