"""Lineage of dbt models with array functions: a model's text is cut into pieces once, and every question is asked of the
pieces. Nothing is shuffled, and a model takes time in proportion to its text, but for the places of its commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Jinja expression, a Jinja statement, a word, white space, any other character.
PIECES = r"(?s)\{\{.*?\}\}|\{%.*?%\}|\w+|\s+|."
#: What a Jinja expression is made of: quoted texts, words, any other character that is no space.
PARTS = r"""'[^']*'|"[^"]*"|\w+|\S"""
_PLACEHOLDER = "placeholder"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once and not wherever ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(sql: Column) -> Column:
    return _all(F.coalesce(sql, F.lit("")), PIECES)


def _parts(expression: Column) -> Column:
    """The parts between the braces."""
    return _all(F.substring(expression, F.lit(3), F.length(expression) - 4), PARTS)


def _unquoted(part: Column) -> Column:
    return F.substring(part, F.lit(2), F.length(part) - 2)


def _is_text(part: Column) -> Column:
    """A quoted text that isn't empty."""
    return F.substring(part, 1, 1).isin("'", '"') & (F.length(part) > 2)


def _call(parts: Column, function: str, arguments: int) -> Column:
    """The arguments, all quoted texts, of a call that is the whole expression; null if it is another."""
    size = 2 * arguments + 2
    ok = (F.size(parts) == size) & (F.lower(F.get(parts, 0)) == function) & (F.get(parts, 1) == "(") & (F.get(parts, size - 1) == ")")
    values = []
    for k in range(arguments):
        part = F.get(parts, 2 + 2 * k)
        ok = ok & _is_text(part)
        if k:
            ok = ok & (F.get(parts, 1 + 2 * k) == ",")
        values.append(_unquoted(part))
    return F.when(ok, F.array(*values))


def calls(sql: Column, function: str, arguments: int) -> Column:
    """array<array<string>>: the arguments of all such calls in text order, repeats kept."""
    expressions = F.filter(pieces(sql), lambda p: F.startswith(p, F.lit("{{")))
    return F.filter(F.transform(expressions, lambda e: _let(_parts(e), lambda parts: _call(parts, function, arguments))), lambda c: c.isNotNull())


def refs(sql: Column) -> Column:
    """Referenced models in text order, repeats kept."""
    return F.transform(calls(sql, "ref", 1), lambda c: c[0])


def sources(sql: Column) -> Column:
    """array<struct<source_name, table_name>> in text order."""
    return F.transform(calls(sql, "source", 2), lambda c: F.struct(c[0].alias("source_name"), c[1].alias("table_name")))


def materialization(sql: Column) -> Column:
    """What the first config(...) says, else a view."""
    expressions = F.transform(F.filter(pieces(sql), lambda p: F.startswith(p, F.lit("{{"))), _parts)
    first = F.get(F.filter(expressions, lambda p: (F.lower(F.get(p, 0)) == "config") & (F.get(p, 1) == "(")), 0)

    def said(config: Column) -> Column:
        values = F.transform(config, lambda p, i: F.when((F.lower(p) == "materialized") & (F.get(config, i + 1) == "="), F.get(config, i + 2)))
        return F.get(F.filter(values, lambda v: v.isNotNull() & _is_text(v)), 0)

    return F.coalesce(_unquoted(_let(first, said)), F.lit("view"))


def plain_pieces(sql: Column) -> Column:
    """The pieces with references as table names, other expressions as a placeholder and without statements."""

    def table(parts: Column) -> Column:
        return F.coalesce(F.array_join(F.coalesce(_call(parts, "ref", 1), _call(parts, "source", 2)), "__"), F.lit(_PLACEHOLDER))

    def plain(p: Column) -> Column:
        name = _let(_parts(p), table)
        return F.when(F.startswith(p, F.lit("{{")) & F.endswith(p, F.lit("}}")), name).when(F.startswith(p, F.lit("{%")) & F.endswith(p, F.lit("%}")), F.lit("")).otherwise(p)

    return F.filter(F.transform(pieces(sql), plain), lambda p: p != "")


def select_list(text: Column) -> Column:
    """The pieces of the last list between a SELECT and the next FROM, null if there is none. ``open``: where such a list
    begins, ``lo`` and ``hi``: the ends of the last one that has come to its FROM."""
    number = lambda n: F.lit(n).cast("int")
    start = F.struct(number(0).alias("i"), number(-1).alias("open"), number(-1).alias("lo"), number(-1).alias("hi"))

    def step(a: Column, p: Column) -> Column:
        word = F.upper(p)
        ends = (word == "FROM") & (a.open >= 0)
        begins = (word == "SELECT") & (a.open < 0)
        return F.struct(
            (a.i + 1).alias("i"), F.when(ends, -1).when(begins, a.i + 1).otherwise(a.open).alias("open"), F.when(ends, a.open).otherwise(a.lo).alias("lo"), F.when(ends, a.i).otherwise(a.hi).alias("hi"),
        )

    return _let(text, lambda t: _let(F.aggregate(t, start, step), lambda a: F.when(a.lo >= 0, F.slice(t, a.lo + 1, a.hi - a.lo))))


def split_items(text: Column) -> Column:
    """array<array<string>>: the pieces of each item, parted by the commas outside parentheses."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("commas"))

    def step(a: Column, p: Column) -> Column:
        return F.struct(
            (a.i + 1).alias("i"), (a.depth + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)).alias("depth"),
            F.when((p == ",") & (a.depth == 0), F.concat(a.commas, F.array(a.i))).otherwise(a.commas).alias("commas"),
        )

    def parted(t: Column, commas: Column) -> Column:
        bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(commas, lambda c: c + 1)).alias("lo"), F.concat(commas, F.array(F.size(t))).alias("hi"))
        return F.transform(bounds, lambda x: F.slice(t, x["lo"] + 1, x["hi"] - x["lo"]))

    return _let(text, lambda t: _let(F.aggregate(t, start, step, lambda a: a.commas), lambda commas: parted(t, commas)))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mapping(item: Column) -> Column:
    """(target_col, source_expression) of an item: the word behind a last AS, else what stands behind the last dot."""
    places = F.filter(F.transform(item, lambda p, i: F.when(~p.rlike(r"^\s*$"), i)), lambda i: i.isNotNull())
    pair = lambda target, expression: F.struct(target.alias("target_col"), expression.alias("source_expression"))

    def told(at: Column) -> Column:
        n = F.size(at)
        before, last = F.get(item, F.get(at, n - 2)), F.get(item, F.get(at, n - 1))
        named = (n > 2) & (F.upper(before) == "AS") & last.rlike(r"^\w+$")
        plain = _let(_trim(F.array_join(item, "")), lambda t: pair(F.trim(F.substring_index(t, ".", -1)), t))
        return F.when(named, pair(last, _trim(F.array_join(F.slice(item, 1, F.get(at, n - 2)), "")))).otherwise(plain)

    return _let(places, told)


def column_lineage(sql: Column) -> Column:
    """Mappings of the last SELECT ... FROM."""
    items = F.transform(split_items(F.coalesce(select_list(plain_pieces(sql)), F.array().cast("array<string>"))), mapping)
    return F.filter(items, lambda m: ~m["source_expression"].isin("", "*"))


def parse_dbt_models(models: DataFrame, database: str = "analytics", schema: str = "public") -> DataFrame:
    """dbt model records of ``models`` (model_name, sql and, if there, description, tags, database, schema, ord)."""
    have = set(models.columns)
    c = F.col("sql")
    text = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    return models.select(
        "model_name",
        F.concat_ws(".", text("database", database), text("schema", schema), "model_name").alias("warehouse_table"),
        refs(c).alias("ref_deps"),
        sources(c).alias("source_deps"),
        column_lineage(c).alias("column_lineage"),
        c.alias("raw_sql"),
        materialization(c).alias("materialization"),
        (F.coalesce("tags", F.array()) if "tags" in have else F.array()).cast("array<string>").alias("tags"),
        text("description", "").alias("description"),
        *(["ord"] if "ord" in have else []),
    )


def all_upstream(models: DataFrame) -> DataFrame:
    """``models`` with all_upstream: references, then sources as source.table."""
    return models.withColumn("all_upstream", F.concat("ref_deps", F.transform("source_deps", lambda s: F.concat_ws(".", s["source_name"], s["table_name"]))))


def dependencies(models: DataFrame, order: str | None = None) -> DataFrame:
    """(model_name, ref_deps): the dependency graph; of a repeated name the last row counts, by the column ``order`` or as
    the rows are read."""
    rows = models.select("model_name", "ref_deps", (F.col(order) if order else F.monotonically_increasing_id()).alias("ord"))
    return rows.groupBy("model_name").agg(F.max_by("ref_deps", "ord").alias("ref_deps"))
