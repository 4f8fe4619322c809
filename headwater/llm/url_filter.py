"""Operator 6, URL filters: a temporal list join, with DataFrame functions only.

Dated list entries ("listed" / "unlisted" on a day) become validity intervals: within one list and entry, a
listing holds from its day until the day of the next entry that differs. Every capture is then evaluated against
the entries active when it was fetched: it is expanded to the keys that can list it (the host and its parent
domains; host and directory prefixes of the path) and joined as of its fetch time on the key.

Each distinct (url, fetch time) is evaluated once. Hot hosts are safe: a key has as many intervals as its own
history, the join splits large keys, and nothing is collected. Lists of any size are shuffled; Spark broadcasts
them only below its own size threshold.

Cases: captures with null or host-less urls, or without a fetch time that is a date, match nothing and are kept; entries with a
null entry or action, or without a date, are ignored; of entries of one day, "unlisted" wins; repeated entries and captures
change nothing and are kept one by one; hosts compare in lower case without a port, user or final dot; other
columns of the captures stay, those named like results are replaced; empty tables give empty or unmatched results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The result's columns besides the capture's own.
RESULT = ("host", "n_entries", "lists", "entry", "blocked")
_FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host of a URL, null if there is none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)?", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to), half open, from (list, entry, action, day). An entry is a domain
    (it holds for subdomains) or a domain and a path ending in "/"."""
    clean = entries.withColumn("day", F.col("day").try_cast("date")).where("list is not null and entry is not null and day is not null and action in ('listed', 'unlisted')")
    daily = clean.groupBy("list", F.lower("entry").alias("key"), "day").agg(F.max("action").alias("action"))  # unlisted > listed
    history = Window.partitionBy("list", "key").orderBy("day")
    turns = daily.withColumn("before", F.lag("action").over(history)).where("before is null or before <> action")
    return (
        turns.withColumn("valid_to", F.coalesce(F.lead("day").over(history), F.lit(_FOREVER).cast("date")))
        .where("action = 'listed'")
        .select("list", "key", F.col("day").alias("valid_from"), "valid_to")
    )


def keys_of(host: Column, path: Column) -> Column:
    """All keys that can list a URL: domain suffixes of the host, host with each directory of the path."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.split(path, "/")
    folders = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    return F.array_distinct(F.concat(domains, F.coalesce(folders, F.array().cast("array<string>"))))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with host, n_entries (active entries that match), lists (their lists, sorted, joined by
    commas), entry (the longest of them, the least of equals) and blocked."""
    own = captures.drop(*(c for c in RESULT if c != url and c != fetched))
    targets = own.select(F.col(url).alias("__hw_url"), F.col(fetched).try_cast("date").alias("__hw_day")).where(F.col("__hw_url").isNotNull() & F.col("__hw_day").isNotNull()).distinct()
    keys = targets.withColumn("__hw_host", host_of(F.col("__hw_url"))).where("__hw_host is not null")
    keys = keys.select("__hw_url", "__hw_day", F.explode(keys_of(F.col("__hw_host"), path_of(F.col("__hw_url")))).alias("key"))
    active = intervals(entries)
    found = keys.join(active, (keys.key == active.key) & (keys["__hw_day"] >= active.valid_from) & (keys["__hw_day"] < active.valid_to)).select("__hw_url", "__hw_day", keys.key, "list")
    verdicts = found.groupBy("__hw_url", "__hw_day").agg(
        F.count("*").alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),  # as many as there are lists
        F.min(F.struct((-F.length("key")).alias("l"), F.col("key").alias("k"))).getField("k").alias("entry"),
    )
    joined = own.join(verdicts, (F.col(url) == F.col("__hw_url")) & (F.col(fetched).try_cast("date") == F.col("__hw_day")), "left")
    return joined.select(
        *(F.col(c) for c in own.columns),
        host_of(F.col(url)).alias("host"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("entry", F.lit("")).alias("entry"),
        F.col("n_entries").isNotNull().alias("blocked"),
    )
