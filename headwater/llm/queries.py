"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.stages import spread

from . import bpe, chat_threads, exact_dedup, html_extract, license_scan, ngram_join, packing, quality, substring_dedup, url_filter
from ._common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; a small one of few row groups is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, spark, added=True)
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer)


def capture_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: no list comes with the tables, so days and actions follow
    from hashes of the names. Single hosts, whole domains and language folders are listed, some for a time."""
    host = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    host = host.withColumn("m", code(F.col("host"))).withColumn("domain", F.substring_index("host", ".", -2))
    domain = host.select("domain").distinct().withColumn("m", code(F.col("domain")))

    def entries(df: DataFrame, name: str, entry, action: str, when, on) -> DataFrame:
        return df.where(when).select(F.lit(name).alias("list"), entry.alias("entry"), F.lit(action).alias("action"), day(on).alias("day"))

    m = F.col("m")
    return (
        entries(host, "hosts", F.col("host"), "listed", m % 4 == 0, m % 365)
        .unionByName(entries(host, "hosts", F.col("host"), "unlisted", m % 8 == 0, m % 365 + 200))
        .unionByName(entries(host, "hosts", F.col("host"), "listed", m % 16 == 0, m % 365 + 300))
        .unionByName(entries(host, "folders", F.concat("host", F.lit("/en/")), "listed", m % 3 == 0, m % 500))
        .unionByName(entries(domain, "domains", F.col("domain"), "listed", F.lit(True), m % 300))
        .unionByName(entries(domain, "domains", F.col("domain"), "unlisted", F.lit(True), m % 300 + 90))
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")))
    return url_filter.url_filter(captures, capture_list(pages)).withColumn("fetched", F.col("fetched").cast("string"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` as mail: no message of the table quotes another, so three of four put an earlier one of their
    conversation in front of their own words, with the quote that this one holds in turn. Which one follows from the
    numbers of conversation and turn."""
    back = lambda turn: F.pmod(F.col("conv_id") * 7 + F.col(turn) * 3, F.lit(4))
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("t1", F.when(back("turn") > 0, F.col("turn") - back("turn")))
    rows = rows.withColumn("t2", F.when(back("t1") > 0, F.col("t1") - back("t1")))
    for k in "12":
        rows = rows.join(said.select("conv_id", F.col("turn").alias(f"t{k}"), F.col("said").alias(f"s{k}")), ["conv_id", f"t{k}"], "left")
    quote = lambda marks, text: F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))
    nested = F.coalesce(quote("> > ", F.col("s2")), F.lit(""))
    mail = F.concat(F.lit("On turn "), F.col("t1").cast("string"), F.lit(" someone wrote:\n"), nested, quote("> ", F.col("s1")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", "role", F.coalesce(mail, F.col("text")).alias("text"))


def op9_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = stored(with_quotes(_table(spark, sf_dir, "conversations")))  # read several times
    threads = chat_threads.quotation_threads(messages)
    return threads.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))  # -1: a root


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_bpe, op4_ngram_join, op5_packing, op6_url_filter, op7_license_scan, op8_quality_rules, op9_chat_threads, op10_exact_dedup)}


_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM w JOIN f USING (h), range(50) AS s(k) WHERE first_doc < doc_id),
p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1 : i + 5], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""

_OP6 = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS m, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
g AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) AS m FROM (SELECT DISTINCT domain FROM h)),
e AS (SELECT 'hosts' AS list, host AS key, 'listed' AS action, m % 365 AS d FROM h WHERE m % 4 = 0
  UNION ALL SELECT 'hosts', host, 'unlisted', m % 365 + 200 FROM h WHERE m % 8 = 0
  UNION ALL SELECT 'hosts', host, 'listed', m % 365 + 300 FROM h WHERE m % 16 = 0
  UNION ALL SELECT 'folders', host || '/en/', 'listed', m % 500 FROM h WHERE m % 3 = 0
  UNION ALL SELECT 'domains', domain, 'listed', m % 300 FROM g
  UNION ALL SELECT 'domains', domain, 'unlisted', m % 300 + 90 FROM g),
a AS (SELECT DISTINCT list, key, DATE '2024-01-01' + CAST(d AS INTEGER) AS day, action FROM e),
t AS (SELECT c.page_id, a.list, a.key, arg_max(action, day) AS action
      FROM c JOIN a ON a.day <= c.fetched AND (c.host = a.key OR ends_with(c.host, '.' || a.key) OR (a.key LIKE '%/' AND starts_with(c.host || c.path, a.key)))
      GROUP BY ALL),
v AS (SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
        min(struct_pack(l := -length(key), k := key)).k AS entry FROM t WHERE action = 'listed' GROUP BY page_id)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, host, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists, coalesce(entry, '') AS entry, n_entries IS NOT NULL AS blocked
FROM c LEFT JOIN v USING (page_id)
"""

_OP9 = r"""
WITH said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
b1 AS (SELECT conv_id, turn, role, text, CASE WHEN (conv_id * 7 + turn * 3) % 4 > 0 THEN turn - (conv_id * 7 + turn * 3) % 4 END AS t1 FROM conversations),
b2 AS (SELECT *, CASE WHEN ((conv_id * 7 + t1 * 3) % 4 + 4) % 4 > 0 THEN t1 - ((conv_id * 7 + t1 * 3) % 4 + 4) % 4 END AS t2 FROM b1),
mails AS (SELECT b.conv_id, b.turn, b.role, coalesce('On turn ' || t1 || ' someone wrote:' || chr(10) || coalesce('> > ' || replace(y.said, chr(10), chr(10) || '> > ') || chr(10), '')
    || '> ' || replace(x.said, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(b.text, ''), b.text) AS text
  FROM b2 b LEFT JOIN said x ON x.conv_id = b.conv_id AND x.turn = t1 LEFT JOIN said y ON y.conv_id = b.conv_id AND y.turn = t2),
l AS (SELECT conv_id, turn, i, regexp_extract(line, '^(?:[ \t]*>)+') AS marks, trim(regexp_replace(line, '^(?:[ \t]*>)+', ''), ' ') AS line
  FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM mails)),
x AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level FROM l),
y AS (SELECT *, CASE WHEN line = '' OR lag(line) OVER o IS NULL OR lag(line) OVER o = '' OR lag(level) OVER o <> level THEN 1 ELSE 0 END AS new FROM x WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
p AS (SELECT conv_id, turn, level, lower(trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\s+', ' ', 'g'))) AS passage
  FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM y) WHERE line <> '' GROUP BY conv_id, turn, level, g),
f AS (SELECT conv_id, passage, min(turn) AS original FROM p WHERE level = 0 GROUP BY ALL),
q AS (SELECT DISTINCT p.conv_id, p.turn, p.level, passage, CASE WHEN original < p.turn THEN original END AS original FROM p LEFT JOIN f USING (conv_id, passage) WHERE level > 0),
k AS (SELECT conv_id, turn, count(*) AS n_quotes, count(*) FILTER (original IS NULL) AS n_unlinked, max(level) AS quote_depth,
  max(CASE WHEN original IS NOT NULL THEN struct_pack(l := -level, o := original) END).o AS original FROM q GROUP BY ALL),
z AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM x),
o AS (SELECT conv_id, turn, max(level) > 0 AS quoted, trim(regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i)
    FILTER (level = 0 AND NOT (next > 0 AND regexp_matches(line, '(?i)^.*\b(?:wrote|writes|said|schrieb|a écrit|escribió):\s*$'))), ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS own FROM z GROUP BY conv_id, turn),
m AS (SELECT c.*, lag(c.turn) OVER (PARTITION BY conv_id ORDER BY c.turn) AS previous, k.* EXCLUDE (conv_id, turn), CASE WHEN o.quoted THEN o.own ELSE coalesce(c.text, '') END AS words
  FROM mails c LEFT JOIN k USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)),
s AS (SELECT *, max(CASE WHEN previous IS NULL OR original <> previous THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch_turn
  FROM m)
SELECT conv_id, turn, role, words AS text, coalesce(original, previous, -1) AS parent_turn, original IS NOT NULL AS linked, branch_turn,
  CAST(coalesce(quote_depth, 0) AS BIGINT) AS quote_depth, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_unlinked, 0) AS BIGINT) AS n_unlinked,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || words || chr(10) || '<|end|>' || chr(10) AS chat FROM s
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g WHERE tri IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
        length(t) - length(replace(t, '!', '')) AS n_bangs
      FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words
       OR word_chars > 15 * n_words OR n_upper > n_lower OR 2 * n_bangs > n_words) AS kept
FROM b
"""

_OP10 = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op4_ngram_join": _OP4, "op6_url_filter": _OP6, "op8_quality_rules": _OP8, "op9_chat_threads": _OP9, "op10_exact_dedup": _OP10}
