"""Registered queries of the library's own operators, each with the same rows in SQL where SQL can say it.

The driver's tables stand in for books: documents for texts, their lines for pages, events for run logs, customers and
suppliers of a nation for pages and characters of a book. Fixture transforms are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T
from quire.functions.rows import numbered, once, spread
from quire.operators import audit, entities, merge, runs, segments, work
from quire.plans import pages as P
from quire.sources import readers, sinks
from quire.streaming import runs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


#: Rules on given values: they read no table, are not registered, and tests hold them against their SQL.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_ORACLES: dict[str, str] = {}


def example(name: str, sql: str):
    def put(function):
        EXAMPLES[name], EXAMPLE_ORACLES[name] = function, sql
        return function

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


# ---- SQL parts and fixtures ------------------------------------------------------------------------------------------


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return trim_sql(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def clip_sql(x: str, n: int, mark: str = "...") -> str:
    whole = collapse_sql(x)
    return f"CASE WHEN length({whole}) <= {n} THEN {whole} ELSE {trim_sql(f'substring({whole}, 1, {n - 1})')} || '{mark}' END"


def normal_sql(x: str) -> str:
    return trim_sql(rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n|\r', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g')")


LINES = "lines AS (SELECT doc_id, lang, source, i AS pos, parts[i + 1] AS line, len(parts) AS n FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents) d, range(len(parts)) r(i))"
PARAS = rf"(SELECT doc_id, lang, source, {normal_sql(r'''replace(text, chr(10), chr(10) || chr(10))''')} AS text FROM documents)"
CHAPTERS = rf"(SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\n{{2,}}'), lambda x: x <> '')) AS BIGINT) AS paragraph_count FROM {PARAS})"


def lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "line"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "documents"), text=T.normalize(F.replace("text", F.lit("\n"), F.lit("\n\n"))))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(spark, d).select("doc_id", "lang", "source", F.length("text").cast("long").alias("char_count"), T.paragraph_count(F.col("text")).alias("paragraph_count"))


def line_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pages with what reviews and summaries look at."""
    rows = once(lines(spark, d), caption=T.clip(F.col("line"), 60), source_excerpt=T.clip(F.col("line"), 118))
    return rows.select(
        "doc_id", F.floor(F.col("pos") / 4).cast("int").alias("chapter_idx"), (F.col("pos") + 1).alias("page_number"), F.concat(F.lit("sp-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("spread_id"),
        "caption", "source_excerpt", F.col("line").alias("source_passage"), F.length("line").cast("long").alias("char_count"),
        F.when(F.col("pos") % 3 == 0, F.array(F.lit("a"))).otherwise(F.expr("cast(array() as array<string>)")).alias("character_refs"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("p"), F.col("pos").cast("string"))).alias("asset_path"),
        F.when(F.col("pos") % 4 == 0, "ready").when(F.col("pos") % 4 == 1, "needs_redraw").alias("image_status"), F.when(F.col("pos") % 8 == 0, "basic_passed").alias("qa_status"), F.when(F.col("pos") % 5 < 4, "local").otherwise("remote").alias("image_provider"),
    )


PAGES = f"""{LINES}, pages AS (
    SELECT doc_id, CAST(pos // 4 AS INTEGER) AS chapter_idx, CAST(pos + 1 AS INTEGER) AS page_number, 'sp-' || doc_id || '-' || pos AS spread_id, {clip_sql('line', 60)} AS caption, {clip_sql('line', 118)} AS source_excerpt,
           CAST(length(line) AS BIGINT) AS char_count, pos % 3 = 0 AS has_refs, CASE WHEN pos % 2 = 0 THEN 'p' || pos END AS asset_path,
           CASE pos % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'needs_redraw' END AS image_status, CASE WHEN pos % 8 = 0 THEN 'basic_passed' END AS qa_status, CASE WHEN pos % 5 < 4 THEN 'local' ELSE 'remote' END AS image_provider
    FROM lines)"""


# ---- texts -----------------------------------------------------------------------------------------------------------


@query(
    "flagship_plan_totals",
    f"""
    SELECT lang, count(*) AS chapter_count, CAST(sum(n) AS BIGINT) AS total_spread_count, floor(sum(n) / count(*) * 100 + 0.5) / 100 AS average_spreads
    FROM (SELECT lang, least(60, greatest(2, CAST(ceil(char_count / 1800) AS BIGINT), CASE WHEN paragraph_count >= 18 THEN CAST(ceil(paragraph_count / 42) AS BIGINT) ELSE 0 END)) AS n FROM {CHAPTERS}) GROUP BY lang
    """,
)
def flagship(spark, d):
    return P.plan_totals(P.plan_chapters(chapters(spark, d)), "lang")


@query("normalize_text", f"SELECT doc_id, {normal_sql('text')} AS text FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("strip_boilerplate", "SELECT doc_id, chr(10) || text || chr(10) AS text FROM documents")
def strip_boilerplate(spark, d):
    wrapped = F.concat(F.lit("﻿licence *** START OF THE PROJECT GUTENBERG EBOOK, NO 1 ***\n"), F.col("text"), F.lit("\n*** end of this project gutenberg ebook *** more\nlicence *** END OF THE PROJECT GUTENBERG EBOOK ***"))
    return table(spark, d, "documents").select("doc_id", T.strip_boilerplate(wrapped).alias("text"))


_BLOCKS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>', ' ', 'gi'), '<style[\s\S]*?</style>', ' ', 'gi'), '<\s*(h[1-6]|p|div|section|article|li|br)\b[^>]*>', chr(10), 'gi'), '<\s*/\s*(h[1-6]|p|div|section|article|li)\s*>', chr(10), 'gi')"


def entities_sql(x: str) -> str:
    for name, mark in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''")):
        x = f"regexp_replace({x}, '&{name};', '{mark}', 'gi')"
    return x


@query("html_to_text", f"SELECT page_id, {normal_sql(entities_sql(f'''regexp_replace({_BLOCKS}, '<[^>]+>', ' ', 'g')'''))} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "html_title",
    rf"""SELECT page_id, substring({trim_sql(entities_sql(r"regexp_replace(coalesce(nullif(regexp_extract(html, '<h[1-3][^>]*>(.*?)</h[1-3]>', 1, 'is'), ''), regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '<[^>]+>', ' ', 'g')"))}, 1, 120) AS title FROM pages""",
)
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("decode_entities", "SELECT n_nationkey, 'é—<' || n_name || '\"😀 &#99999999;' AS text FROM nation")
def decode_entities(spark, d):
    coded = F.concat(F.lit("&#233;&#x2014;&amp;lt;"), F.col("n_name"), F.lit("&QUOT;&#128512;&nbsp;&#99999999;"))
    return table(spark, d, "nation").select("n_nationkey", T.decode_entities(coded).alias("text"))


def _ratio(pattern: str) -> str:
    return f"floor(len(regexp_extract_all(text, '{pattern}')) / n * 10000 + 0.5) / 10000"


@query(
    "text_quality",
    rf"""
    WITH t AS (SELECT doc_id, text, greatest(length(regexp_replace(text, '\s+', '', 'g')), 1) AS n, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS words FROM documents)
    SELECT doc_id, CAST(length(text) AS BIGINT) AS char_count, {_ratio('[A-Za-z]')} AS latin_ratio, {_ratio(r'\p{Han}')} AS cjk_ratio, {_ratio(r'[\\|]')} AS slash_ratio,
           floor(len(list_filter(words, lambda w: list_contains({T.COMMON_ENGLISH!r}, w))) / greatest(len(words), 1) * 10000 + 0.5) / 10000 AS common_word_ratio, {_ratio(r'[\\|]')} > 0.02 AS garbled_likely FROM t
    """,
)
def text_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", T.quality(F.col("text")).alias("q")).select("doc_id", "q.char_count", "q.latin_ratio", "q.cjk_ratio", "q.slash_ratio", "q.common_word_ratio", "q.garbled_likely")


@query("summaries", f"SELECT doc_id, {clip_sql('text', 160)} AS summary, {clip_sql('text', 260, '…')} AS clipped, {clip_sql('text', 220)} AS preview, {clip_sql('text', 1200)} AS source_passage FROM documents")
def summaries(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.clip(c, 160).alias("summary"), T.clip(c, 260, "…").alias("clipped"), T.clip(c, 220).alias("preview"), T.source_passage(c).alias("source_passage"))


_FIRST = r"regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '^(.*?[.!?。！？])( |$)', 1)"
_EXCERPT = clip_sql(rf"CASE WHEN {_FIRST} = '' THEN text ELSE {_FIRST} END", 118)


@query("source_excerpt", f"SELECT doc_id, {_EXCERPT} AS source_excerpt FROM documents")
def source_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_excerpt(F.col("text")).alias("source_excerpt"))


@query(
    "reader_caption",
    rf"""
    WITH e AS (SELECT doc_id, {_EXCERPT} AS x FROM documents),
    c AS (SELECT doc_id, {collapse_sql(r"regexp_replace(regexp_replace(regexp_replace(x, '\bexplained that\b', 'shared', 'gi'), '\bwatched the\b', 'watched', 'gi'), '\bwith the confidence of\b', 'like', 'gi')")} AS x FROM e),
    f AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '(?i), +|; +| +and +'), lambda p: length(p) BETWEEN 22 AND 86) AS parts FROM c)
    SELECT doc_id, CASE WHEN length(x) <= 86 THEN x WHEN len(parts) > 0 THEN parts[1] ELSE {clip_sql('x', 86)} END AS caption FROM f
    """,
)
def reader_caption(spark, d):
    return table(spark, d, "documents").select("doc_id", T.reader_caption(F.col("text")).alias("caption"))


@query("review_keys", rf"SELECT doc_id, {trim_sql(r'''regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')''')} AS review_key, coalesce(nullif(substring(regexp_replace(regexp_replace(lower({trim_sql('text')}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'item') AS slug FROM documents")
def review_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.review_key(F.col("text")).alias("review_key"), T.slug(F.col("text")).alias("slug"))


@query(
    "string_hash32",
    """
    WITH h AS (SELECT n_name, list_reduce([CAST(0 AS BIGINT)] || list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS x FROM nation)
    SELECT n_name, CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS hash FROM h
    """,
)
def string_hash32(spark, d):
    return table(spark, d, "nation").select("n_name", N.hash32(F.col("n_name")).alias("hash"))


@query("language_detect", r"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ja' WHEN doc_id % 5 = 1 THEN 'zh' ELSE 'en' END AS language FROM documents")
def language_detect(spark, d):
    mixed = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "漢字かな").when(F.col("doc_id") % 5 == 1, "漢字").otherwise(""))
    return table(spark, d, "documents").select("doc_id", T.detect_language(mixed).alias("language"))


@example(
    "language_profile",
    """SELECT * FROM (VALUES ('auto', 'auto', 'en', NULL, false, 'Auto (English)'), ('zh-en', 'bilingual', 'zh', 'en', true, '中文 + English'), ('zh-cn', 'single', 'zh', NULL, false, '中文'), ('Japanese', 'single', 'ja', NULL, false, '日本語'), ('', 'auto', 'en', NULL, false, 'Auto (English)'), ('xx', 'single', 'en', NULL, false, 'English'), ('en,ja', 'bilingual', 'en', 'ja', true, 'English + 日本語'))
    t(option, mode, "primary", secondary, bilingual, label)""",
)
def language_profile(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("auto", "zh-en", "zh-cn", "Japanese", "", "xx", "en,ja")], "option string")
    return rows.select("option", T.language_profile(F.col("option"), F.lit("en")).alias("p")).select("option", "p.*")


@example("clean_heading", "SELECT * FROM (VALUES ('## The Door', 'The Door'), ('12 The Garden', 'Chapter 12: The Garden'), ('第一章 纽织与淡话', '第一章 组织与谈话'), ('CHAPTER I. The Door', 'CHAPTER I. The Door')) t(raw, title)")
def clean_heading(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("## The Door", "12 The Garden", "第一章 纽织与淡话", "CHAPTER I. The Door")], "raw string")
    return rows.select("raw", T.clean_heading(F.col("raw")).alias("title"))


@example("chinese_ordinals", "SELECT n, n AS parsed, CASE WHEN n < 10 THEN 1 WHEN n = 10 THEN 1 WHEN n < 20 OR n % 10 = 0 THEN 2 ELSE 3 END AS letters FROM range(1, 100) r(n)")
def chinese_ordinals(spark, d):
    numeral = T.chinese_numeral(F.col("n"))
    return spark.range(1, 100).toDF("n").select("n", T.chinese_ordinal(F.concat(F.lit("第"), numeral, F.lit("章"))).alias("parsed"), F.length(numeral).alias("letters"))


@query("option_parsers", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE least(8, greatest(1, CAST(floor(CASE WHEN c_acctbal / 1000 = 0 THEN 1 ELSE c_acctbal / 1000 END + 0.5) AS BIGINT))) END AS pages, c_custkey % 3 = 0 AS flag, CASE WHEN c_acctbal >= 1 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 120 END AS least_chars FROM customer")
def option_parsers(spark, d):
    number = (F.col("c_acctbal") / 1000).cast("string")
    option = F.when(F.col("c_custkey") % 7 == 0, "many").otherwise(number)
    word = F.when(F.col("c_custkey") % 3 == 0, " Yes ").when(F.col("c_custkey") % 3 == 1, "off").otherwise("?")
    return table(spark, d, "customer").select("c_custkey", N.spread_count(option).alias("pages"), N.flag(word).alias("flag"), N.positive_integer(F.col("c_acctbal").cast("string"), 120).alias("least_chars"))


@query("escape_markup", "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM documents")
def escape_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_xml(F.col("text")).alias("text"))


@query("titles_from_paths", "SELECT page_id, regexp_replace(regexp_replace(list_extract(string_split(split_part(url, '?', 1), '/'), -1), '(.)\\.[^.]*$', '\\1'), '[-_]+', ' ', 'g') AS title FROM pages")
def titles_from_paths(spark, d):
    return table(spark, d, "pages").select("page_id", T.title_from_path(F.substring_index("url", "?", 1)).alias("title"))


@query("wrapped_titles")
def wrapped_titles(spark, d):
    return lines(spark, d).select("doc_id", "pos", F.array_join(T.wrap(F.col("line"), 40), "\n").alias("wrapped"))


# ---- plans -----------------------------------------------------------------------------------------------------------

_HEURISTIC = "least(8, 1 + " + " + ".join(f"CAST(char_count >= {s} AS BIGINT)" for s in P.STEPS) + " + CAST(paragraph_count >= 24 AND char_count >= 2600 AS BIGINT) + CAST(paragraph_count >= 42 AND char_count >= 5200 AS BIGINT))"


@query("page_plan_fixed", f"SELECT doc_id, char_count, paragraph_count, CAST(5 AS BIGINT) AS spread_count, 'Manual setting uses 5 pages for this chapter.' AS reason FROM {CHAPTERS}")
def page_plan_fixed(spark, d):
    return P.plan_chapters(chapters(spark, d), "fixed", 5).drop("lang", "source")


@query("page_plan_heuristic", f"SELECT doc_id, n AS spread_count, CASE WHEN n <= 1 THEN '短章或过渡章，1 页足够保留主要画面。' WHEN n >= 6 THEN '章节较长且段落较多（' || char_count || ' chars, ' || paragraph_count || ' paragraphs），需要 ' || n || ' 页承接节奏。' ELSE '按文本长度和场景密度规划为 ' || n || ' 页。' END AS reason FROM (SELECT *, {_HEURISTIC} AS n FROM {CHAPTERS})")
def page_plan_heuristic(spark, d):
    return P.plan_chapters(chapters(spark, d), "heuristic").select("doc_id", "spread_count", "reason")


@example("page_plan_modes", "SELECT * FROM (VALUES ('', false, 'full-coverage'), ('full', true, 'full-coverage'), ('自动', true, 'auto'), ('codex-auto', false, 'heuristic'), ('4', true, 'fixed')) t(option, provider, mode)")
def page_plan_modes(spark, d):
    rows = spark.createDataFrame([("", False), ("full", True), ("自动", True), ("codex-auto", False), ("4", True)], "option string, provider boolean")
    return rows.select("option", "provider", P.plan_mode(F.col("option"), F.col("provider")).alias("mode"))


def _proposal_tables(spark, d):
    orders = table(spark, d, "orders")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    ours = orders.select(F.col("o_custkey").alias("doc_id"), at.cast("long").alias("chapter_idx"), F.concat(F.lit("ch-"), F.col("o_orderkey").cast("string")).alias("chapter_id"), (F.col("o_totalprice") / 10).cast("long").alias("char_count"))
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")) - 1
    key = F.col("o_orderkey")
    theirs = orders.where(key % 4 != 3).select(F.col("o_custkey").alias("doc_id"), pos.cast("long").alias("pos"), F.when(key % 5 == 0, (key % 3).cast("string")).when(key % 5 == 1, "none").alias("chapter_index"), F.when(key % 2 == 0, F.concat(F.lit("ch-"), key.cast("string"))).alias("chapter_id"), F.when(key % 9 > 0, F.round(F.col("o_totalprice") / 30000, 2).cast("string")).alias("spread_count"), F.when(key % 3 == 0, F.concat(F.lit("why "), key.cast("string"))).alias("reason"))
    return ours, theirs


def _proposals_sql(policy: str) -> str:
    order, null_index = ("DESC", "0") if policy == "last" else ("ASC", "NULL")
    return f"""
    WITH c AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chapter_idx, 'ch-' || o_orderkey AS chapter_id FROM orders),
    p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 WHEN o_orderkey % 5 = 1 THEN NULL ELSE {null_index} END AS p_index,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'ch-' || o_orderkey END AS p_id, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice / 30000, 2) END AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'why ' || o_orderkey END AS reason FROM orders WHERE o_orderkey % 4 <> 3),
    i AS (SELECT * FROM p WHERE p_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, p_index ORDER BY pos {order}) = 1),
    k AS (SELECT * FROM p WHERE p_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, p_id ORDER BY pos {order}) = 1),
    m AS (SELECT c.*, CASE WHEN i.pos IS NOT NULL THEN i.n WHEN k.pos IS NOT NULL THEN k.n ELSE p.n END AS n, CASE WHEN i.pos IS NOT NULL THEN i.reason WHEN k.pos IS NOT NULL THEN k.reason ELSE p.reason END AS reason
          FROM c LEFT JOIN i ON i.doc_id = c.doc_id AND i.p_index = c.chapter_idx LEFT JOIN k ON k.doc_id = c.doc_id AND k.p_id = c.chapter_id LEFT JOIN p ON p.doc_id = c.doc_id AND p.pos = c.chapter_idx),
    s AS (SELECT *, CASE WHEN n IS NULL THEN 3 ELSE least(8, greatest(1, CAST(floor(CASE WHEN n = 0 THEN 1 ELSE n END + 0.5) AS BIGINT))) END AS spread_count FROM m)
    SELECT doc_id, chapter_idx, spread_count, coalesce(reason, 'Planned ' || spread_count || ' pages.') AS reason FROM s"""


@query("plan_merge_last_wins", _proposals_sql("last"))
def plan_merge_last_wins(spark, d):
    return P.merge_proposals(*_proposal_tables(spark, d), "last").select("doc_id", "chapter_idx", "spread_count", "reason")


@query("plan_merge_first_wins", _proposals_sql("first"))
def plan_merge_first_wins(spark, d):
    return P.merge_proposals(*_proposal_tables(spark, d), "first").select("doc_id", "chapter_idx", "spread_count", "reason")


# ---- chapters and pages ----------------------------------------------------------------------------------------------


@query(
    "chapters_by_map",
    f"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    m AS (SELECT doc_id, parts, 0 AS i, 1 AS s, 3 AS e FROM d UNION ALL SELECT doc_id, parts, 1, 4, len(parts) FROM d UNION ALL SELECT doc_id, parts, 2, 5000, 6000 FROM d),
    b AS (SELECT doc_id, i, s, {trim_sql("array_to_string(parts[s:least(e, len(parts))], chr(10))")} AS text FROM m)
    SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx, 'ch-0' || (i + 1) AS chapter_id, 'Chapter ' || (i + 1) AS title, text, CAST(s AS INTEGER) AS anchor_line, CAST(length(text) AS BIGINT) AS char_count FROM b WHERE text <> ''
    """,
)
def chapters_by_map(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    entry = lambda i, s, e: F.struct(F.lit(i).alias("pos"), F.lit(s).alias("start_line"), F.lit(e).cast("int").alias("end_line"))
    maps = docs.select("doc_id", F.explode(F.array(entry(0, 1, 3), entry(1, 4, None), entry(2, 5000, 6000))).alias("m")).select("doc_id", "m.*", F.lit(None).cast("string").alias("title"))
    return segments.mapped_chapters(docs, maps).select("doc_id", "chapter_idx", "chapter_id", "title", "text", "anchor_line", "char_count")


HEADED = (
    (1, "*** START OF THE PROJECT GUTENBERG EBOOK X ***\nCONTENTS\nCHAPTER I. The Door\nCHAPTER II. The Garden\n\nCHAPTER I.\nThe Door\n\nShe opened it.\n\nCHAPTER II.\nThe Garden\n\nIt was green.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"),
    (2, "第一章 开始\n一\n第二章 途中\n二\n第三章 山上\n三\n第叫章 把握机会\n四\n第五章 回家\n五"),
    (3, "# One: a\nbody\n\n# Two: b\nmore\n\nmore"),
    (4, "PART ONE\n1\nTHE FIRST CLEAR LESSON\nText one.\n2.\nTHE SECOND CLEAR LESSON\nText two."),
)


@example(
    "chapters_by_heading",
    """SELECT * FROM (VALUES (1, 0, 'CHAPTER I. The Door', 'She opened it.'), (1, 1, 'CHAPTER II. The Garden', 'It was green.'), (2, 0, '第一章 开始', '一'), (2, 1, '第二章 途中', '二'), (2, 2, '第三章 山上', '三'), (2, 3, '第四章 把握机会', '四'), (2, 4, '第五章 回家', '五'),
    (3, 0, 'One: a', 'body'), (3, 1, 'Two: b', 'more' || chr(10) || chr(10) || 'more'), (4, 0, 'Chapter 1: THE FIRST CLEAR LESSON', 'Text one.'), (4, 1, 'Chapter 2: THE SECOND CLEAR LESSON', 'Text two.')) t(doc_id, chapter_idx, title, text)""",
)
def chapters_by_heading(spark, d):
    docs = spark.createDataFrame(list(HEADED), "doc_id int, text string").withColumn("text", T.normalize(F.col("text")))
    return segments.split_chapters(docs).select("doc_id", "chapter_idx", "title", "text")


def _fold_sql(budget: int, cue: str) -> str:
    """Recursive packing of paragraphs; ``cue`` is when a group closes before the next paragraph."""
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS parts FROM {PARAS}),
    w AS (SELECT doc_id, parts, 1 AS i, 0 AS chunk, CAST(length(parts[1]) AS BIGINT) AS n FROM d WHERE len(parts) > 0
          UNION ALL SELECT doc_id, parts, i + 1, chunk + CAST({cue} AS INTEGER), CASE WHEN {cue} THEN 0 ELSE n END + length(parts[i + 1]) FROM w WHERE i < len(parts))"""


@query("length_pack", _fold_sql(600, "n + length(parts[i + 1]) > 600") + " SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(list(parts[i] ORDER BY i), chr(10) || chr(10)) AS text FROM w GROUP BY doc_id, chunk")
def length_pack(spark, d):
    return paragraphs(spark, d).select("doc_id", F.posexplode(segments.pack(T.paragraphs(F.col("text")), 600)).alias("chunk", "text"))


_CUE = rf"(regexp_matches(parts[i + 1], '^(?i:{segments.BEAT_CUES})') OR n > 900)"


@query("semantic_beats", _fold_sql(900, _CUE) + ", g AS (SELECT doc_id, chunk, array_to_string(list(parts[i] ORDER BY i), chr(10) || chr(10)) AS text, max(len(parts)) AS n FROM w GROUP BY doc_id, chunk) SELECT doc_id, CAST(chunk AS INTEGER) AS beat, text FROM g WHERE n >= 6 QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2")
def semantic_beats(spark, d):
    return paragraphs(spark, d).select("doc_id", F.posexplode(segments.beats(F.col("text"), 900)).alias("beat", "text"))


@query("split_chapters")
def split_chapters(spark, d):
    return segments.split_chapters(paragraphs(spark, d).select("doc_id", "text"))


@query("spread_slices", rf"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS slice, x AS text FROM (SELECT doc_id, i, {trim_sql('substring(text, CAST(i AS BIGINT), 500)')} AS x FROM documents, range(1, length(text) + 1, 500) r(i)) WHERE x <> ''")
def spread_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segments.slices(F.col("text"), F.lit(500))).alias("slice", "text"))


@query("spread_pad", f"WITH {LINES}, k AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS page, parts[least(i + 1, len(parts))] AS text FROM k, range(len(parts) + 3) r(i)")
def spread_pad(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segments.pad(F.split("text", "\n"), F.size(F.split("text", "\n")) + 3)).alias("page", "text"))


@query("balanced_pages")
def balanced_pages(spark, d):
    planned = paragraphs(spark, d).withColumn("char_count", F.length("text")).withColumn("paragraph_count", T.paragraph_count(F.col("text")))
    planned = once(P.plan_chapters(planned), spread_count=F.col("spread_count")).select("doc_id", F.lit(0).alias("chapter_idx"), F.lit("ch-01").alias("chapter_id"), F.lit(1).alias("anchor_line"), "text", "spread_count")
    return segments.spreads(planned)


@query(
    "visual_intents",
    f"""WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = 0 THEN 'establishing' WHEN pos = n - 1 THEN 'resolution' WHEN regexp_matches(lower(line), '\\b({"|".join(T.ACTION_VERBS)})\\b') THEN 'action' WHEN regexp_matches(lower(line), '\\b({"|".join(T.EMOTION_WORDS)})\\b') THEN 'emotion' ELSE 'story-beat' END AS visual_intent,
    CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS BIGINT) AS page_number, CASE WHEN pos % 2 = 0 THEN 'full-bleed-caption-bottom' ELSE 'image-left-caption-right' END AS layout FROM lines""",
)
def visual_intents(spark, d):
    rows = numbered(lines(spark, d), ["source"], ["doc_id", "pos"], "page")
    return rows.select("doc_id", "pos", T.visual_intent(F.col("line"), F.col("pos"), F.col("n")).alias("visual_intent"), (F.col("page") + 1).cast("long").alias("page_number"), F.when(F.col("pos") % 2 == 0, "full-bleed-caption-bottom").otherwise("image-left-caption-right").alias("layout"))


@query("story_arc", f"WITH {PAGES}, r AS (SELECT *, page_number - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pages) SELECT doc_id, max({clip_sql('source_excerpt', 160)}) FILTER (i = 0) AS opening, max({clip_sql('source_excerpt', 160)}) FILTER (i = n // 2) AS midpoint, max({clip_sql('source_excerpt', 160)}) FILTER (i = n - 1) AS closing, count(*) AS scene_count FROM r GROUP BY doc_id")
def story_arc(spark, d):
    return segments.story_arc(line_pages(spark, d))


# ---- characters ------------------------------------------------------------------------------------------------------


def _titled(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("The Tale of "), F.col("lang")).alias("title"), "text")


@query("capitalized_words", r"SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{2,}\b')) AS name FROM documents) GROUP BY doc_id, name")
def capitalized_words(spark, d):
    return entities.word_counts(table(spark, d, "documents"))


@query("capitalized_phrases", rf"SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}(?:\s+(?:of\s+|the\s+)?[A-Z][a-z]{{2,}}){{1,2}}\b')) AS name FROM documents) WHERE NOT list_contains({list(entities.PHRASE_STOP)!r}, name) AND NOT regexp_matches(name, '\b(Chapter|Illustration|Contents)\b') GROUP BY doc_id, name")
def capitalized_phrases(spark, d):
    return entities.phrase_counts(_titled(spark, d))


@query("top_words", r"SELECT doc_id, name, count, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, name) AS INTEGER) AS rank FROM (SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{2,}\b')) AS name FROM documents) GROUP BY doc_id, name) QUALIFY rank <= 10")
def top_words(spark, d):
    ranked = entities.word_counts(table(spark, d, "documents")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "name")))
    return ranked.where("rank <= 10")


@query("character_review")
def character_review(spark, d):
    return entities.review(_titled(spark, d)).withColumn("aliases", F.array_join("aliases", ","))


@query("characters")
def characters(spark, d):
    docs = _titled(spark, d)
    found = entities.characters(docs, entities.review(docs))
    return found.withColumns({c: F.array_join(c, ",") for c in ("aliases", "visual_anchors")})


@query("character_summary")
def character_summary(spark, d):
    docs = _titled(spark, d)
    return entities.review_summary(docs, entities.review(docs), disabled=entities.is_episodic(F.col("title"), F.col("text")))


@query("character_refs", rf"""WITH {LINES}, w AS (SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}\b')) AS name FROM documents) GROUP BY doc_id, name),
    p AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, name) AS rank FROM w QUALIFY rank <= 3)
    SELECT l.doc_id, 'sp-' || l.doc_id || '-' || l.pos AS spread_id, coalesce(string_agg('c' || p.rank, ',' ORDER BY p.rank) FILTER (regexp_matches(l.line, '(?i)(^|[^\p{{L}}\p{{N}}])' || p.name || '($|[^\p{{L}}\p{{N}}])')), '') AS character_refs FROM lines l LEFT JOIN p USING (doc_id) GROUP BY ALL""")  # fmt: skip
def character_refs(spark, d):
    people = top_words(spark, d).where("rank <= 3").select("doc_id", "rank", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("id"), "name", F.array("name").alias("aliases"))
    return entities.references(line_pages(spark, d), people).withColumn("character_refs", F.array_join("character_refs", ","))


# ---- audits ----------------------------------------------------------------------------------------------------------


def _items(spark, d):
    return lines(spark, d).select("doc_id", "pos", F.floor(F.col("pos") / 5).cast("string").alias("page_idx"), F.col("line").alias("text"), F.when(F.col("pos") % 3 == 0, F.array(*[F.lit(0.5)] * 4)).alias("bbox"))


_AUDIT = f"""{LINES}, g AS (SELECT doc_id, pos // 5 AS page_index, count(*) AS block_count, count(*) FILTER (pos % 3 = 0) AS bbox_count, coalesce(array_to_string(list({trim_sql('line')} ORDER BY pos) FILTER ({trim_sql('line')} <> ''), chr(10)), '') AS t FROM lines GROUP BY ALL),
    a AS (SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(length(t) AS BIGINT) AS char_count, block_count, bbox_count, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 24 OR bbox_count = 0 THEN 'review' ELSE 'ok' END AS status,
          concat_ws(',', CASE WHEN length(t) = 0 THEN 'empty_text' END, CASE WHEN length(t) BETWEEN 1 AND 23 THEN 'sparse_text' END, CASE WHEN bbox_count = 0 THEN 'missing_bboxes' END) AS warnings FROM g)"""


@query("page_audit", f"WITH {_AUDIT} SELECT * FROM a")
def page_audit(spark, d):
    return audit.audit_pages(audit.content_pages(_items(spark, d))).select("doc_id", "page_index", "char_count", "block_count", "bbox_count", "status", F.array_join("warnings", ",").alias("warnings"))


@query("audit_rollup", f"WITH {_AUDIT} SELECT doc_id, count(*) AS page_count, count(*) FILTER (char_count > 0) AS pages_with_text, floor(count(*) FILTER (char_count > 0) / count(*) * 1000 + 0.5) / 1000 AS text_coverage_ratio, CAST(floor(sum(char_count) / count(*) + 0.5) AS BIGINT) AS average_chars_per_page, CAST(sum(bbox_count) AS BIGINT) AS total_bboxes, floor(sum(bbox_count) / sum(block_count) * 1000 + 0.5) / 1000 AS bbox_coverage_ratio, count(*) FILTER (status <> 'ok') AS weak_pages FROM a GROUP BY doc_id")
def audit_rollup(spark, d):
    return audit.audit_summary(audit.audit_pages(audit.content_pages(_items(spark, d)))).select("doc_id", "page_count", "pages_with_text", "text_coverage_ratio", "average_chars_per_page", "total_bboxes", "bbox_coverage_ratio", "weak_pages")


@query("content_text", f"WITH {LINES} SELECT doc_id, array_to_string(list({trim_sql('line')} ORDER BY pos) FILTER ({trim_sql('line')} <> ''), chr(10) || chr(10)) AS text, CAST(max(pos // 5) + 1 AS BIGINT) AS page_count FROM lines GROUP BY doc_id")
def content_text(spark, d):
    return audit.content_text(_items(spark, d))


@query(
    "import_quality",
    """
    WITH q AS (SELECT doc_id, length(text) AS n, doc_id % 11 AS p, (doc_id % 10) / 10.0 AS cov, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 4) / 4.0 END AS box, (doc_id % 5) / 5.0 AS conf, doc_id % 4 AS w, doc_id % 13 = 0 AS garbled FROM documents),
    s AS (SELECT doc_id, garbled, greatest(0, least(100, least(30, floor(least(1.0, n / 1200) * 30 + 0.5)) + floor(cov * 25 + 0.5) + floor(conf * 20 + 0.5) + CASE WHEN box IS NULL THEN 8 ELSE floor(box * 15 + 0.5) END
          + floor(least(1.0, CASE WHEN p > 0 THEN n / p ELSE n END / 80) * 10 + 0.5) - least(18, w * 3) - CASE WHEN garbled THEN 35 ELSE 0 END)) AS x FROM q)
    SELECT doc_id, CAST(x AS BIGINT) AS score, CASE WHEN x >= 78 THEN 'high' WHEN x >= 55 THEN 'medium' ELSE 'low' END AS level, x < 55 OR garbled AS stop_before_drawing FROM s
    """,
)
def import_quality(spark, d):
    k = F.col("doc_id")
    w = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.when(i > 0, i.cast("string")))
    rows = table(spark, d, "documents").select(
        "doc_id", F.length("text").alias("text_chars"), (k % 11).alias("page_count"), ((k % 10) / 10).alias("text_coverage_ratio"), F.lit(None).cast("int").alias("average_chars_per_page"), F.when(k % 3 > 0, (k % 4) / 4).alias("bbox_coverage_ratio"),
        ((k % 5) / 5).alias("chapter_confidence"), F.concat(F.array_compact(w), F.array_compact(w)).alias("warnings"), (k % 13 == 0).alias("garbled"),
    )
    return audit.import_quality(rows).select("doc_id", "score", "level", "stop_before_drawing")


@query("weak_texts", r"SELECT doc_id, length(text) < 120 OR floor(len(regexp_extract_all(text, '[\\|]')) / greatest(length(regexp_replace(text, '\s+', '', 'g')), 1) * 10000 + 0.5) / 10000 > 0.02 OR (doc_id % 9 >= 4 AND doc_id % 3 > 0 AND (doc_id % 3) / (doc_id % 9) < 0.6) OR (doc_id % 9 >= 4 AND length(text) / (doc_id % 9) < 24) AS weak FROM documents")
def weak_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", audit.is_weak_text(F.col("text"), F.col("doc_id") % 9, F.col("doc_id") % 3).alias("weak"))


@query("layout_routes", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'native_text_empty' WHEN doc_id % 9 >= 4 AND (doc_id % 5) / (doc_id % 9) < 0.6 THEN 'many_pages_without_native_text' WHEN doc_id % 9 > 0 AND n > 0 AND n / (doc_id % 9) < 40 THEN 'native_text_sparse' WHEN doc_id % 2 = 0 THEN 'prefer_layout_requested' END AS reason FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS n FROM documents)")
def layout_routes(spark, d):
    k = F.col("doc_id")
    route = audit.layout_engine(F.when(k % 7 == 0, "").otherwise(F.col("text")), F.lit(True), k % 9, k % 5, k % 2 == 0, F.lit(True))
    return table(spark, d, "documents").select("doc_id", route["reason"].alias("reason"))


@query("image_checks", "SELECT p_partkey, CASE WHEN ok AND NOT small THEN 'basic_passed' ELSE 'failed' END AS status, concat_ws(',', CASE WHEN NOT ok THEN 'wrong_aspect_ratio' END, CASE WHEN small THEN 'too_small' END) AS issues, floor(r * 100 + 0.5) / 100 AS ratio FROM (SELECT p_partkey, w / h AS r, abs(w / h - 1.5) <= 0.08 AS ok, w < 1024 OR h < 680 AS small FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 25 + p_partkey % 50 AS h FROM part))")
def image_checks(spark, d):
    checked = audit.image_quality(F.col("p_size") * 40, F.col("p_size") * 25 + F.col("p_partkey") % 50)
    return table(spark, d, "part").select("p_partkey", checked.alias("c")).select("p_partkey", "c.status", F.array_join("c.blocking_issues", ",").alias("issues"), "c.ratio")


@query("duplicate_captions", rf"WITH {PAGES}, k AS (SELECT *, {trim_sql(r'''regexp_replace(lower(caption), '[^\p{L}\p{N}]+', ' ', 'g')''')} AS key FROM pages) SELECT doc_id, spread_id, first_value(spread_id) OVER w AS first_id, page_number FROM k WINDOW w AS (PARTITION BY doc_id, key ORDER BY page_number) QUALIFY row_number() OVER w > 1")
def duplicate_captions(spark, d):
    return audit.repeated_captions(line_pages(spark, d))


@query("duplicate_ids", "SELECT source, text, doc_id, first_value(doc_id) OVER w AS first_id FROM documents WINDOW w AS (PARTITION BY source, text ORDER BY doc_id) QUALIFY row_number() OVER w > 1")
def duplicate_ids(spark, d):
    return audit.duplicates(table(spark, d, "documents"), ["source", "text"], ["doc_id"], "doc_id").select("source", "text", "doc_id", "first_id")


@query(
    "plan_review",
    rf"""WITH {PAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {trim_sql(r'''regexp_replace(lower(caption), '[^\p{L}\p{N}]+', ' ', 'g')''')} ORDER BY page_number) > 1 AS again FROM pages),
    r AS (SELECT doc_id, count(*) AS spread_count, count(*) FILTER (again) AS duplicate_captions, count(*) FILTER (source_excerpt = '') AS without_excerpt, count(*) FILTER (char_count > 3600) AS high_density, count(*) FILTER (NOT has_refs AND doc_id % 2 = 0) AS without_characters, CAST(arg_max(source_excerpt, page_number) = '' AS BIGINT) AS weak FROM k GROUP BY doc_id)
    SELECT doc_id, spread_count, duplicate_captions, high_density, without_characters, CASE WHEN without_excerpt > 0 OR doc_id % 10 = 0 THEN 'blocked' WHEN duplicate_captions + high_density + without_characters + weak > 0 THEN 'review' ELSE 'ready' END AS status FROM r""",
)
def plan_review(spark, d):
    docs = table(spark, d, "documents")
    people = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("id"))
    found = audit.review_plan(line_pages(spark, d), people, docs.where("doc_id % 10 = 0"))
    return found.select("doc_id", "spread_count", "duplicate_captions", "high_density", "without_characters", "status")


@query("project_summary", f"WITH {PAGES} SELECT doc_id, count(DISTINCT chapter_idx) AS chapter_count, count(*) AS spread_count, count(asset_path) AS image_count, count(*) FILTER (image_status = 'ready') AS ready_image_count, count(*) - count(*) FILTER (image_status = 'ready') AS pending_image_count, count(qa_status) AS qa_passed_count, count(*) FILTER (image_status = 'needs_redraw') AS needs_redraw_count, CAST(any_value(doc_id) % 3 AS BIGINT) AS character_count FROM pages GROUP BY doc_id")
def project_summary(spark, d):
    people = table(spark, d, "documents").select("doc_id", F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("doc_id") % 3).cast("int"))), F.lit("pending").alias("reference_status"))
    return audit.project_summary(line_pages(spark, d), people).drop("ready_character_count")


@query("lint_report", f"""WITH {PAGES}, p AS (SELECT *, 'chapters[' || chapter_idx || '].spreads[' || (page_number - 1) || ']' AS spot FROM pages)
    SELECT doc_id, 'warning' AS severity, spot || '.image.assetPath' AS path, 'is missing' AS message FROM p WHERE asset_path IS NULL UNION ALL
    SELECT doc_id, 'warning', spot || '.image.qa', 'is missing for a ready image' FROM p WHERE image_status = 'ready' AND qa_status IS NULL UNION ALL
    SELECT doc_id, 'warning', spot || '.caption', 'is missing' FROM p WHERE caption = '' UNION ALL SELECT doc_id, 'warning', spot || '.readerCaption', 'is missing' FROM p WHERE caption = '' UNION ALL SELECT doc_id, 'warning', spot || '.sourceExcerpt', 'is missing' FROM p WHERE source_excerpt = '' UNION ALL
    SELECT doc_id, 'error', 'book.title', 'is required' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'error', 'planningReview.status', 'is blocked' FROM documents WHERE doc_id % 6 = 0 UNION ALL
    SELECT doc_id, 'error', 'id', 'Duplicate id: ch-0' FROM documents WHERE doc_id % 5 = 0""")  # fmt: skip
def lint_report(spark, d):
    docs, pages = table(spark, d, "documents"), line_pages(spark, d)
    k, some, no = F.col("doc_id"), F.array(F.lit("x")), F.lit(None).cast("string")
    projects = docs.select("doc_id", F.lit("0.1.0").alias("schema_version"), F.when(k % 4 > 0, "t").alias("title"), F.lit("f").alias("source_file"), F.lit("a").alias("art_direction"), F.lit(False).alias("import_stop"), no.alias("import_level"), F.when(k % 6 == 0, "blocked").alias("planning_status"), no.alias("character_status"), F.lit(0).alias("character_pending"))
    people = docs.where(k % 5 == 0).select("doc_id", F.lit(0).alias("pos"), F.lit("ch-0").alias("id"), F.lit("n").alias("name"), some.alias("anchors"), F.lit("p").alias("prompt_path"))
    heads = pages.select("doc_id", "chapter_idx").distinct().select("doc_id", "chapter_idx", F.concat(F.lit("ch-"), F.col("chapter_idx").cast("string")).alias("chapter_id"), F.lit("t").alias("title"), some.alias("anchors"), F.lit("s").alias("summary"))
    leaves = pages.select("doc_id", "chapter_idx", (F.col("page_number") - 1).alias("spread_idx"), "spread_id", "caption", F.col("caption").alias("reader_caption"), "source_excerpt", F.lit("p").alias("scene_prompt"), F.lit("l").alias("layout"), "asset_path", "image_status", "qa_status", some.alias("anchors"))
    return audit.lint(projects, people, heads, leaves)


# ---- queues ----------------------------------------------------------------------------------------------------------


def _queue(spark, d):
    people = table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_acctbal") > 5000, "ready").otherwise("pending").alias("reference_status"))
    pages = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("page_number"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("spread_id"))
    return work.work_queue(people, pages)


_QUEUE = """q0 AS (SELECT s_nationkey AS doc_id, 'character' AS type, 's' || s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN s_acctbal > 5000 THEN 90 ELSE 10 END AS priority, 0 AS part, s_suppkey AS place FROM supplier
    UNION ALL SELECT c_nationkey, 'spread', 'c' || c_custkey, 'needs_generation', 29 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 1, c_custkey FROM customer),
    q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY priority, part, place) AS seq, type, id, status, CAST(priority AS BIGINT) AS priority FROM q0)"""


@query("work_queue", f"WITH {_QUEUE} SELECT * FROM q")
def work_queue(spark, d):
    return _queue(spark, d)


@query("queue_counts", f"WITH {_QUEUE} SELECT doc_id, type, count(*) AS items, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status <> 'ready') AS pending FROM q GROUP BY ALL")
def queue_counts(spark, d):
    return work.queue_counts(_queue(spark, d))


@query("next_items", f"WITH {_QUEUE} SELECT doc_id, type, id, priority FROM q WHERE status <> 'ready' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1")
def next_items(spark, d):
    return work.next_item(_queue(spark, d))


@query("pending_pages", f"WITH {PAGES} SELECT doc_id, spread_id FROM pages WHERE image_provider = 'local' AND image_status IS DISTINCT FROM 'ready'")
def pending_pages(spark, d):
    return work.pending_pages(line_pages(spark, d)).select("doc_id", "spread_id")


@query("rank_zip_import_all", f"""WITH {_QUEUE}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS at, count(*) OVER (PARTITION BY doc_id) AS n FROM q WHERE status <> 'ready'),
    f AS (SELECT o_custkey % 25 AS doc_id, 'o' || o_orderkey AS path, o_orderkey AS mtime FROM orders), g AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY mtime DESC, path) AS newness, w.n FROM f JOIN (SELECT DISTINCT doc_id, n FROM i) w USING (doc_id) QUALIFY newness <= n),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY newness DESC) AS at FROM g), k AS (SELECT doc_id, count(*) AS have FROM g GROUP BY doc_id)
    SELECT i.doc_id, CAST(i.at AS INTEGER) AS at, i.type, i.id, h.path, coalesce(have, 0) >= i.n AS enough FROM i LEFT JOIN h ON h.doc_id = i.doc_id AND h.at = i.at LEFT JOIN k ON k.doc_id = i.doc_id""")  # fmt: skip
def rank_zip_import_all(spark, d):
    files = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("doc_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("mtime"))
    return work.import_by_rank(_queue(spark, d), files)


@example("log_paths", "SELECT * FROM (VALUES (1, '/tmp/gen/a-1.png|/tmp/gen/b.webp'), (2, ''), (3, '/x/y.jpeg')) t(id, paths)")
def log_paths(spark, d):
    rows = spark.createDataFrame([(1, "saved /tmp/gen/a-1.png. then '/tmp/gen/b.webp' and /tmp/gen/a-1.png"), (2, "nothing"), (3, "at /x/y.jpeg)")], "id int, log string")
    return rows.select("id", F.array_join(work.log_paths(F.col("log")), "|").alias("paths"))


@query("batches", "SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch FROM documents")
def batches(spark, d):
    return merge.batches(table(spark, d, "documents").select("doc_id", "source"), 16, ["doc_id"], ["source"])


# ---- captions --------------------------------------------------------------------------------------------------------


def _captions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spread_id"), F.concat(F.lit("caption "), F.col("doc_id").cast("string")).alias("caption"), F.when(F.col("lang") == "fr", "zh").otherwise("en").alias("src"), F.lit(None).cast("string").alias("original_caption"), F.lit("ready").alias("image_status"))


def _caption_lines(spark, d):
    have = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("spread_id"), F.lit("ja").alias("language"), F.lit("古い").alias("text"))
    return merge.relabel_captions(_captions(spark, d), have, ["zh", "en", "ja"], F.col("src"))


_LINES0 = """ln AS (SELECT CAST(doc_id AS VARCHAR) AS spread_id, CAST(i AS INTEGER) AS pos, (['zh', 'en', 'ja'])[i + 1] AS language, (['中文', 'English', '日本語'])[i + 1] AS label, CASE WHEN lang = 'fr' THEN i = 0 ELSE i = 1 END AS own, doc_id % 3 = 0 AND i = 2 AS have, 'caption ' || doc_id AS caption, doc_id FROM documents, range(3) r(i)),
    l AS (SELECT spread_id, pos, language, label, CASE WHEN own THEN caption WHEN have THEN '古い' ELSE '' END AS text, CASE WHEN own THEN 'source' WHEN have THEN 'translated' ELSE 'pending_translation' END AS source, NOT own AND NOT have AS needs_translation FROM ln)"""


@query("caption_relabel", f"WITH {_LINES0} SELECT * FROM l")
def caption_relabel(spark, d):
    return _caption_lines(spark, d)


@query("caption_pending", f"WITH {_LINES0} SELECT spread_id, language FROM l WHERE needs_translation AND text = ''")
def caption_pending(spark, d):
    return merge.pending_translations(_caption_lines(spark, d)).select("spread_id", "language")


@query("caption_apply", f"""WITH {_LINES0}, t AS (SELECT CAST(doc_id % 200 AS VARCHAR) AS spread_id, CASE lang WHEN 'en' THEN 'zh' WHEN 'de' THEN 'ja' ELSE 'en' END AS language, 'new ' || doc_id AS new_text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 200, language ORDER BY doc_id DESC) = 1)
    SELECT l.spread_id, pos, l.language, label, CASE WHEN new_text IS NOT NULL AND source <> 'source' THEN new_text ELSE text END AS text, CASE WHEN new_text IS NOT NULL AND source <> 'source' THEN 'translated' ELSE source END AS source, needs_translation AND new_text IS NULL AS needs_translation FROM l LEFT JOIN t USING (spread_id, language)""")  # fmt: skip
def caption_apply(spark, d):
    said = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 200).cast("string").alias("spread_id"), F.when(F.col("lang") == "en", "chinese").when(F.col("lang") == "de", "JP").otherwise("en-us").alias("language"), F.concat(F.lit(" new "), F.col("doc_id").cast("string")).alias("text"))
    return merge.apply_translations(_caption_lines(spark, d), said)


@query("caption_corrections", """WITH c AS (SELECT CAST(doc_id % 300 AS VARCHAR) AS spread_id, 'fixed ' || doc_id AS new FROM documents WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id DESC) = 1)
    SELECT CAST(doc_id AS VARCHAR) AS spread_id, coalesce(new, 'caption ' || doc_id) AS caption, CASE WHEN new IS NOT NULL THEN 'caption ' || doc_id END AS original_caption, CASE WHEN new IS NOT NULL THEN 'needs_redraw' ELSE 'ready' END AS image_status, CASE WHEN new IS NOT NULL THEN 'ocr_caption_corrected' END AS redraw_reason FROM documents d LEFT JOIN c ON c.spread_id = CAST(d.doc_id AS VARCHAR)""")  # fmt: skip
def caption_corrections(spark, d):
    fixes = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 300).cast("string").alias("id"), F.concat(F.lit('"fixed  '), F.col("doc_id").cast("string"), F.lit('"')).alias("caption"))
    return merge.apply_corrections(_captions(spark, d), fixes).drop("src", "corrected")


@query("caption_refresh", f"""WITH {_LINES0} SELECT spread_id, pos, language, label, CASE WHEN CAST(spread_id AS BIGINT) % 4 = 0 THEN CASE WHEN source = 'source' THEN 'new' ELSE '' END ELSE text END AS text, CASE WHEN CAST(spread_id AS BIGINT) % 4 = 0 AND source <> 'source' THEN 'pending_translation' ELSE source END AS source, CASE WHEN CAST(spread_id AS BIGINT) % 4 = 0 THEN source <> 'source' ELSE needs_translation END AS needs_translation FROM l""")
def caption_refresh(spark, d):
    changed = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spread_id"), F.lit("new").alias("caption"), (F.col("doc_id") % 4 == 0).alias("corrected"))
    return merge.refresh_lines(_caption_lines(spark, d), changed)


@query("styles", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ink-collage' ELSE 'warm-watercolor' END AS style_name FROM customer")
def styles(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "ink-collage").otherwise(F.col("c_mktsegment")).alias("style"))
    return merge.with_style(rows).select("c_custkey", "style_name")


@query("adaptation_candidates", f"WITH {PAGES} SELECT doc_id, spread_id, page_number, {clip_sql('caption', 180, '…')} AS caption, {clip_sql('source_excerpt', 260, '…')} AS source_excerpt FROM pages")
def adaptation_candidates(spark, d):
    return merge.adaptation_candidates(line_pages(spark, d)).drop("source_passage")


@query("chapter_narratives", f"WITH {PAGES}, j AS (SELECT doc_id, chapter_idx, string_agg(caption, ' ' ORDER BY page_number) AS x FROM pages GROUP BY ALL) SELECT doc_id, chapter_idx, {clip_sql('x', 420, '…')} AS summary FROM j")
def chapter_narratives(spark, d):
    return merge.chapter_narrative(line_pages(spark, d))


# ---- runs ------------------------------------------------------------------------------------------------------------


def _runs(spark, d):
    e = table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("project_path"), status.alias("status"), F.floor(F.col("value")).cast("long").alias("total_items"), at.alias("created_at"),
        F.when(F.col("event_id") % 3 > 0, at + F.expr("INTERVAL 1 MINUTE") * (F.col("event_id") % 50)).alias("updated_at"), F.when(F.col("event_id") % 4 == 0, at + F.expr("INTERVAL 1 MINUTE") * (F.col("event_id") % 20)).alias("heartbeat_at"), "value",
    )


_RUNS = """r AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS project_path, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, CAST(floor(value) AS BIGINT) AS total_items, ts AS created_at,
    CASE WHEN event_id % 3 > 0 THEN ts + to_minutes(event_id % 50) END AS updated_at, CASE WHEN event_id % 4 = 0 THEN ts + to_minutes(event_id % 20) END AS heartbeat_at, value FROM events)"""
_AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"
_LATEST = "greatest(created_at, coalesce(updated_at, created_at), coalesce(heartbeat_at, created_at))"


@query("run_latest", f"WITH {_RUNS} SELECT id, epoch_us({_LATEST}) AS latest_us, epoch_us(coalesce(heartbeat_at, updated_at, created_at)) AS shown_us FROM r")
def run_latest(spark, d):
    times = [F.col(c) for c in ("heartbeat_at", "updated_at", "created_at")]
    return _runs(spark, d).select("id", F.unix_micros(runs.latest_time(*times)).alias("latest_us"), F.unix_micros(runs.shown_time(*times)).alias("shown_us"))


@query("run_stale", f"WITH {_RUNS} SELECT id, CASE WHEN status IN ('running', 'queued') AND {_AS_OF} - {_LATEST} > INTERVAL 15 MINUTE THEN 'stale' ELSE status END AS status FROM r")
def run_stale(spark, d):
    return runs.with_stale(_runs(spark, d), F.expr(_AS_OF)).select("id", "status")


@query("run_repeated", f"WITH {_RUNS}, live AS (SELECT DISTINCT project_path FROM r WHERE status IN ('running', 'queued') AND {_AS_OF} - {_LATEST} <= INTERVAL 12 MINUTE) SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT project_path FROM live)")
def run_repeated(spark, d):
    asked = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("project_path"))
    return runs.repeated_starts(asked, _runs(spark, d), ["project_path"], F.expr(_AS_OF)).select("c_custkey")


@query("run_best", f"WITH {_RUNS} SELECT project_path, id, total_items FROM r WHERE status IN ('running', 'queued') QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY total_items DESC, coalesce(heartbeat_at, updated_at, created_at) DESC, id) = 1")
def run_best(spark, d):
    return runs.best_run(_runs(spark, d), ["project_path"]).select("project_path", "id", "total_items")


@query("run_recent", f"WITH {_RUNS} SELECT id, status FROM r ORDER BY id DESC LIMIT 20")
def run_recent(spark, d):
    return runs.recent_runs(_runs(spark, d)).select("id", "status")


@query("run_state", f"WITH {_RUNS} SELECT project_path, id, status FROM r QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY id DESC) = 1")
def run_state(spark, d):
    return runs.latest_state(_runs(spark, d).select("project_path", "id", "status"), "project_path", "id")


@query("run_progress", "SELECT event_id, least(17.0, greatest(5.0, max(value / 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) AS progress FROM events")
def run_progress(spark, d):
    rows = table(spark, d, "events").withColumn("seen", F.col("value") / 10)
    return runs.monotone_progress(rows, "user_id", ["ts", "event_id"], "seen").select("event_id", "progress")


@query("redraw_fresh", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE event_id % 3 >= 1 END AS fresh FROM events")
def redraw_fresh(spark, d):
    at = F.col("ts").cast("timestamp")
    asked = F.when(F.col("event_id") % 5 == 0, "soon").otherwise((at + F.expr("INTERVAL 1 SECOND") * (2 - F.col("event_id") % 3)).cast("string"))
    return table(spark, d, "events").select("event_id", work.fresh_for_redraw(at, asked).alias("fresh"))


@query("recover_match_all", f"WITH {_RUNS}, m AS (SELECT CAST(user_id AS VARCHAR) AS project_path, max(ts) AS mtime, arg_max('f' || event_id, (ts, 'f' || event_id)) AS path FROM events GROUP BY user_id) SELECT id AS run_id, CASE WHEN mtime >= created_at - INTERVAL 60 SECOND THEN path END AS path FROM r LEFT JOIN m USING (project_path)")
def recover_match_all(spark, d):
    files = table(spark, d, "events").select(F.col("user_id").cast("string").alias("project"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("mtime"))
    started = _runs(spark, d).select(F.col("id").alias("run_id"), F.col("project_path").alias("project"), F.col("created_at").alias("started"))
    return work.recover_match(started, files).select("run_id", "path")


@query("run_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 15 MINUTE) AS stale_us, count(*) AS beats FROM s GROUP BY user_id, k")
def run_sessions(spark, d):
    found = streams.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    return found.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("stale_from").alias("stale_us"), "beats")


@query("progress_windows", "SELECT user_id, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS from_us, max(value) AS progress, count(*) AS events FROM events GROUP BY ALL")
def progress_windows(spark, d):
    found = streams.progress_by_window(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value")
    return found.select("user_id", F.unix_micros("from").alias("from_us"), "progress", "events")


@query("ocr_progress", "SELECT event_id, CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 THEN 9 ELSE greatest(9, least(17, 9 + CAST(floor((event_id % 7) / (event_id % 10) * 8 + 0.5) AS BIGINT))) END AS progress, least(98, 20 + CAST(floor((event_id % 101) * 0.78 + 0.5) AS BIGINT)) AS book_progress FROM events")
def ocr_progress(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", N.ocr_progress(k % 7, k % 10).alias("progress"), N.book_progress(k % 101).alias("book_progress"))


# ---- sources and sinks -----------------------------------------------------------------------------------------------


@example("loose_json", "SELECT * FROM (VALUES (1, '[{\"a\":1}]'), (2, '[2]'), (3, '[3,4]'), (4, NULL)) t(id, items)")
def loose_json(spark, d):
    rows = spark.createDataFrame([(1, '[{"a":1}]'), (2, 'Here:\n```json\n{"chapters": [2]}\n```'), (3, 'so {"spreads":[3,4]} done'), (4, "no json")], "id int, reply string")
    return rows.select("id", readers.json_array(F.col("reply"), "chapters", "spreads").alias("items"))


@query("review_pdf_pages", rf"WITH {LINES} SELECT source, doc_id, CAST(pos AS INTEGER) AS pos, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1) // 34 AS BIGINT) AS review_page FROM lines")
def review_pdf_pages(spark, d):
    rows = lines(spark, d).withColumn("line_no", F.struct("doc_id", "pos"))
    return sinks.review_pages(rows, "source", "line_no").select("source", "doc_id", "pos", "review_page")


@query("rendered_books")
def rendered_books(spark, d):
    return sinks.render_books(line_pages(spark, d).withColumn("chapter_title", F.lit("Chapter")))


@query("cache_keys")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", readers.cache_key("1", F.col("text").cast("binary"), F.lit(".txt"), F.create_map(F.lit("lang"), F.col("lang"))).alias("cache_key"))


@query("story_sections", """WITH s AS (SELECT page_id % 20 AS doc_id, page_id, length(html) AS n, page_id % 6 = 0 AS matter FROM pages), a AS (SELECT doc_id, sum(n) FILTER (NOT matter) AS story, sum(n) AS total, count(*) FILTER (NOT matter) AS k FROM s GROUP BY doc_id)
    SELECT s.doc_id, page_id FROM s JOIN a USING (doc_id) WHERE NOT matter OR NOT (k >= 2 AND coalesce(story, 0) >= least(5000.0, total * 0.35))""")  # fmt: skip
def story_sections(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), "page_id", F.when(F.col("page_id") % 6 == 0, "toc.xhtml").otherwise("text.xhtml").alias("file"), F.lit("").alias("title"), F.col("html").alias("text"))
    return readers.story_sections(rows).select("doc_id", "page_id")


from quire import book_queries  # noqa: E402, F401  registers more queries, and SQL for some of these
