"""More registered queries: SQL for the chapters, pages and characters of whole texts, and the operators that came later."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import prompts
from quire.functions import text as T
from quire.functions.staging import shared_path, stage
from quire.operators import audit, entities, merge, runs, segments, work
from quire.plans import pages as P
from quire.queries import LINES, ORACLES, PAGES, PARAS, _EXCERPT, _RUNS, _runs, clip_sql, collapse_sql, line_pages, lines, normal_sql, paragraphs, query, table, trim_sql
from quire.sources import readers, sinks
from quire.streaming import runs as streams

# ---- SQL of queries whose operators are registered elsewhere ---------------------------------------------------------

ORACLES["wrapped_titles"] = f"""
    WITH RECURSIVE {LINES}, d AS (SELECT doc_id, pos, list_filter(string_split({collapse_sql('line')}, ' '), lambda w: w <> '') AS words FROM lines),
    w AS (SELECT doc_id, pos, words, 0 AS i, '' AS done, '' AS line FROM d
          UNION ALL SELECT doc_id, pos, words, i + 1, CASE WHEN line <> '' AND length(line) + 1 + length(words[i + 1]) > 40 THEN done || line || chr(10) ELSE done END,
                 CASE WHEN line = '' OR length(line) + 1 + length(words[i + 1]) > 40 THEN words[i + 1] ELSE line || ' ' || words[i + 1] END FROM w WHERE i < len(words))
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, done || line AS wrapped FROM w WHERE i = len(words)"""
_escape_sql = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
ORACLES["rendered_books"] = f"""
    WITH {PAGES}, e AS (SELECT doc_id, page_number, '<section><h2>Chapter</h2><img src="' || coalesce(asset_path, '') || '" alt=""/><p>' || {_escape_sql('caption')} || '</p></section>' AS h FROM pages)
    SELECT doc_id, '<!doctype html><html><head><meta charset="utf-8"/></head><body>' || chr(10) || string_agg(h, chr(10) ORDER BY page_number) || chr(10) || '</body></html>' AS html FROM e GROUP BY doc_id"""
ORACLES["cache_keys"] = """SELECT doc_id, left(sha256('{"version":"1","source":"' || sha256(text) || '","ext":".txt","options":[{"key":"lang","value":"' || lang || '"}]}'), 32) AS cache_key FROM documents"""

#: Candidates with their context and decision: r. A known cast is left out, as its names are in none of the tables.
_ACT = f"(?:{entities.ACTIONS})"
_CANDIDATES = rf"""docs AS (SELECT doc_id, 'The Tale of ' || lang AS title, text, lower(text) AS low FROM documents),
    p AS (SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}(?:\s+(?:of\s+|the\s+)?[A-Z][a-z]{{2,}}){{1,2}}\b')) AS name FROM docs)
          WHERE NOT list_contains({list(entities.PHRASE_STOP)!r}, name) AND name <> 'The Tale' AND NOT regexp_matches(name, '\b(Chapter|Illustration|Contents)\b') GROUP BY doc_id, name HAVING count(*) >= 2),
    g AS (SELECT DISTINCT doc_id, w AS name FROM (SELECT doc_id, unnest(regexp_split_to_array(name, '\s+')) AS w FROM p) WHERE lower(w) NOT IN ('of', 'the')),
    w AS (SELECT doc_id, name, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}\b')) AS name FROM docs) WHERE NOT list_contains({entities.WORD_STOP!r}, name) GROUP BY doc_id, name),
    c AS (SELECT *, 'title-phrase' AS source FROM p UNION ALL SELECT *, 'capitalized-word' FROM w ANTI JOIN g USING (doc_id, name)),
    o AS (SELECT doc_id, name, lower(name) AS word, low, unnest(string_split(low, lower(name))) AS part, generate_subscripts(string_split(low, lower(name)), 1) AS k FROM c JOIN docs USING (doc_id)),
    a AS (SELECT doc_id, name, word, low, k, CAST(sum(length(part)) OVER (PARTITION BY doc_id, name ORDER BY k) + (k - 1) * length(word) AS BIGINT) AS spot, count(*) OVER (PARTITION BY doc_id, name) AS n FROM o),
    b AS (SELECT doc_id, name, k, replace(substring(low, greatest(1, spot - 47), spot - greatest(0, spot - 48) + length(word) + 48), word, chr(1)) AS near FROM a
          WHERE k < n AND NOT regexp_matches(substring(low, greatest(1, spot), least(1, spot)), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substring(low, spot + length(word) + 1, 1), '[\p{{L}}\p{{N}}]')),
    s AS (SELECT doc_id, name, sum(2 * CAST(regexp_matches(near, '(^|[^\p{{L}}\p{{N}}\x01])\x01\s+{_ACT}([^a-z0-9_]|$)') OR regexp_matches(near, '(^|[^a-z0-9_]){_ACT}\s+(?:to\s+|at\s+|with\s+|the\s+)?\x01($|[^\p{{L}}\p{{N}}\x01])') AS INTEGER)
          + CAST(regexp_matches(near, '(^|[^a-z0-9_])(?:{entities.HONORIFICS})\.?\s+\x01($|[^\p{{L}}\p{{N}}\x01])') AS INTEGER)) OVER (PARTITION BY doc_id, name ORDER BY k) AS points, k FROM b),
    x AS (SELECT doc_id, name, coalesce(min(points) FILTER (points >= 6), max(points)) AS context FROM s GROUP BY doc_id, name),
    y AS (SELECT c.doc_id, c.name, c.count, coalesce(x.context, 0) AS context, c.source, lower(c.name) AS plain, regexp_matches(c.name, '\s') AS several, regexp_matches(d.text, '\bNew\s+York\b') AS new_york FROM c JOIN docs d USING (doc_id) LEFT JOIN x ON x.doc_id = c.doc_id AND x.name = c.name),
    z AS (SELECT *, CASE WHEN list_contains({entities.NOT_NAMES!r}, plain) THEN 1 WHEN list_contains({list(entities.PLACES)!r}, plain) OR (plain = 'new' AND new_york) OR regexp_matches(name, '\b(?:{entities.PLACE_PHRASES})\b') THEN 2 WHEN count < 2 THEN 3
          WHEN NOT several AND count < 3 AND context = 0 THEN 4 WHEN NOT several AND context = 0 THEN 5 WHEN context > 0 THEN 6 ELSE 7 END AS rule FROM y),
    r AS (SELECT doc_id, name, name AS aliases, count, count AS score, CAST(context AS BIGINT) AS context, CAST(count + context + CASE WHEN several THEN 2 ELSE 0 END AS BIGINT) AS review_score, (['rejected', 'rejected', 'rejected', 'rejected', 'review', 'approved', 'approved'])[rule] AS status,
          (['common word or title fragment, not a stable character', 'place or location phrase', 'only mentioned once', 'weak single-word signal without character action context', 'recurring proper-name candidate needs story/action context review', 'recurring named entity with story/action context', 'recurring proper-name candidate'])[rule] AS reason, source FROM z)"""
ORACLES["character_review"] = f"WITH {_CANDIDATES} SELECT * FROM r"
_ACCENTS = list(T.ACCENTS)
_CARDS = rf"""WITH {_CANDIDATES}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY review_score DESC, score DESC, count DESC, lower(name), name DESC) AS INTEGER) AS rank FROM r WHERE status = 'approved' QUALIFY rank <= 10)
    SELECT doc_id, rank, coalesce(nullif(substring(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'character-' || rank) AS id, name, aliases, count AS source_mentions,
           name || ' as a recurring picture-book character with a stable outfit, ' || ({_ACCENTS!r})[(rank - 1) % {len(_ACCENTS)} + 1] || ' accent color, readable silhouette, and clear facial expression.' AS description, 'needs_generation' AS reference_status,
           'stable silhouette,' || ({_ACCENTS!r})[(rank - 1) % {len(_ACCENTS)} + 1] || ' color accent,clear facial expression' AS visual_anchors FROM k
    UNION ALL SELECT doc_id, 1, 'protagonist', 'Protagonist', 'Protagonist', 0, 'A gentle recurring protagonist designed with a stable outfit and warm expression.', 'needs_generation', '{','.join(entities.GENERIC_ANCHORS)}' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM k)"""
ORACLES["characters"] = _CARDS
_SIGNS = " + ".join(f"least(4, len(regexp_extract_all(low, '\\b{s}\\b')))" for s in entities.EPISODIC_SIGNALS)
_SUMMARY = rf"""WITH {_CANDIDATES}, n AS (SELECT doc_id, least(count(*) FILTER (status = 'approved'), 10) AS a, count(*) FILTER (status = 'rejected') AS j, count(*) FILTER (status = 'review') AS v FROM r GROUP BY doc_id),
    m AS (SELECT d.doc_id, coalesce(a, 0) AS a, coalesce(j, 0) AS j, coalesce(v, 0) AS v, length(low) >= 50000 AND {_SIGNS} >= 12 AND regexp_matches(low, '\bprinciple\b') AS off FROM docs d LEFT JOIN n USING (doc_id))
    SELECT doc_id, CASE WHEN off THEN 'not_used' WHEN a = 0 THEN 'fallback' WHEN v > 0 THEN 'review' ELSE 'ready' END AS status, CASE WHEN off THEN 0 WHEN a = 0 THEN 1 ELSE a END AS approved_count, CASE WHEN off THEN j + v + CASE WHEN a = 0 THEN 1 ELSE a END ELSE j END AS rejected_count, CASE WHEN off THEN 0 ELSE v END AS review_count FROM m"""
ORACLES["character_summary"] = _SUMMARY

_cut = lambda x, t: f"list_filter(list_transform(range(1, length({x}) + 1, {t}), lambda i: {trim_sql(f'substring({x}, CAST(i AS BIGINT), {t})')}), lambda y: y <> '')"
_SEGMENTS = rf"""d AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS parts,
         least(60, greatest(2, CAST(ceil(length(text) / 1800) AS BIGINT), CASE WHEN np >= 18 THEN CAST(ceil(np / 42) AS BIGINT) ELSE 0 END)) AS n
         FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\n{{2,}}'), lambda x: x <> '')) AS np FROM {PARAS})),
    t AS (SELECT doc_id, n, greatest(1, CAST(ceil(coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0) / n) AS BIGINT)) AS target, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM d),
    e AS (SELECT doc_id, k, target, p, list_filter(list_transform(string_split(regexp_replace(p, '([.!?。！？][”’"'']?)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {trim_sql('x')}), lambda x: x <> '') AS s FROM t WHERE length(p) > target * 1.15),
    f AS (SELECT doc_id, k, target, s, 1 AS i, 1 AS grp, CAST(length(s[1]) AS BIGINT) AS m FROM e WHERE len(s) > 1
          UNION ALL SELECT doc_id, k, target, s, i + 1, grp + CAST(fresh AS INTEGER), CASE WHEN fresh THEN 0 ELSE m END + length(s[i + 1])
          FROM (SELECT *, length(s[i]) > target * 1.25 OR length(s[i + 1]) > target * 1.25 OR m + length(s[i + 1]) > target AS fresh FROM f WHERE i < len(s))),
    h AS (SELECT doc_id, k, grp, array_to_string(list(s[i] ORDER BY i), ' ') AS c, count(*) = 1 AND max(length(s[i])) > max(target) * 1.25 AS long, max(target) AS target FROM f GROUP BY doc_id, k, grp),
    q AS (SELECT doc_id, k, 0 AS grp, [p] AS x FROM t WHERE length(p) <= target * 1.15 UNION ALL SELECT doc_id, k, 0, {_cut('p', 'target')} FROM e WHERE len(s) <= 1 UNION ALL SELECT doc_id, k, grp, CASE WHEN long THEN {_cut('c', 'target')} ELSE [c] END FROM h),
    u AS (SELECT doc_id, flatten(list(x ORDER BY k, grp)) AS parts FROM q GROUP BY doc_id),
    b0 AS (SELECT u.*, n, greatest(1, CAST(ceil(list_sum(list_transform(u.parts, lambda x: length(x))) / n) AS BIGINT)) AS target FROM u JOIN d USING (doc_id)),
    b AS (SELECT doc_id, parts, n, target, 1 AS i, 0 AS done, CAST(length(parts[1]) AS BIGINT) AS m FROM b0 WHERE len(parts) > n
          UNION ALL SELECT doc_id, parts, n, target, i + 1, done + CAST(fresh AS INTEGER), CASE WHEN fresh THEN 0 ELSE m END + length(parts[i + 1])
          FROM (SELECT *, done < n - 1 AND m + length(parts[i + 1]) > target AND abs(target - m) <= abs(target - m - length(parts[i + 1])) AND NOT len(parts) - i <= n - done - 1 AS fresh FROM b WHERE i < len(parts))),
    v AS (SELECT doc_id, list(c ORDER BY done) AS x FROM (SELECT doc_id, done, array_to_string(list(parts[i] ORDER BY i), chr(10) || chr(10)) AS c FROM b GROUP BY doc_id, done) GROUP BY doc_id
          UNION ALL SELECT doc_id, parts FROM b0 WHERE len(parts) <= n),
    pages AS (SELECT doc_id, CAST(j AS INTEGER) AS spread_idx, n, coalesce(x[least(j + 1, len(x))], '') AS text FROM d LEFT JOIN v USING (doc_id), range(n) r(j))"""
_QUIET = f"CASE WHEN text = '' THEN 'A quiet story moment ' || (spread_idx + 1) || '.' ELSE {_EXCERPT} END"
_BALANCED = rf"""WITH RECURSIVE {_SEGMENTS},
    ex AS (SELECT *, {_QUIET} AS source_excerpt FROM pages),
    ca AS (SELECT *, {collapse_sql(r"regexp_replace(regexp_replace(regexp_replace(source_excerpt, '\bexplained that\b', 'shared', 'gi'), '\bwatched the\b', 'watched', 'gi'), '\bwith the confidence of\b', 'like', 'gi')")} AS y FROM ex),
    fr AS (SELECT *, list_filter(regexp_split_to_array(y, '(?i), +|; +| +and +'), lambda p: length(p) BETWEEN 22 AND 86) AS bits FROM ca)
    SELECT doc_id, 0 AS chapter_idx, spread_idx, 'ch-01-sp-' || lpad(CAST(spread_idx + 1 AS VARCHAR), 2, '0') AS spread_id, 'ch-01' AS chapter_id, spread_idx + 1 AS page_number,
           CASE WHEN spread_idx = 0 THEN 'establishing' WHEN spread_idx = n - 1 THEN 'resolution' WHEN regexp_matches(lower(text), '\b({"|".join(T.ACTION_VERBS)})\b') THEN 'action' WHEN regexp_matches(lower(text), '\b({"|".join(T.EMOTION_WORDS)})\b') THEN 'emotion' ELSE 'story-beat' END AS visual_intent,
           CASE WHEN length(y) <= 86 THEN y WHEN len(bits) > 0 THEN bits[1] ELSE {clip_sql('y', 86)} END AS caption, source_excerpt, {clip_sql('text', 1200)} AS source_passage, 'text:line:1:spread:' || (spread_idx + 1) AS source_anchor,
           CAST(length(text) AS BIGINT) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\n{{2,}}'), lambda x: x <> '')) AS BIGINT) AS paragraph_count,
           CASE WHEN spread_idx % 2 = 0 THEN 'full-bleed-caption-bottom' ELSE 'image-left-caption-right' END AS layout FROM fr"""
ORACLES["balanced_pages"] = _BALANCED


def _packed(src, name, budget, cue=None):
    """Subqueries ``name`` (doc_id, parts): the lists of ``src`` (doc_id, parts) joined into chunks."""
    close = cue or f"m + length(parts[i + 1]) > {budget}"
    return rf"""{name}_w AS (SELECT doc_id, parts, 1 AS i, 0 AS grp, CAST(length(parts[1]) AS BIGINT) AS m FROM {src} WHERE len(parts) > 0
          UNION ALL SELECT doc_id, parts, i + 1, grp + CAST(fresh AS INTEGER), CASE WHEN fresh THEN 0 ELSE m END + length(parts[i + 1]) FROM (SELECT *, {close} AS fresh FROM {name}_w WHERE i < len(parts))),
    {name} AS (SELECT doc_id, list(c ORDER BY grp) AS parts FROM (SELECT doc_id, grp, array_to_string(list(parts[i] ORDER BY i), chr(10) || chr(10)) AS c FROM {name}_w GROUP BY doc_id, grp) GROUP BY doc_id)"""


_CUE_4200 = rf"(regexp_matches(parts[i + 1], '^(?i:{segments.BEAT_CUES})') OR m > 4200)"
_SPLIT = rf"""WITH RECURSIVE d AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {trim_sql('x')}) AS rows, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS parts FROM {PARAS}),
    {_packed('d', 'beat', 4200, _CUE_4200)},
    meant AS (SELECT beat.doc_id, beat.parts FROM beat JOIN d USING (doc_id) WHERE len(d.parts) >= 6 AND len(beat.parts) >= 2),
    src AS (SELECT doc_id, coalesce(meant.parts, d.parts) AS parts, meant.parts IS NOT NULL AS sem FROM d LEFT JOIN meant USING (doc_id)),
    {_packed('src', 'packed', 4200)},
    x AS (SELECT doc_id, sem, rows, unnest(packed.parts) AS text, generate_subscripts(packed.parts, 1) - 1 AS i FROM packed JOIN src USING (doc_id) JOIN d USING (doc_id))
    SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx, 'ch-' || CASE WHEN i < 9 THEN '0' ELSE '' END || (i + 1) AS chapter_id, 'Chapter ' || (i + 1) AS title, text, CAST(greatest(1, coalesce(list_position(rows, list_filter(list_transform(string_split(text, chr(10)), lambda y: {trim_sql('y')}), lambda y: y <> '')[1]), 1)) AS INTEGER) AS anchor_line,
           CASE WHEN sem THEN 'semantic_fallback' ELSE 'length_fallback' END AS split_method, CASE WHEN sem THEN 0.62 ELSE 0.42 END::DOUBLE AS split_confidence, CAST(length(text) AS BIGINT) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\n{{2,}}'), lambda z: z <> '')) AS BIGINT) AS paragraph_count FROM x"""
ORACLES["split_chapters"] = _SPLIT


# ---- headings planted in whole texts ---------------------------------------------------------------------------------


def _planted(spark, d):
    """Texts with a table of contents and a heading before each eight lines, of three forms, and one more at the end."""
    body = lines(spark, d).select("doc_id", "pos", F.concat(F.lit("~ "), "line").alias("line")).withColumn("k", F.floor(F.col("pos") / 8) + 1)
    k = F.col("k").cast("string")
    heading = F.when(F.col("k") % 3 == 0, F.concat(F.lit("# Part "), k)).when(F.col("k") % 3 == 1, F.concat(F.lit("CHAPTER "), k, F.lit(".\nThe Title "), k, F.lit("\n"))).otherwise(F.concat(F.lit("Chapter "), k, F.lit(": On the Way")))
    parts = body.groupBy("doc_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body")).withColumn("part", F.concat(heading, F.lit("\n"), "body", F.lit("\n")))
    texts = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("t"))
    return texts.select("doc_id", F.concat(F.lit("CONTENTS\nCHAPTER 1. The Title .... 5\nChapter 2: On the Way .... 9\n\n"), "t", F.lit("\nChapter 99: The End\nall")).alias("text"))


@query(
    "chapters_planted",
    rf"""WITH {LINES}, p AS (SELECT doc_id, pos // 8 AS i, {trim_sql("string_agg('~ ' || line, chr(10) ORDER BY pos)")} AS text FROM lines GROUP BY ALL),
    q AS (SELECT doc_id, i, CASE (i + 1) % 3 WHEN 0 THEN 'Part ' || (i + 1) WHEN 1 THEN 'CHAPTER ' || (i + 1) || '. The Title ' || (i + 1) ELSE 'Chapter ' || (i + 1) || ': On the Way' END AS title, text FROM p
          UNION ALL SELECT doc_id, max(i) + 1, 'Chapter 99: The End', 'all' FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx, title, text, 'heading' AS split_method, CAST(length(text) AS BIGINT) AS char_count FROM q""",
)
def chapters_planted(spark, d):
    return segments.split_chapters(_planted(spark, d)).select("doc_id", "chapter_idx", "title", "text", "split_method", "char_count")


@query("chapter_methods", f"{_SPLIT.replace('SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx', ', out AS (SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx', 1)}) SELECT doc_id, min(split_method) AS method, floor(avg(split_confidence) * 100 + 0.5) / 100 AS confidence, count(*) AS chapter_count FROM out GROUP BY doc_id")
def chapter_methods(spark, d):
    return segments.chapter_report(segments.split_chapters(paragraphs(spark, d).select("doc_id", "text")))


@query(
    "headings_cleaned",
    rf"""WITH {LINES}, r AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE pos % 3 WHEN 0 THEN '## ' || line WHEN 1 THEN (pos % 99 + 1) || ' ' || line ELSE line END AS raw FROM lines),
    s AS (SELECT doc_id, pos, {trim_sql(r"regexp_replace(raw, '^#{1,3}\s+', '')")} AS x FROM r)
    SELECT doc_id, pos, CASE WHEN regexp_matches(x, '^[0-9]{{1,2}}\s+.+$') THEN 'Chapter ' || regexp_extract(x, '^([0-9]{{1,2}})\s', 1) || ': ' || {trim_sql(r"regexp_extract(x, '^[0-9]{1,2}\s+(.+)$', 1)")} ELSE x END AS title FROM s""",
)
def headings_cleaned(spark, d):
    k = F.col("pos") % 3
    raw = F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat((F.col("pos") % 99 + 1).cast("string"), F.lit(" "), "line")).otherwise(F.col("line"))
    return lines(spark, d).select("doc_id", "pos", T.clean_heading(raw).alias("title"))


@query(
    "trimmed_books",
    rf"""WITH {LINES}, b AS (SELECT doc_id, n, list('~ ' || line ORDER BY pos) AS parts FROM lines GROUP BY doc_id, n)
    SELECT doc_id, array_to_string(CASE WHEN n > 20 THEN [] ELSE parts END || ['CHAPTER 1. Of It'] || flatten(list_transform(range(90), lambda i: ['~ body ' || i])) || CASE WHEN doc_id % 2 = 0 THEN [] ELSE ['Index', 'a, 1'] END, chr(10)) AS text FROM b""",
)
def trimmed_books(spark, d):
    """What stands before the first heading goes if that is over 20 lines; an index is back matter only far enough behind, which it is in even books here."""
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: F.concat(F.lit("~ body "), i.cast("string"))), "\n")
    front = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("~ "), x)), "\n")
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("\nIndex\na, 1")).otherwise("\n[Index]\na, 1")
    text = F.concat(front, F.lit("\nCHAPTER 1. Of It\n"), body, tail)
    found = readers.trim_books(table(spark, d, "documents").select("doc_id", text.alias("text")))
    return found.select("doc_id", F.replace("text", F.lit("\n[Index]"), F.lit("\nIndex")).alias("text"))


# ---- imports ---------------------------------------------------------------------------------------------------------


@query(
    "import_advice",
    """SELECT doc_id, coalesce(nullif(concat_ws('|', CASE WHEN doc_id % 13 = 0 THEN 'Re-run import with OCR; native PDF text appears garbled.' END, CASE WHEN doc_id % 100 < 55 THEN 'Review import before drawing; extracted text or chapter split looks weak.' END,
    CASE WHEN doc_id % 3 > 0 THEN 'Open page audit and inspect sparse or low-confidence pages.' END, CASE WHEN doc_id % 5 < 3 AND doc_id % 2 = 0 THEN 'Re-run with image analysis if image-heavy pages need layout grounding.' END, CASE WHEN doc_id % 4 <= 1 THEN 'Provide a chapter map for long books without clear chapter headings.' END), ''),
    'Import is ready for story planning and image prompts.') AS advice FROM documents""",
)
def import_advice(spark, d):
    k = F.col("doc_id")
    notes = audit.recommendations(k % 100, k % 13 == 0, k % 3, F.when(k % 5 < 4, (k % 5) / 4), k % 2 == 0, k % 4)
    return table(spark, d, "documents").select("doc_id", F.array_join(notes, "|").alias("advice"))


def _attempts(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    step = lambda pos, method, text, weak: F.struct(F.lit(pos).alias("pos"), F.lit(method).alias("method"), text.alias("text"), weak.alias("weak"))
    tried = F.array(step(0, "native", F.when(k % 3 > 0, F.col("text")).otherwise(" "), k % 6 < 4), step(1, "layout", F.when(k % 4 > 0, F.col("text")), F.lit(False) | (k % 4 < 3)), step(2, "ocr", F.concat(F.lit("ocr "), "text"), k % 5 == 0))
    return docs.select("doc_id", F.explode(tried).alias("a")).select("doc_id", "a.*")


@query(
    "extraction_chain",
    rf"""WITH a AS (SELECT doc_id, 0 AS pos, 'native' AS method, CASE WHEN doc_id % 3 > 0 THEN text ELSE ' ' END AS t, doc_id % 6 < 4 AS weak FROM documents UNION ALL SELECT doc_id, 1, 'layout', CASE WHEN doc_id % 4 > 0 THEN text ELSE '' END, doc_id % 4 < 3 FROM documents
    UNION ALL SELECT doc_id, 2, 'ocr', 'ocr ' || text, doc_id % 5 = 0 FROM documents), b AS (SELECT *, CASE WHEN {trim_sql('t')} = '' THEN 'empty' WHEN weak THEN 'weak' ELSE 'ok' END AS status FROM a),
    c AS (SELECT *, min(pos) FILTER (status = 'ok') OVER (PARTITION BY doc_id) AS stop FROM b)
    SELECT doc_id, pos, method, status, CASE WHEN stop IS NULL THEN row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, pos) = 1 AND status <> 'empty' ELSE pos = stop END AS used FROM c WHERE stop IS NULL OR pos <= stop""",
)
def extraction_chain(spark, d):
    return readers.extraction_chain(_attempts(spark, d))


@query("ocr_pages", f"WITH {LINES} SELECT doc_id, CAST(pos // 6 AS INTEGER) AS page_index, string_agg(line, chr(10) ORDER BY pos) AS text, floor(avg((pos % 10) / 10.0) * 1000 + 0.5) / 1000 AS confidence, count(*) AS line_count FROM lines GROUP BY ALL")
def ocr_pages(spark, d):
    boxes = lines(spark, d).select("doc_id", F.floor(F.col("pos") / 6).cast("int").alias("page_index"), (F.col("pos") / 2).cast("int").alias("y"), (F.col("pos") % 2).alias("x"), F.col("line").alias("text"), ((F.col("pos") % 10) / 10).alias("confidence"))
    return readers.ocr_lines(boxes)


# ---- planning and prompts --------------------------------------------------------------------------------------------


@query("chapter_sketches", rf"SELECT doc_id, {clip_sql('text', 300, '…')} AS opening, {clip_sql('tail', 260, '…')} AS closing FROM (SELECT doc_id, text, right(text, 420) AS tail FROM documents)")
def chapter_sketches(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chapter_idx"), F.lit("c").alias("chapter_id"), F.lit("t").alias("title"), "text", F.length("text").alias("char_count"), F.lit(1).alias("paragraph_count"))
    return P.chapter_sketches(rows).select("doc_id", "opening", "closing")


_STEPS_SQL = " + ".join(f"CAST(char_count >= {s} AS BIGINT)" for s in P.STEPS)


_SAID_INDEX = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN CAST(chapter_idx + 1 AS {text}) ELSE CAST(chapter_idx AS {text}) END AS chapter_index"
_SAID_ID = "CASE WHEN o_orderkey % 3 = 0 THEN 'ch-' || chapter_idx ELSE '' END AS chapter_id"
_SAID_FIRST = ["doc_id", "shard", "3 - chapter_idx % 4 AS pos", _SAID_INDEX, _SAID_ID, "CASE WHEN o_orderkey % 7 = 0 THEN 'many' ELSE CAST(o_orderkey % 11 AS {text}) END AS spread_count"]
_SAID_AGAIN = ["doc_id", "shard", "7 - chapter_idx % 4 AS pos", _SAID_INDEX, _SAID_ID, "CAST(o_orderkey % 9 AS {text}) AS spread_count"]


def _said(columns: list[str], text: str) -> list[str]:
    return [c.format(text=text) for c in columns]


@query(
    "plan_shards",
    f"""WITH c AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chapter_idx, CAST(o_totalprice / 10 AS BIGINT) AS char_count, o_orderkey FROM orders),
    s AS (SELECT *, chapter_idx // 4 AS shard, least(8, 1 + {_STEPS_SQL}) AS own FROM c),
    p AS (SELECT {", ".join(_said(_SAID_FIRST, "VARCHAR"))} FROM s WHERE shard % 2 = 0 AND o_orderkey % 4 <> 3 UNION ALL SELECT {", ".join(_said(_SAID_AGAIN, "VARCHAR"))} FROM s WHERE shard % 2 = 0 AND o_orderkey % 4 <> 3),
    q AS (SELECT s.*, (SELECT arg_min(spread_count, pos) FROM p WHERE p.doc_id = s.doc_id AND p.shard = s.shard AND p.chapter_index = CAST(s.chapter_idx AS VARCHAR)) AS by_index,
          (SELECT arg_min(spread_count, pos) FROM p WHERE p.doc_id = s.doc_id AND p.shard = s.shard AND p.chapter_id = 'ch-' || s.chapter_idx) AS by_id,
          (SELECT arg_min(spread_count, pos) FROM p WHERE p.doc_id = s.doc_id AND p.shard = s.shard AND p.pos = s.chapter_idx % 4) AS by_place, NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.shard = s.shard) AS fell_back FROM s)
    SELECT doc_id, chapter_idx, shard, CASE WHEN said IS NULL THEN own ELSE greatest(1, least(8, said)) END AS spread_count, fell_back FROM (SELECT *, TRY_CAST(coalesce(by_index, by_id, by_place) AS BIGINT) AS said FROM q)""",
)
def plan_shards(spark, d):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), at.cast("long").alias("chapter_idx"), F.round(F.col("o_totalprice") / 10).cast("long").alias("char_count"), F.lit(1).alias("paragraph_count"), "o_orderkey")
    answered = rows.withColumn("shard", F.floor(F.col("chapter_idx") / 4).cast("long")).where("shard % 2 = 0 AND o_orderkey % 4 <> 3")
    said = [answered.selectExpr(*_said(what, "STRING")) for what in (_SAID_FIRST, _SAID_AGAIN)]
    chapters = rows.drop("o_orderkey").withColumn("chapter_id", F.concat(F.lit("ch-"), F.col("chapter_idx").cast("string")))
    return P.plan_by_shard(chapters, said[0].unionByName(said[1])).select("doc_id", "chapter_idx", "shard", "spread_count", "fell_back")


@query("polish_candidates", f"WITH {PAGES} SELECT doc_id, spread_id, '' AS chapter_title, {clip_sql('caption', 260, '…')} AS caption, {clip_sql('source_excerpt', 900, '…')} AS source_excerpt, {clip_sql('caption', 900, '…')} AS scene_text FROM pages")
def polish_candidates(spark, d):
    pages = line_pages(spark, d).withColumns({"chapter_id": F.lit("c"), "chapter_title": F.lit(None).cast("string"), "scene_prompt": F.concat(F.lit("art\nScene: "), "caption", F.lit("\nCharacters: x\nAvoid: y"))})
    return merge.polish_candidates(pages).drop("chapter_id")


_FORMATS = "(['pdf', 'epub', 'TXT', 'docx'])[CAST(doc_id % 4 AS INTEGER) + 1] AS f, (['mineru-layout', 'native', '', 'Vision'])[CAST(doc_id // 4 % 4 AS INTEGER) + 1] AS m, CASE WHEN doc_id % 7 = 0 THEN 'ok' END AS o, CASE WHEN doc_id % 3 = 0 THEN 'tesseract-ocr' END AS e"


@query("project_eligibility", f"SELECT doc_id, polish, NOT polish AND lower(f) IN ('pdf', 'epub', 'txt') AND doc_id % 5 > 0 AS adapt FROM (SELECT doc_id, f, f = 'pdf' AND (coalesce(o, '') = 'ok' OR regexp_matches(lower(coalesce(nullif(m, ''), e, '')), 'ocr|vision|mineru')) AS polish FROM (SELECT doc_id, {_FORMATS} FROM documents))")
def project_eligibility(spark, d):
    k = F.col("doc_id")
    pick = lambda i, *words: F.element_at(F.array(*map(F.lit, words)), (i % 4 + 1).cast("int"))
    facts = (pick(k, "pdf", "epub", "TXT", "docx"), pick(F.floor(k / 4), "mineru-layout", "native", "", "Vision"), F.when(k % 3 == 0, "tesseract-ocr"), F.when(k % 7 == 0, "ok"))
    return table(spark, d, "documents").select("doc_id", merge.is_polished(*facts).alias("polish"), merge.is_adapted(*facts, k % 5).alias("adapt"))


@query(
    "scene_prompts",
    f"""WITH {PAGES} SELECT doc_id, spread_id, CASE WHEN doc_id % 2 = 0 THEN 'flat art' ELSE '{prompts.PLAIN_SCENE_ART}' END || chr(10) || 'Scene: ' || caption || chr(10) || 'Characters: ' || CASE WHEN has_refs THEN 'a' ELSE '{prompts.ANYBODY}' END || chr(10) || 'Composition: {prompts.PLAIN_SCENE_CAMERA}; one emotionally clear action; no visible text.' || chr(10)
    || 'Continuity: {prompts.PLAIN_RULES}' || chr(10) || 'Avoid: {prompts.PLAIN_AVOID}.' AS prompt, caption AS scene FROM pages""",
)
def scene_prompts(spark, d):
    prompt = prompts.scene_prompt(F.col("caption"), F.col("character_refs"), F.when(F.col("doc_id") % 2 == 0, "flat art"))
    return line_pages(spark, d).select("doc_id", "spread_id", prompt.alias("prompt")).withColumn("scene", T.scene_text(F.col("prompt")))


@query(
    "page_prompts",
    f"""WITH {PAGES} SELECT doc_id, spread_id, array_to_string(['Use case: illustration-story', 'Asset type: children''s picture-book spread illustration for a book', 'Primary request: Create the illustration for spread ' || spread_id || '.', 'Scene/backdrop: ' || caption,
    'Subject: ' || CASE WHEN has_refs THEN 'Ann: a child Visual anchors: red hat, boots. Character reference prompt: p.md.' ELSE '{prompts.SOMEBODY}' END, 'Style/medium: {prompts.PLAIN_ART}',
    'Composition/framing: {prompts.PLAIN_CAMERA}; landscape 3:2 spread; leave calm negative space where a caption can be placed outside the image.', 'Lighting/mood: gentle, emotionally clear, child-safe, warm, readable silhouettes.', 'Color palette: {prompts.PAGE_PALETTE}.', 'Text: no text inside the image.',
    'Constraints: keep recurring characters visually consistent; one clear action; no watermark; no logos; no visible typography; no scary violence.', 'Avoid: {prompts.PLAIN_AVOID}.', '', 'Reader caption context, not to render as text:', '"' || caption || '"', '', 'Source excerpt for grounding, not to render as text:',
    '"' || CASE WHEN source_excerpt = '' THEN caption ELSE source_excerpt END || '"', '', 'Save/import target in a book:', 'assets/images/' || spread_id || '.png', ''], chr(10)) AS prompt FROM pages""",
)
def page_prompts(spark, d):
    ann = prompts.character_line(F.lit("Ann"), F.lit("a child"), F.array(F.lit("red hat"), F.lit("boots")), F.lit(None).cast("string"), F.lit("p.md"))
    seen = F.when(F.size("character_refs") > 0, F.array(ann)).otherwise(F.expr("cast(array() as array<string>)"))
    prompt = prompts.page_prompt("a book", F.col("spread_id"), F.col("caption"), seen, F.col("caption"), F.col("source_excerpt"), F.concat(F.lit("assets/images/"), "spread_id", F.lit(".png")))
    return line_pages(spark, d).select("doc_id", "spread_id", prompt.alias("prompt"))


@query(
    "sheet_prompts",
    f"""SELECT s_suppkey, array_to_string(['Use case: illustration-story', 'Asset type: character reference sheet for a children''s picture-book generator', 'Primary request: Create a clean character reference sheet for ' || s_name || '.', 'Subject: from ' || s_nationkey, 'Visual anchors: hat, ' || s_nationkey, 'Style/medium: {prompts.PLAIN_ART}',
    'Composition/framing: one full-body front view, one side view, and three small expression heads on a simple warm paper background.', 'Lighting/mood: gentle, child-safe, clear, readable.', 'Color palette: {prompts.SHEET_PALETTE}.', 'Text: no text, labels, captions, signatures, or watermark inside the image.',
    'Constraints: the sheet is only for visual consistency; keep the design simple enough to reuse across many story pages.', 'Avoid: {prompts.PLAIN_AVOID}.', '', 'Save/import target in a book:', 'assets/characters/' || s_suppkey || '.png', ''], chr(10)) AS prompt FROM supplier""",
)
def sheet_prompts(spark, d):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    prompt = prompts.sheet_prompt("a book", F.col("s_name"), F.concat(F.lit("from "), nation), F.array(F.lit("hat"), nation), F.concat(F.lit("assets/characters/"), key, F.lit(".png")))
    return table(spark, d, "supplier").select("s_suppkey", prompt.alias("prompt"))


# ---- runs, files, requests -------------------------------------------------------------------------------------------

_AT = "TIMESTAMP '2024-01-15 12:00:00'"
_SEEN = "greatest(created_at, coalesce(updated_at, created_at), coalesce(heartbeat_at, created_at))"


@query("run_resume", f"WITH {_RUNS} SELECT id, CASE WHEN id % 2 = 0 THEN 'b' || id END AS book_run_id FROM r WHERE status IN ('running', 'queued') AND {_AT} - {_SEEN} <= INTERVAL 15 MINUTE ORDER BY {_SEEN} DESC, id LIMIT 25")
def run_resume(spark, d):
    image_runs = _runs(spark, d)
    books = image_runs.where("id % 2 = 0").select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("id"), F.col("id").alias("image_run_id"))
    return runs.to_resume(image_runs, books, F.expr(_AT), 25).select("id", "book_run_id")


@query("run_project", f"WITH {_RUNS} SELECT id, project_path, status FROM r ORDER BY CASE WHEN project_path = '7' AND status IN ('running', 'queued') THEN 0 WHEN project_path = '7' THEN 1 ELSE 3 END, id DESC LIMIT 1")
def run_project(spark, d):
    return runs.run_for_project(_runs(spark, d), "7").select("id", "project_path", "status")


@query("artifact_counts", "SELECT user_id AS run_id, count(*) AS files, count(*) FILTER (event_id % 3 = 0 OR event_id % 11 = 1) AS text_files, epoch_us(max(ts)) AS latest_us, bool_or(event_id % 11 = 1) AS has_text, bool_or(event_id % 3 > 0 AND event_id % 11 = 2) AS has_audit FROM events GROUP BY user_id")
def artifact_counts(spark, d):
    k = F.col("event_id")
    path = F.when(k % 11 == 1, "x/extracted.txt").when(k % 3 == 0, "x/notes.MD").when(k % 11 == 2, "x/page-audit.json").otherwise("x/y.png")
    found = runs.artifact_summary(table(spark, d, "events").select(F.col("user_id").alias("run_id"), path.alias("path"), F.col("ts").cast("timestamp").alias("mtime")))
    return found.select("run_id", "files", "text_files", F.unix_micros("latest").alias("latest_us"), "has_text", "has_audit")


@query(
    "runnable_items",
    """WITH f AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 'paused' ELSE 'running' END AS status FROM events WHERE event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY status DESC) = 1)
    SELECT e.user_id AS run_id, e.event_id AS item FROM (SELECT * FROM events WHERE event_id % 5 > 0) e ASOF LEFT JOIN f ON f.user_id = e.user_id AND f.ts <= e.ts WHERE f.status IS DISTINCT FROM 'paused'""",
)
def runnable_items(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    items = rows.where("event_id % 5 > 0").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item"), "at")
    flags = rows.where("event_id % 5 = 0").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "paused").otherwise("running").alias("status"), "at")
    return runs.runnable_items(items, flags).select("run_id", "item")


@query("request_states", "SELECT user_id AS id, coalesce(arg_max(s, ts) FILTER (s IS NOT NULL), 'queued') AS status, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us FROM (SELECT user_id, ts, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'failed' ELSE 'planned' END AS s FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) GROUP BY user_id")
def request_states(spark, d):
    once = table(spark, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))).where("rn = 1")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "view", "planned")
    found = runs.request_states(once.select(F.col("user_id").alias("id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at")))
    return found.select("id", "status", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("linked_states", "SELECT user_id % 5 AS book_run_id, event_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN 'needs_attention' WHEN 'click' THEN 'paused' ELSE 'drawing' END AS book_status FROM events")
def linked_states(spark, d):
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "ready").when(F.col("event_type") == "error", "stale").when(F.col("event_type") == "click", "paused").otherwise("running")
    links = events.select(F.col("user_id").alias("image_run_id"), (F.col("user_id") % 5).alias("book_run_id")).distinct()
    found = streams.linked_states(events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ts"), status.alias("status")), links)
    return found.select("book_run_id", F.col("ts").alias("event_id"), "book_status")


@query("best_rasters", "SELECT 'p' || p_partkey AS target, CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey || '.png' WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey || '.JPG' WHEN p_partkey % 5 = 0 THEN 'p' || p_partkey || '.webp' END AS raster FROM part")
def best_rasters(spark, d):
    pages = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target"), "p_partkey")
    types = F.array_compact(F.array(F.lit("txt"), F.when(F.col("p_partkey") % 5 == 0, "webp"), F.when(F.col("p_partkey") % 3 == 0, "JPG"), F.when(F.col("p_partkey") % 2 == 0, "png")))
    files = pages.select("target", F.explode(types).alias("t")).select("target", F.concat("target", F.lit("."), "t").alias("path"))
    return work.best_raster(pages.select("target"), files)


@query("missing_assets", "SELECT 'p' || p_partkey AS target FROM part WHERE p_partkey % 4 = 0")
def missing_assets(spark, d):
    targets = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target"), "p_partkey")
    return work.missing_assets(targets.select("target"), targets.where("p_partkey % 4 > 0").select(F.col("target").alias("path")))


@query("redraw_marks", f"WITH {PAGES} SELECT spread_id, CASE WHEN doc_id % 3 = 0 THEN 'needs_redraw' ELSE image_status END AS image_status, CASE WHEN doc_id % 3 = 0 THEN 'blurred' END AS redraw_reason FROM pages")
def redraw_marks(spark, d):
    pages = line_pages(spark, d)
    ids = pages.where("doc_id % 3 = 0").select("spread_id")
    return work.mark_redraw(pages, ids.union(ids), "blurred", F.expr(_AT)).select("spread_id", "image_status", "redraw_reason")


@query("imported_pages", f"WITH {PAGES} SELECT spread_id, CASE WHEN page_number % 3 = 0 THEN 'ready' WHEN page_number % 3 = 1 THEN 'needs_redraw' ELSE image_status END AS image_status FROM pages")
def imported_pages(spark, d):
    pages = line_pages(spark, d)
    checks = pages.where("page_number % 3 < 2").select("spread_id", F.when(F.col("page_number") % 3 == 0, "basic_passed").otherwise("failed").alias("qa_status"))
    return work.imported(pages, checks).select("spread_id", "image_status")


# ---- captions, sinks, texts ------------------------------------------------------------------------------------------


@query("caption_targets", "SELECT CAST(doc_id AS VARCHAR) AS spread_id, CASE WHEN lang = 'fr' THEN 'zh:text:source,en::pending_translation' WHEN lang = 'de' THEN 'ja::pending_translation' ELSE 'en:text:source' END AS lines FROM documents")
def caption_targets(spark, d):
    own = F.when(F.col("lang") == "fr", "zh").otherwise("en")
    option = F.when(F.col("lang") == "fr", "zh-en").when(F.col("lang") == "de", "japanese").otherwise("auto")
    made = merge.caption_lines(F.lit("text"), T.language_profile(option, own), own)
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spread_id"), F.array_join(F.transform(made, lambda x: F.concat_ws(":", x["language"], x["text"], x["source"])), ",").alias("lines"))


@query("deferred_lines", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'said' END AS text, CASE WHEN doc_id % 3 = 0 THEN 'pending_translation' ELSE 'translated' END AS source, doc_id % 3 = 0 OR doc_id % 2 = 0 AS needs_translation FROM documents")
def deferred_lines(spark, d):
    k = F.col("doc_id")
    return merge.reset_deferred(table(spark, d, "documents").select("doc_id", F.lit("said").alias("text"), F.when(k % 3 == 0, "deferred_translation").otherwise("translated").alias("source"), (k % 2 == 0).alias("needs_translation")))


@query("localisation", "SELECT c_nationkey AS doc_id, count(*) AS batches, count(*) FILTER (c_acctbal > 500 * c_nationkey) AS done, CASE WHEN count(*) FILTER (c_acctbal > 500 * c_nationkey) = count(*) THEN 'completed' WHEN count(*) FILTER (c_acctbal > 500 * c_nationkey) > 0 THEN 'partial' ELSE 'failed' END AS status FROM customer GROUP BY c_nationkey")
def localisation(spark, d):
    return merge.localisation_status(table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), (F.col("c_acctbal") > 500 * F.col("c_nationkey")).alias("ok")))


@query("book_bodies", f"""WITH {PAGES} SELECT doc_id, count(*) AS n_pages, sha256(string_agg('<section class="page"><p class="chapter">A &amp; B</p><p class="caption">' || replace({_escape_sql('caption')}, '''', '&apos;') || '</p></section>', '' ORDER BY page_number)) AS body_sha256 FROM pages GROUP BY doc_id""")
def book_bodies(spark, d):
    found = sinks.book_bodies(line_pages(spark, d).withColumns({"title": F.lit("T"), "chapter_title": F.lit("A & B")}))
    return found.select("doc_id", "n_pages", F.sha2("body", 256).alias("body_sha256"))


@query("epub_files")
def epub_files(spark, d):
    """Containers of all books; a test opens them."""
    books = sinks.book_bodies(line_pages(spark, d).withColumns({"title": F.lit("T & \"U\""), "chapter_title": F.lit("Chapter")}))
    return sinks.epub_books(books).select("doc_id", F.octet_length("epub").alias("n_bytes"), F.sha2("epub", 256).alias("epub_sha256"))


@query("review_lines", rf"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, left(list_aggregate(list_transform(string_split(line, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN c WHEN strip_accents(c) <> c THEN strip_accents(c) || '?' ELSE '?' END), 'string_agg', ''), 92) AS line, pos // 34 AS review_page FROM lines")
def review_lines(spark, d):
    return sinks.review_pages(lines(spark, d).withColumn("line_no", F.col("pos"))).select("doc_id", "pos", "line", "review_page")


@query("review_pdfs")
def review_pdfs(spark, d):
    """PDFs of all books; a test reads their pages."""
    made = sinks.review_pdfs(lines(spark, d).withColumn("line_no", F.col("pos")))
    return made.select("doc_id", F.octet_length("pdf").alias("n_bytes"), F.sha2("pdf", 256).alias("pdf_sha256"))


@query("wide_slugs", r"SELECT doc_id, 'chapter-12-fine-' || doc_id || CASE WHEN lang = 'fr' THEN '-x2' ELSE '' END AS slug FROM documents")
def wide_slugs(spark, d):
    """Full-width letters, ligatures and raised digits are folded to their plain forms."""
    title = F.concat(F.lit(" Ｃｈａｐｔｅｒ　１２: ﬁne "), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", " x²").otherwise("!"))
    return table(spark, d, "documents").select("doc_id", T.slug(title, fold=True).alias("slug"))


_LINE_NAME = "CASE pos % 7 WHEN 0 THEN 'Mira' WHEN 1 THEN 'grandpa' WHEN 2 THEN 'NIKO' ELSE 'N' || pos END"
_ACCENT = f"({list(T.ACCENTS)!r})[CAST(pos % {len(T.ACCENTS)} AS INTEGER) + 1]"
_KNOWN_SAID = " ".join(f"WHEN '{n}' THEN '{said}'" for n, (said, _) in T.KNOWN_LOOKS.items())
_KNOWN_ANCHORS = " ".join(f"WHEN '{n}' THEN '{', '.join(anchors)}'" for n, (_, anchors) in T.KNOWN_LOOKS.items())


@query(
    "page_lines",
    f"""WITH {LINES}, n AS (SELECT *, {_LINE_NAME} AS name FROM lines)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, lang IN ('zh', 'ja') OR regexp_matches(lower(lang), 'zh|ch|cn|ja|jp') AS cjk,
           CASE lower(name) {_KNOWN_SAID} ELSE name || ' as a recurring picture-book character with a stable outfit, ' || {_ACCENT} || ' accent color, readable silhouette, and clear facial expression.' END AS described,
           CASE lower(name) {_KNOWN_ANCHORS} ELSE 'stable silhouette, ' || {_ACCENT} || ' color accent, clear facial expression' END AS anchors FROM n""",
)
def page_lines(spark, d):
    name, pos = F.expr(_LINE_NAME), F.col("pos")
    return lines(spark, d).select("doc_id", "pos", T.expects_cjk(F.col("lang")).alias("cjk"), T.description(name, pos).alias("described"), F.array_join(T.visual_anchors(name, pos), ", ").alias("anchors"))


# ---- options, replies and logs over whole tables ---------------------------------------------------------------------


@query("chapter_modes", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'full-coverage' WHEN 1 THEN 'full-coverage' WHEN 2 THEN CASE WHEN c_custkey % 5 > 1 THEN 'auto' ELSE 'heuristic' END WHEN 3 THEN CASE WHEN c_custkey % 5 > 1 THEN 'auto' ELSE 'heuristic' END ELSE 'fixed' END AS mode FROM customer")
def chapter_modes(spark, d):
    k = F.col("c_custkey")
    option = F.element_at(F.array(F.lit(" "), F.lit("Full-Book"), F.lit("自动"), F.lit(" CODEX-auto "), F.lit("4"), (k % 9).cast("string")), (k % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", P.plan_mode(option, k % 5 > 1).alias("mode"))


@query(
    "language_options",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'bilingual' WHEN 4 THEN CASE WHEN s = 'en' THEN 'single' ELSE 'bilingual' END ELSE 'single' END AS "mode", CASE c_custkey % 5 WHEN 0 THEN s WHEN 1 THEN 'zh' WHEN 2 THEN 'ja' WHEN 3 THEN s ELSE s END AS "primary",
    CASE c_custkey % 5 WHEN 0 THEN 'Auto (' || n || ')' WHEN 1 THEN '中文 + English' WHEN 2 THEN '日本語' WHEN 3 THEN n ELSE CASE WHEN s = 'en' THEN 'English' ELSE n || ' + English' END END AS label
    FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'zh' END AS s, CASE WHEN c_nationkey % 2 = 0 THEN 'English' ELSE '中文' END AS n FROM customer)""",
)
def language_options(spark, d):
    k, source = F.col("c_custkey"), F.when(F.col("c_nationkey") % 2 == 0, "en").otherwise("zh")
    option = F.element_at(F.array(F.lit("Auto"), F.lit("chinese/en-gb"), F.lit("日文"), F.lit("xx,auto"), F.concat(source, F.lit("+English"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.language_profile(option, source).alias("p")).select("c_custkey", "p.mode", "p.primary", "p.label")


@query("loose_replies", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '[' || doc_id || ',2]' END AS items FROM documents")
def loose_replies(spark, d):
    """Whole texts as the words around an answer; a mark in braces of its own would be an answer too, so braces become brackets."""
    k, words = F.col("doc_id").cast("string"), F.translate(F.col("text"), "{}`[", "()'(")
    reply = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" ["), k, F.lit(",2]"))).when(F.col("doc_id") % 4 == 1, F.concat(words, F.lit('\n```json\n{"spreads": ['), k, F.lit(',2]}\n``` '), words)).when(F.col("doc_id") % 4 == 2, F.concat(words, F.lit(' {"chapters": ['), k, F.lit(",2]} "), words)).otherwise(words)
    return table(spark, d, "documents").select("doc_id", readers.json_array(reply, "chapters", "spreads").alias("items"))


@query("logged_images", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/tmp/g/' || doc_id || '.png|/x/' || doc_id || '.jpeg' END AS paths FROM documents")
def logged_images(spark, d):
    """Paths of images named in whole texts, whose own slashes are taken out first."""
    k, words = F.col("doc_id").cast("string"), F.translate(F.col("text"), "/", " ")
    log = F.concat(words, F.lit(" saved /tmp/g/"), k, F.lit(".png, then '/x/"), k, F.lit(".jpeg' and /tmp/g/"), k, F.lit(".png). "), words)
    return table(spark, d, "documents").select("doc_id", F.array_join(work.log_paths(F.when(F.col("doc_id") % 3 > 0, log).otherwise(words)), "|").alias("paths"))


@query("chapter_numbers", "SELECT doc_id, doc_id % 120 AS parsed FROM documents")
def chapter_numbers(spark, d):
    """Numbers written in Chinese up to 99 and in digits beyond, read from titles."""
    title = F.concat(F.lit("第"), T.chinese_numeral(F.col("doc_id") % 120), F.lit("章 "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.chinese_ordinal(title).alias("parsed"))


@query("caption_fixes", """WITH c AS (SELECT CAST(doc_id % 300 AS VARCHAR) AS spread_id, 'fixed ' || doc_id AS new FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id DESC) = 1)
    SELECT CAST(doc_id AS VARCHAR) AS spread_id, coalesce(new, 'caption ' || doc_id) AS caption, CASE WHEN new IS NOT NULL THEN 'caption ' || doc_id END AS original_caption, CASE WHEN new IS NOT NULL THEN 'needs_redraw' ELSE 'ready' END AS image_status FROM documents d LEFT JOIN c ON c.spread_id = CAST(d.doc_id AS VARCHAR)""")  # fmt: skip
def caption_fixes(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("spread_id"), F.concat(F.lit("caption "), F.col("doc_id").cast("string")).alias("caption"), F.lit(None).cast("string").alias("original_caption"), F.lit("ready").alias("image_status"))
    fixes = docs.select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 300).cast("string").alias("id"), F.concat(F.lit('"fixed  '), F.col("doc_id").cast("string"), F.lit('"')).alias("caption"))
    return merge.apply_corrections(pages, fixes).select("spread_id", "caption", "original_caption", "image_status")


# ---- outcomes, recovery and states handed on --------------------------------------------------------------------------


@query(
    "settle_outcomes",
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN event_id % 7 > 0 THEN nullif(CAST(floor(value / 20) AS BIGINT), 0) END AS size FROM events),
    w AS (SELECT *, last_value(size IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, size NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(ts) OVER (PARTITION BY path) AS began FROM p),
    o AS (SELECT *, CASE WHEN ts > began + INTERVAL 12 HOUR THEN CASE WHEN before IS NULL THEN 'timeout' ELSE 'timeout_with_file' END WHEN size = before THEN 'settled' END AS outcome FROM w)
    SELECT path, coalesce(CASE outcome WHEN 'settled' THEN size ELSE before END, 0) AS size, outcome FROM o WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts, outcome = 'settled') = 1""",
)
def settle_outcomes(spark, d):
    size = F.when(F.col("event_id") % 7 > 0, F.floor(F.col("value") / 20).cast("long"))
    polls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), size.alias("size"))
    return runs.settle_outcomes(polls, "12 HOURS")


@query(
    "handed_on_states",
    """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'stale' ELSE 'running' END AS status FROM events)
    SELECT user_id % 5 AS book_run_id, event_id, CASE status WHEN 'completed' THEN 'ready_for_revision' WHEN 'failed' THEN 'failed' ELSE 'drawing' END AS status, CASE WHEN status = 'running' THEN least(98, 20 + CAST(floor(event_id % 101 * 0.78 + 0.5) AS BIGINT)) ELSE 100 END AS progress FROM e WHERE status <> 'stale'""",
)
def handed_on_states(spark, d):
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "stale").otherwise("running")
    links = events.select(F.col("user_id").alias("image_run_id"), (F.col("user_id") % 5).alias("book_run_id")).distinct()
    found = runs.handed_on(events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ts"), status.alias("status"), (F.col("event_id") % 101).alias("progress")), links)
    return found.select("book_run_id", F.col("ts").alias("event_id"), "status", "progress")


@query(
    "recover_as_of",
    f"""WITH {_RUNS}, f AS (SELECT CAST(user_id AS VARCHAR) AS project_path, '/x/f' || event_id || '.png' AS path, ts AS mtime FROM events WHERE event_id % 6 > 0),
    g AS (SELECT project_path, mtime, min(path) AS path FROM f GROUP BY ALL), t AS (SELECT *, created_at + to_minutes(5 * (id % 7)) AS upto FROM r),
    n AS (SELECT t.*, g.mtime, g.path FROM t ASOF LEFT JOIN g ON g.project_path = t.project_path AND g.mtime <= t.upto),
    l AS (SELECT id, max(mtime) AS mtime, arg_min(path, (-epoch_us(mtime), path)) AS path FROM (SELECT t.id, t.upto, unnest(['/x/f' || (id - id % 13) || '.png', '/x/f' || (id + 1) || '.png']) AS path FROM t) JOIN f USING (path) WHERE mtime <= upto GROUP BY id),
    b AS (SELECT n.*, l.mtime AS log_mtime, l.path AS log_path, coalesce(l.mtime >= created_at - INTERVAL 60 SECOND AND (n.mtime IS NULL OR l.mtime >= n.mtime), false) AS from_log FROM n LEFT JOIN l USING (id))
    SELECT id AS run_id, CASE WHEN from_log THEN log_path WHEN mtime >= created_at - INTERVAL 60 SECOND THEN path END AS path, from_log FROM b""",
)
def recover_as_of(spark, d):
    file = lambda k: F.concat(F.lit("/x/f"), k.cast("string"), F.lit(".png"))
    k = F.col("event_id")
    files = table(spark, d, "events").select(F.col("user_id").cast("string").alias("project"), file(k).alias("path"), F.col("ts").cast("timestamp").alias("mtime"), F.when(k % 6 > 0, 10).otherwise(0).alias("size"))
    log = F.concat(F.lit("saved "), file(F.col("id") - F.col("id") % 13), F.lit(", then ("), file(F.col("id") + 1), F.lit(")."))
    asked = _runs(spark, d).select(F.col("id").alias("run_id"), F.col("project_path").alias("project"), F.col("created_at").alias("started"), (F.col("created_at") + F.expr("INTERVAL 5 MINUTES") * (F.col("id") % 7)).alias("at"), log.alias("log"))
    return work.recover_as_of(asked, files)


@query(
    "changed_pages",
    f"""WITH {PAGES}, n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND page_number % 11 = 5 THEN chapter_idx + 1 ELSE chapter_idx END AS chapter_idx, spread_id, caption, CASE WHEN doc_id % 10 = 3 AND page_number % 7 = 2 THEN NULL ELSE asset_path END AS asset_path FROM pages WHERE NOT (doc_id % 10 = 6 AND page_number % 5 = 1)),
    o AS (SELECT doc_id, chapter_idx, spread_id, caption, asset_path FROM pages WHERE NOT (doc_id % 10 = 9 AND page_number % 4 = 0))
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.chapter_idx, n.chapter_idx) AS chapter_idx, coalesce(o.spread_id, n.spread_id) AS spread_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.chapter_idx = n.chapter_idx AND o.spread_id = n.spread_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.caption <> n.caption OR o.asset_path IS DISTINCT FROM n.asset_path""",
)
def changed_pages(spark, d):
    pages, touched = line_pages(spark, d), F.col("doc_id") % 10 == 3
    moved = F.when(touched & (F.col("page_number") % 11 == 5), F.col("chapter_idx") + 1).otherwise(F.col("chapter_idx"))
    new = pages.where("NOT (doc_id % 10 = 6 AND page_number % 5 = 1)").withColumns({"chapter_idx": moved, "asset_path": F.when(~(touched & (F.col("page_number") % 7 == 2)), F.col("asset_path"))})
    return merge.changed_pages(pages.where("NOT (doc_id % 10 = 9 AND page_number % 4 = 0)"), new, ["caption", "asset_path"])


def _numeral_sql(k: str) -> str:
    digit = lambda x: f"substring('一二三四五六七八九', {x}, 1)"
    ones = f"CASE WHEN ({k}) % 10 > 0 THEN {digit(f'({k}) % 10')} ELSE '' END"
    return f"CASE WHEN ({k}) > 99 THEN CAST({k} AS VARCHAR) WHEN ({k}) < 10 THEN {digit(k)} WHEN ({k}) < 20 THEN '十' || {ones} ELSE {digit(f'({k}) // 10')} || '十' || {ones} END"


@query(
    "chapters_renumbered",
    rf"""WITH {LINES}, p AS (SELECT doc_id, pos // 4 AS i, {trim_sql("string_agg('~ ' || line, chr(10) ORDER BY pos)")} AS text FROM lines GROUP BY ALL),
    q AS (SELECT doc_id, i, 'T' || (i + 1) AS name, text FROM p UNION ALL SELECT doc_id, max(i) + 1, 'End', 'all' FROM p GROUP BY doc_id), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM q WHERE text <> '~')
    SELECT doc_id, CAST(i AS INTEGER) AS chapter_idx, '第' || CASE WHEN n >= 4 THEN {_numeral_sql("i + 1")} WHEN name = 'End' THEN '九十九' WHEN i % 4 = 1 THEN '叫' WHEN i % 4 = 2 THEN {_numeral_sql("i + 5")} ELSE {_numeral_sql("i + 1")} END || '章 ' || name AS title, text FROM n""",
)
def chapters_renumbered(spark, d):
    """Chapters under Chinese numbers, every fourth misread and every fourth wrong; where there are four and more, they are set right."""
    i = F.floor(F.col("pos") / 4)
    said = F.when(i % 4 == 1, "叫").when(i % 4 == 2, T.chinese_numeral(i + 5)).otherwise(T.chinese_numeral(i + 1))
    heading = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("第"), said, F.lit("章 T"), (i + 1).cast("string"), F.lit("\n"))).otherwise("")
    last = F.when(F.col("pos") == F.col("n") - 1, "\n第九十九章 End\nall").otherwise("")
    parts = lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(heading, F.lit("~ "), "line", last).alias("t")))).alias("parts"))
    docs = parts.select("doc_id", F.array_join(F.transform("parts", lambda x: x["t"]), "\n").alias("text"))
    return segments.split_chapters(docs).select("doc_id", "chapter_idx", "title", "text")


@query(
    "print_round_trip",
    rf"""WITH {LINES}, f AS (SELECT doc_id, pos, left(list_aggregate(list_transform(string_split(line, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN c WHEN strip_accents(c) <> c THEN strip_accents(c) || '?' ELSE '?' END), 'string_agg', ''), 92) AS line FROM lines)
    SELECT doc_id, CAST(pos // 34 AS INTEGER) AS page_index, rtrim(ltrim(string_agg(coalesce(line, ''), chr(10) ORDER BY pos), chr(10)), chr(10)) AS text FROM f GROUP BY ALL""",
)
def print_round_trip(spark, d):
    """Every text printed as a PDF and read again page by page."""
    rows = lines(spark, d).withColumn("line_no", F.col("pos"))
    prints = sinks.review_pdfs(rows).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pdf").alias("content"))
    return readers.pdf_pages(prints).select(F.col("doc_id").cast("long").alias("doc_id"), "page_index", "text")


def _hash_sql(x: str) -> str:
    """``numbers.hash32`` of a text of letters below 65536."""
    return f"(SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT list_reduce([CAST(0 AS BIGINT)] || list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h))"


@query(
    "placeholder_colours",
    f"""WITH {PAGES}, h AS (SELECT doc_id, spread_id, abs({_hash_sql("spread_id")}) AS s, abs({_hash_sql("('ch-' || chapter_idx)")}) AS c FROM pages)
    SELECT doc_id, spread_id, ({list(sinks.PALETTE)!r})[s % 5 + 1] AS accent, ({list(sinks.PALETTE)!r})[(c + 2) % 5 + 1] AS second FROM h""",
)
def placeholder_colours(spark, d):
    chapter = F.concat(F.lit("ch-"), F.col("chapter_idx").cast("string"))
    return line_pages(spark, d).select("doc_id", "spread_id", sinks.placeholder_colours(F.col("spread_id"), chapter).alias("c")).select("doc_id", "spread_id", "c.accent", "c.second")


_CAPTION_LINES = "array(named_struct('language', 'en', 'label', 'EN', 'text', caption, 'needs_translation', false), named_struct('language', 'fr', 'label', '', 'text', if(page_number % 3 = 0, 'le ' || caption, ''), 'needs_translation', page_number % 2 = 0))"
_LINE_SPANS = """'<span class="line" lang="en"><b class="label">EN</b>' || x || '</span><span class="line" lang="fr">' || CASE WHEN page_number % 3 = 0 THEN 'le ' || x WHEN page_number % 2 = 0 THEN 'Translation pending' ELSE x END || '</span>'"""


@query(
    "caption_bodies",
    f"""WITH {PAGES}, q AS (SELECT *, replace({_escape_sql('caption')}, '''', '&apos;') AS x FROM pages),
    e AS (SELECT *, CASE WHEN asset_path IS NULL THEN '' ELSE '<figure><img src="images/' || spread_id || '.png" alt="' || x || '"/></figure>' END AS figure FROM q)
    SELECT doc_id, count(*) AS n_pages, sha256(string_agg('<section class="page">' || figure || '<p class="chapter">C</p><p class="caption">' || {_LINE_SPANS} || '</p></section>', '' ORDER BY page_number)) AS body_sha256 FROM e GROUP BY doc_id""",
)
def caption_bodies(spark, d):
    """Books with pictures and a caption line for each language."""
    pages = line_pages(spark, d).withColumns({"title": F.lit("T"), "chapter_title": F.lit("C"), "caption_lines": F.expr(_CAPTION_LINES), "image_href": sinks.image_href(F.col("spread_id"), F.col("asset_path"))})
    return sinks.book_bodies(pages).select("doc_id", "n_pages", F.sha2("body", 256).alias("body_sha256"))


@query(
    "book_sites",
    f"""WITH {PAGES}, e AS (SELECT *, {_escape_sql('caption')} AS x FROM pages),
    r AS (SELECT doc_id, string_agg('<section id="' || spread_id || '"><h2>C' || chapter_idx || '</h2>' || CASE WHEN asset_path IS NULL THEN '<p class="missing">Image pending</p>' ELSE '<img src="' || asset_path || '" alt="' || x || '">' END || '<p><span class="line" lang="">' || x || '</span></p><small>' || page_number || '</small></section>', '' ORDER BY page_number) AS html FROM e GROUP BY doc_id),
    s AS (SELECT doc_id, string_agg('<tr><td>' || page_number || '</td><td>' || spread_id || '</td><td>' || coalesce(image_status, 'missing') || '</td><td>' || concat_ws(', ', CASE WHEN asset_path IS NULL THEN 'image' END, CASE WHEN caption = '' THEN 'caption' END) || '</td></tr>', '' ORDER BY page_number) AS html FROM e GROUP BY doc_id),
    c AS (SELECT doc_id, chapter_idx, arg_min(spread_id, page_number) AS first, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT doc_id, string_agg('<li><a href="reader.html#' || first || '">C' || chapter_idx || '</a> (' || n || ')</li>', '' ORDER BY chapter_idx) AS html FROM c GROUP BY doc_id),
    a AS (SELECT doc_id, 'reader.html' AS path, html FROM r UNION ALL SELECT doc_id, 'studio.html', '<table>' || html || '</table>' FROM s UNION ALL SELECT doc_id, 'index.html', '<ol>' || html || '</ol>' FROM i)
    SELECT doc_id, path, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>B' || doc_id || '</title></head><body><h1>B' || doc_id || '</h1>' || html || '</body></html>' AS html FROM a""",
)
def book_sites(spark, d):
    named = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return sinks.book_site(line_pages(spark, d).withColumns({"title": named("B", "doc_id"), "chapter_title": named("C", "chapter_idx")}))


# ---- sources, sinks and lookups over whole tables ----------------------------------------------------------------------


@query(
    "section_line_numbers",
    rf"""WITH s AS (SELECT source AS book, doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'T' || doc_id ELSE split_part(text, ' ', 1) END AS title, text FROM documents),
    b AS (SELECT book, doc_id, CASE WHEN title = '' OR starts_with(text, title) THEN text ELSE title || chr(10) || chr(10) || text END AS body FROM s),
    n AS (SELECT *, len(string_split(body, chr(10))) AS n FROM b), w AS (SELECT *, sum(n + 1) OVER (PARTITION BY book ORDER BY doc_id) - 1 AS upto FROM n)
    SELECT book, doc_id, sha256(body) AS body_sha256, CAST(upto - n + 1 AS INTEGER) AS start_line, CAST(upto AS INTEGER) AS end_line FROM w""",
)
def section_line_numbers(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).otherwise(F.substring_index("text", " ", 1))
    sections = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("section_idx"), title.alias("title"), "text")
    return readers.section_lines(sections).select(F.col("doc_id").alias("book"), F.col("section_idx").alias("doc_id"), F.sha2("body", 256).alias("body_sha256"), "start_line", "end_line")


_NAMED = ("the", "La", "und")


@query(
    "whole_word_counts",
    f"""WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, {", ".join(f"CAST(len(regexp_extract_all(' ' || regexp_replace(lower(line), '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g') || ' ', '[^\\p{{L}}\\p{{N}}]{n.lower()}[^\\p{{L}}\\p{{N}}]')) AS BIGINT) AS n{i}" for i, n in enumerate(_NAMED))} FROM lines""",
)
def whole_word_counts(spark, d):
    """How often names stand in a line as whole words, all of them found in one pass."""
    rows = lines(spark, d).select(F.struct("doc_id", "pos").alias("doc_id"), F.col("line").alias("text"))
    counted = entities.name_counts(rows.withColumn("doc_id", F.to_json("doc_id")), [(n,) for n in _NAMED])
    key = F.from_json("doc_id", "doc_id long, pos int")
    return counted.select(key.alias("k"), "counts").select("k.doc_id", "k.pos", *[F.get("counts", i).alias(f"n{i}") for i in range(3)])


@query("chapter_maps_read", f"WITH {LINES} SELECT doc_id, CAST(pos // 5 AS INTEGER) AS pos, 'C' || (pos // 5) AS title, CAST(pos + 1 AS INTEGER) AS start_line, CAST(least(pos + 5, n) AS INTEGER) AS end_line FROM lines WHERE pos % 5 = 0")
def chapter_maps_read(spark, d):
    """Chapter maps of all texts, written as JSON and read again: bare arrays and objects, long and short names."""
    rows = lines(spark, d).where("pos % 5 = 0").select("doc_id", "pos", F.concat(F.lit("C"), F.floor(F.col("pos") / 5).cast("string")).alias("title"), (F.col("pos") + 1).alias("a"), F.least(F.col("pos") + 5, "n").alias("b"))
    entry = lambda a, b: F.struct("pos", "title", F.col("a").alias(a), F.col("b").alias(b))
    maps = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry("startLine", "endLine"))).alias("long"), F.array_sort(F.collect_list(entry("start", "end"))).alias("short"))
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("long").alias("chapters"), F.lit("m").alias("method")))).otherwise(F.to_json("short"))
    written = stage(maps.select("doc_id", text.alias("value")), "maps")
    return readers.chapter_maps(written).select("doc_id", "pos", "title", "start_line", "end_line")


@query("artifacts_written", f"WITH {PAGES} SELECT doc_id, page_number, spread_id, caption, image_status FROM pages")
def artifacts_written(spark, d):
    """All pages written as an artifact, kept in a snapshot, and read again."""
    folder = shared_path(spark, "artifacts")
    sinks.write_artifacts({"pages": line_pages(spark, d).select("doc_id", "page_number", "spread_id", "caption", "image_status")}, folder)
    kept = sinks.snapshot(spark.read.schema("doc_id long, page_number int, spread_id string, caption string, image_status string").json(f"{folder}/pages"), f"{folder}/kept", "1")
    return spark.read.parquet(kept)


@query("jobs_written", f"WITH {PAGES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS BIGINT) AS seq, spread_id AS id, 30 + row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS priority FROM pages WHERE image_provider = 'local' AND image_status IS DISTINCT FROM 'ready'")
def jobs_written(spark, d):
    """The work queue of pages as lines of JSON, read again."""
    pages = work.pending_pages(line_pages(spark, d).withColumn("image_provider", F.when((F.col("page_number") - 1) % 5 < 4, "local").otherwise("remote")))
    nobody = pages.select("doc_id", F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit("").alias("reference_status")).where("false")
    folder = shared_path(spark, "jobs")
    sinks.write_jobs(work.work_queue(nobody, pages), folder)
    return spark.read.schema("doc_id long, seq long, id string, priority long").json(folder)


@query("pages_found", f"WITH {PAGES}, a AS (SELECT DISTINCT 'sp-' || doc_id || '-' || (doc_id % 7) AS spread_id FROM documents) SELECT p.doc_id, p.spread_id, p.caption, p.chapter_idx FROM pages p JOIN a USING (spread_id)")
def pages_found(spark, d):
    """Point lookups of pages by id, many at once."""
    asked = table(spark, d, "documents").select(F.concat(F.lit("sp-"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("spread_id"))
    return work.find_pages(line_pages(spark, d), asked).select("doc_id", "spread_id", "caption", "chapter_idx")


@query("lines_regrouped", f"WITH {LINES} SELECT doc_id, lang, source, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM lines GROUP BY ALL")
def lines_regrouped(spark, d):
    """Texts taken apart by line and put together again in their order."""
    rows = lines(spark, d).groupBy("doc_id", "lang", "source").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    return rows.select("doc_id", "lang", "source", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("text"), F.size("parts").cast("long").alias("n_lines"))


_SECTION = "'T' || chr(10) || chr(10) || string_agg('Chapter ' || chapter_idx || chr(10) || chr(10) || caption, chr(10) || chr(10) || chr(10) ORDER BY page_number)"


@query("books_unpacked", f"WITH {PAGES}, b AS (SELECT doc_id, {_SECTION} AS text FROM pages GROUP BY doc_id), n AS (SELECT doc_id, {normal_sql('text')} AS text FROM b) SELECT doc_id, 0 AS section_idx, 'OEBPS/chapter-01.xhtml' AS file, 'T' AS title, text, CAST(length(text) AS BIGINT) AS char_count FROM n WHERE length(text) >= 20")
def books_unpacked(spark, d):
    """Every text made into an EPUB, and its sections read again from the container."""
    chapter = F.concat(F.lit("Chapter "), F.col("chapter_idx").cast("string"))
    books = sinks.epub_books(sinks.book_bodies(line_pages(spark, d).withColumns({"title": F.lit("T"), "chapter_title": chapter})))
    sections = readers.epub_sections(books.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("epub").alias("content")))
    return sections.select(F.col("doc_id").cast("long").alias("doc_id"), "section_idx", "file", "title", "text", "char_count")


@query("documents_read", f"SELECT doc_id, sha256({normal_sql('text')}) AS text_sha256, 'txt' AS source_format, 'utf8' AS extraction_method FROM documents WHERE {normal_sql('text')} <> ''")
def documents_read(spark, d):
    """Every text written as a file of its own and read again."""
    folder = shared_path(spark, "texts")
    sinks.write_texts(table(spark, d, "documents"), folder)
    documents, _ = readers.read_documents(spark, folder)
    return documents.select(F.regexp_extract("doc_id", r"doc_id=(-?\d+)[./]", 1).cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "source_format", "extraction_method")


@query("files_listed", "SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS length FROM documents")
def files_listed(spark, d):
    """A folder with a file for each text, listed without reading any."""
    folder = shared_path(spark, "listed")
    sinks.write_texts(table(spark, d, "documents"), folder)
    return readers.list_files(spark, folder, "*.txt").select(F.regexp_extract("path", r"doc_id=(-?\d+)[./]", 1).cast("long").alias("doc_id"), "length")


@query("newest_images", f"SELECT 'f' || event_id AS path, CAST(row_number() OVER (ORDER BY ts, 'f' || event_id DESC) AS BIGINT) AS at FROM (SELECT * FROM events WHERE ts >= {_AT} - INTERVAL 3 DAY ORDER BY ts DESC, 'f' || event_id LIMIT 24)")
def newest_images(spark, d):
    """The newest 24 files since a time, oldest first."""
    files = table(spark, d, "events").where(F.col("ts") >= F.expr(f"{_AT} - INTERVAL 3 DAY")).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("mtime"))
    return work.newest_files(files, 24).select("path", "at")
