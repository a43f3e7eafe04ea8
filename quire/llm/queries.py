"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chats import chat_digests, format_chats, read_chats
from quire.llm.exact_dedup import exact_duplicates
from quire.llm.language import identify_languages
from quire.llm.licenses import scan_licenses
from quire.llm.merkle import check_proofs, leaf_digest, merkle_manifest, proof_digest
from quire.llm.mixing import mix_sources
from quire.llm.packing import pack_documents
from quire.llm.pii import KINDS, joined, personal_data
from quire.llm.prefixes import prefix_trie
from quire.llm.quality import quality_scores
from quire.llm.simhash import simhash_components
from quire.llm.suffixes import repeated_strings
from quire.llm.topk import top_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_neardup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op5_pii_boosting")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def target_weight(source: str | None, rows: int) -> float:
    """Target weights stand in a table by source in practice; here they follow from the name, from 1 to 8 times the root of the source's size."""
    return rows**0.5 * (1 + zlib.crc32((source or "").encode()) % 8)


@query("op10_pfair_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), target_weight).select("doc_id", "source", "mix_phase", "mix_slot", "mix_row")


@query(
    "op6_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    p AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    named = F.transform("hits", lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string")))
    return found.select("doc_id", "license", "score", F.size("hits").cast("long").alias("n_hits"), F.array_join(named, ",").alias("hits"))


@query("op9_language_fusion")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


# ---- manifest --------------------------------------------------------------------------------------------------------


def crc32_sql(x: str) -> str:
    """The unsigned CRC-32 of a text of ASCII letters, bit by bit."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def manifest_sql(levels: int = 10) -> str:
    """Trees of up to 8 ** levels leaves, with a step of the proof for each level."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def tree(name: str, first: str) -> list[str]:
        parts = [f"{name}0 AS ({first})"]
        for i in range(levels):
            parts.append(
                f"{name}{i + 1} AS (SELECT t, i // 8 AS i, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CASE WHEN max(n) = 1 THEN '' ELSE string_agg(h, '' ORDER BY i) END AS kids, (max(n) + 7) // 8 AS n FROM {name}{i} GROUP BY t, i // 8)"
            )
        return parts

    def walk(name: str, start: str) -> str:
        """before0, after0 and so on: the siblings at each level, null where the tree was through."""
        at = lambda i: f"CAST(({start} // {8**i}) % 8 AS BIGINT) * 64"
        return ", ".join(f"{name}{i + 1}.kids[1:{at(i)}] AS {name}_before{i}, {name}{i + 1}.kids[{at(i)} + 65:] AS {name}_after{i}, {name}{i + 1}.kids <> '' AS {name}_has{i}" for i in range(levels))

    def joins(name: str, key: str, start: str) -> str:
        return " ".join(f"JOIN {name}{i + 1} ON {name}{i + 1}.t = {key} AND {name}{i + 1}.i = {start} // {8 ** (i + 1)}" for i in range(levels))

    def folds(first: str) -> list[str]:
        steps, column, source = [], first, "p"
        for name in ("a", "b"):
            for i in range(levels):
                steps.append(f"{first}_{name}{i} AS (SELECT * EXCLUDE ({column}), CASE WHEN {name}_has{i} THEN sha256({name}_before{i} || {column} || {name}_after{i}) ELSE {column} END AS {column} FROM {source})")
                source = f"{first}_{name}{i}"
        return steps

    siblings = " || ".join(f"{name}_before{i} || {name}_after{i}" for name in ("a", "b") for i in range(levels))
    parts = [
        f"""d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf("text")} END AS moved FROM documents)""",
        "l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        *tree("a", "SELECT t, i, leaf AS h, n FROM l"),
        *tree("b", f"SELECT 0 AS t, t - 1 AS i, h, (SELECT count(DISTINCT t) FROM l) AS n FROM a{levels}"),
        f"p AS (SELECT l.doc_id, l.leaf, l.moved, a{levels}.h AS subroot, b{levels}.h AS root, {walk('a', 'l.i')}, {walk('b', '(l.t - 1)')} FROM l {joins('a', 'l.t', 'l.i')} {joins('b', '0', '(l.t - 1)')})",
        *folds("moved"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, moved AS folded_root, moved = root AS verified FROM moved_b{levels - 1}"


@query("op11_merkle_manifest", manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(chosen, leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered]))
    proofs = merkle_manifest(docs, also={"tampered": tampered}).proofs
    checked = check_proofs(proofs.withColumn("found", F.coalesce("tampered", "leaf")), "found")
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


# ---- conversations ---------------------------------------------------------------------------------------------------

#: A conversation whose texts hold the template's own marks and its escape.
MARKED = r"\### Assistant: </turn> ok"
_TIE = "sha256(strlen(role) || ':' || role || text)"


@query(
    "op12_chat_formatting",
    rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'),
    t AS (SELECT *, {_TIE} AS tie, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256, CAST(sum(length(learnt)) AS BIGINT) AS loss_chars,
           sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, tie)) AS loss_sha256,
           CAST(sum(length('### : </turn>' || chr(10)) + length(regexp_replace(role, '(\\|:|</turn>)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</turn>)', '\\\1', 'g'))
               + coalesce(list_sum(list_transform(regexp_extract_all(role, '#+') || regexp_extract_all(text, '#+'), lambda x: greatest(length(x) - 2, 0))), 0)) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chat_digests(read_chats(format_chats(turns)))


@query(
    "op13_conversation_trie",
    rf"""
    WITH w AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, {_TIE} AS tie, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TIE}) AS k FROM w),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS first, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM w)),
    r AS (
        SELECT c.conv_id, 0 AS part, k, tie, words FROM c JOIN t ON t.conv_id = c.first WHERE k <= h
        UNION ALL SELECT conv_id, 1, k, tie, words FROM c JOIN t USING (conv_id) WHERE k > h),
    p AS (SELECT conv_id, row_number() OVER o AS d, string_agg(tie, '') OVER o AS path, words FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, k)),
    s AS (SELECT conv_id, d, sha256(path) AS node, words FROM p UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
    u AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) AS n FROM s),
    m AS (SELECT node, d, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256 FROM u GROUP BY node, d),
    k AS (SELECT up, count(*) AS n_children FROM m GROUP BY up),
    f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k ON k.up = m.node),
    b AS (SELECT u.node, sum((f.n_convs - 1) * f.words) AS saved_tokens, count_if(f.n_children = 0) AS n_leaves FROM f JOIN u ON u.conv_id = f.conv_id AND u.d <= f.d GROUP BY u.node)
    SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, g.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
    FROM f JOIN b ON b.node = f.node LEFT JOIN f g ON g.node = f.up
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie(table(spark, sf_dir, "conversations"), group=20, shared=shared)
