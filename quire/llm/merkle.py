"""A Merkle manifest of a table: levels built bottom up, proofs pushed top down.

Each row is a leaf, each group's leaves are a tree, and the groups' roots are one more tree. A level is one grouped digest over runs of
neighbouring nodes and is written; a parent keeps its children's digests. Proofs go the other way: each level joins its nodes to their
parents, and a node puts its own siblings before the proof that its parent inherited. All of it is SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import scan
from quire.llm.staging import look_up, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
_HEX = 64
_STEP = "struct<before:string,after:string>"
NO_PROOF = f"cast(array() as array<{_STEP}>)"


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and itself; a null is a dash."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[said(c.cast("string")) for c in fields]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to the root's, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class Manifest:
    """leaves: the rows' keys with leaf, tree and place. trees: a row for each group with its subroot. levels: written tables of nodes above the leaves."""

    leaves: DataFrame
    trees: DataFrame
    root: str | None
    proofs: DataFrame


def _build(nodes: DataFrame) -> list[DataFrame]:
    """Levels above ``nodes`` (tree, place, node, size: the tree's nodes at this level), each written, up to where every tree has one node."""
    levels, most = [], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = nodes.where("size > 1").groupBy("tree", F.floor(F.col("place") / FAN).cast("long").alias("up"), "size").agg(F.collect_list(F.struct("place", "node")).alias("run"))
        kids = F.array_join(F.transform(F.array_sort("run"), lambda n: n["node"]), "")  # a run is FAN nodes at most
        above = runs.select("tree", F.col("up").alias("place"), kids.alias("kids"), F.ceil(F.col("size") / FAN).cast("long").alias("size"))
        nodes = stage(above.withColumn("node", digest(F.col("kids"))), f"level-{len(levels)}")
        levels.append(nodes)
        most = -(-most // FAN)
    return levels


def _push(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with the proof: their siblings before what the parent inherited. parents: tree, place, kids, proof. The only node of its tree has none of its own."""
    at = (F.col("place") % FAN).cast("int") * _HEX
    own = F.struct(F.substring("up_kids", F.lit(1), at).alias("before"), F.substring("up_kids", at + _HEX + 1, F.lit(FAN * _HEX)).alias("after"))
    above = parents.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("kids").alias("up_kids"), F.col("proof").alias("up_proof"))
    found = nodes.join(above, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("place") / FAN) == F.col("up_place")), "left")
    proof = F.when(F.col("up_kids").isNotNull(), F.concat(F.array(own.cast(_STEP)), F.coalesce("up_proof", F.expr(NO_PROOF)))).otherwise(F.expr(NO_PROOF))
    return found.withColumn("proof", proof).drop("up_tree", "up_place", "up_kids", "up_proof")


def _proofs(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``leaves`` with their proofs within their trees; those of the levels above are written, level by level from the top."""
    if not levels:
        return leaves.withColumn("proof", F.expr(NO_PROOF))
    above = levels[-1].withColumn("proof", F.expr(NO_PROOF))
    for i, level in reversed(list(enumerate(levels[:-1]))):
        # a tree that is through below this level has no parent there, and so no proof from above
        above = stage(_push(level, above), f"proofs-{i}")
    return _push(leaves, above)


def merkle_manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``.

    Every row is a leaf, repeated rows too; in each group of ``by`` (null is one) leaves ascend by ``order``, null first, and by their digest where it is
    the same. Equal leaves are interchangeable. Groups ascend by ``by``, null first, else by their UTF-8 bytes. A group with one leaf has that leaf
    as its subroot, and one group's subroot is the root. Empty texts are fields of no bytes; nulls differ from them. An empty table has no rows and no root.
    Columns that are not in ``fields``, ``by`` or ``order`` are not read, but for those that ``also`` is made of, which the leaves get; their names must
    not be those of the leaves' own columns. Texts of any length are hashed where they are read and go no further.

    proofs has a row for each leaf: ``order``, ``by``, what ``also`` gives, leaf, subroot, root, proof (an array of the siblings before and after, from
    the leaf's level to the root's).
    """
    spark, more = docs.sparkSession, also or {}
    kind = docs.schema[by].dataType.simpleString()
    told = stage(docs.select(F.col(by).cast("string").alias("grp"), F.col(order).alias("ord"), *[c.alias(f"also_{n}") for n, c in more.items()], leaf_digest([F.col(f) for f in fields]).alias("node")), "leaves")
    trees = told.groupBy("grp").agg(F.count("*").alias("size"))
    trees = stage(scan(trees, [], ["grp"], tree=("count", F.lit(1))), "trees")
    total = trees.agg(F.sum("size")).first()[0] or 0
    named = F.coalesce(F.concat(F.lit("+"), "grp"), F.lit("-")).alias("named")  # never null
    placed = scan(told, ["grp"], ["ord", "node"], place=("count", F.lit(1))).withColumn("place", F.col("place") - 1)
    leaves = look_up(placed.select("*", named), trees.select(named, "tree", "size"), ["named"], "size", total, ["place"])
    leaves = stage(leaves.drop("named"), "placed")
    levels = _build(leaves.select("tree", "place", "node", "size"))
    ends = [leaves.where("size = 1").select("tree", "node")] + [level.where("size = 1").select("tree", "node") for level in levels]
    tops = ends[0]
    for end in ends[1:]:
        tops = tops.unionByName(end)
    tops = stage(trees.join(tops, "tree"), "subroots")
    n = tops.count()
    crown = tops.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), "node", F.lit(n).cast("long").alias("size"), F.col("tree").alias("of"), F.col("size").alias("of_size"))
    crown_levels = _build(crown.drop("of", "of_size"))
    root = None if not n else (crown_levels[-1] if crown_levels else crown).first()["node"]
    over = stage(_proofs(crown, crown_levels).select(F.col("of").alias("tree"), F.col("of_size").alias("weight"), F.col("node").alias("subroot"), F.col("proof").alias("over_proof")), "crown")
    within = look_up(_proofs(leaves, levels), over, ["tree"], "weight", total, ["place"])
    proofs = within.select(F.col("ord").alias(order), F.col("grp").cast(kind).alias(by), *[F.col(f"also_{c}").alias(c) for c in more], F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.concat("proof", "over_proof").alias("proof"))
    shown = leaves.select(F.col("ord").alias(order), F.col("grp").cast(kind).alias(by), "tree", "place", F.col("node").alias("leaf"))
    return Manifest(shown, tops.select(F.col("grp").cast(kind).alias(by), "tree", F.col("node").alias("subroot")), root, proofs if n else spark.createDataFrame([], proofs.schema))


def check_proofs(proofs: DataFrame, leaf: str) -> DataFrame:
    """``proofs`` with folded_root, what the leaf in this column leads to with the stored siblings, and verified, whether that is the root."""
    out = proofs.withColumn("folded_root", folded(F.col(leaf), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
