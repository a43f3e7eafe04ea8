"""A prefix trie of conversations, without a node in anyone's memory.

A node is a sequence of first turns. Its key is its depth and a running exclusive or of the digests of its turns and their places, so keys
come from one associative scan over each conversation. Every node belongs to its smallest member. Fewer conversations pass through a node's children
than through it, so the nodes that a conversation owns are the last ones of its path: where they begin is all that has to be known of it.
What a subtree holds is then a sum over the conversations that pass through its top: the words of the turns that they share with a smaller one,
and whether they own a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import scan
from quire.llm.staging import look_up, stage
from quire.llm.turns import turn_rows

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "high", "low"]


def _half(digest: Column, at: int) -> Column:
    """16 of a digest's 64 digits as a long."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def rebuilt(conversations: DataFrame, group: int, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first one of their group: their turns (conv_id, place from 1, high, low, words), and all of them with n_turns.

    Conversation c takes the first ``shared`` (a column of conv_id) turns of conversation c - c % ``group`` (all if it has fewer, none if there is
    none) and then its own turns after its first ``shared``. high and low are halves of the digest of role and text.
    """
    told = turn_rows(conversations).select("conv_id", "turn", "tie", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = scan(stage(told, "turns"), ["conv_id"], ["turn", "tie"], number=("count", F.lit(1)))
    turns = stage(turns.select("conv_id", "number", _half(F.col("tie"), 1).alias("high"), _half(F.col("tie"), 17).alias("low"), "words"), "numbered")
    convs = turns.groupBy("conv_id").agg(F.max("number").alias("own")).withColumns({"h": shared.cast("long"), "first": F.col("conv_id") - F.col("conv_id") % group})
    sizes = convs.select(F.col("conv_id").alias("first"), F.col("own").alias("there"))
    convs = stage(convs.join(sizes, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "shares")
    total, most = convs.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.max("taken"), F.lit(0))).first()
    # those who share a first conversation are ``group`` at most, and take ``most`` of its turns at most
    lent = turns.where((F.col("conv_id") % group == 0) & (F.col("number") <= most)).withColumnRenamed("conv_id", "first")
    lead = convs.where("taken > 0").select("conv_id", "first", "taken").join(lent, "first").where("number <= taken").select("conv_id", F.col("number").alias("place"), "high", "low", "words")
    rest = look_up(turns, convs.select("conv_id", "own", "h", "taken"), ["conv_id"], "own", total, ["number"]).where("number > h")
    rest = rest.select("conv_id", (F.col("number") - F.col("h") + F.col("taken")).alias("place"), "high", "low", "words")
    return lead.unionByName(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, of sorted rows of (depth, high, low, piece, ids): nothing but the hash's state is kept."""
    last, state, done = None, None, []

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [[]] * 4, kinds, strict=True)], names=[*NODE, "ends_sha256"])
        done.clear()
        return batch

    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
            if node != last:
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield out()
    if last is not None:
        done.append((*last, state.hexdigest()))
    yield out()


def prefix_trie(conversations: DataFrame, group: int = 20, shared: Column | None = None) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see ``rebuilt``), root included.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, words of each node's last text times the members but one), ends_sha256 (of the decimal ids, in order, joined by
    commas, of the members that end here; of nothing where none does). shared: how many turns come from the group's first conversation; by default
    none do, so conversations are as they stand.

    Rows are ordered by turn, null first, then by the digest of role and text; repeated rows are turns of their own. A null role or text is empty. Rows
    without a conv_id belong to no conversation and are left out. Other columns are not read. An empty table has no nodes, not even a root. Texts of any length are hashed
    and counted where they are read and go no further.

    Keys have 128 bits of SHA-256 digests. The only group of unbounded size that meets in one task are the ids that end at one node, joined
    in pieces before: a digest takes its bytes in order.
    """
    turns, convs = rebuilt(conversations, group, F.lit(0) if shared is None else shared)
    placed = F.sha2(F.concat_ws(":", "place", "high", "low").cast("binary"), 256)
    turns = stage(turns.withColumn("placed", placed).select("conv_id", "place", "words", _half(F.col("placed"), 1).alias("own_high"), _half(F.col("placed"), 17).alias("own_low")), "path")
    path = scan(turns, ["conv_id"], ["place"], high=("xor", F.col("own_high")), low=("xor", F.col("own_low")), tokens=("sum", F.col("words")))
    total, n_convs = convs.agg(F.coalesce(F.sum("n_turns"), F.lit(0)), F.count("*")).first()
    above = [F.col(x).bitwiseXOR(F.col(f"own_{x}")).alias(f"up_{x}") for x in ("high", "low")]
    steps = look_up(path, convs, ["conv_id"], "n_turns", total, ["place"]).select("conv_id", F.col("place").alias("depth"), "high", "low", *above, "words", "tokens", "n_turns")
    zero = F.lit(0).cast("long")
    start = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "high", "low", "up_high", "up_low", "words", "tokens")], "n_turns")
    steps = stage(steps.unionByName(start), "steps")

    # each node's smallest member; then, of each conversation, where its own nodes begin, the words before them, and whether it owns a leaf
    same = [F.first(c).alias(c) for c in ("up_high", "up_low", "tokens", "words")]  # all members of a node share its turns
    owners = steps.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max(F.col("n_turns") > F.col("depth")).alias("goes_on"), *same)
    own = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("begins"), F.min(F.col("tokens") - F.col("words")).alias("before"), F.max(~F.col("goes_on")).cast("long").alias("leaf"))
    last = steps.where("depth = n_turns").select("conv_id", "n_turns", F.col("tokens").alias("all_words"))
    marks = last.join(own, "conv_id", "left").select("conv_id", (F.col("n_turns") + 1).alias("n_steps"), F.coalesce("begins", F.col("n_turns") + 1).alias("begins"), F.coalesce("before", "all_words").alias("before"), F.coalesce("leaf", zero).alias("leaf"))
    marks = stage(marks, "marks")

    seen = look_up(steps, marks, ["conv_id"], "n_steps", total + n_convs, ["depth"])
    own_child = (F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("begins"))
    # words from here on that a smaller conversation has too: those before its own nodes, without those before this one
    given = F.greatest(F.col("before") - (F.col("tokens") - F.col("words")), zero)
    up = [F.first(c).alias(c) for c in ("up_high", "up_low")]
    nodes = stage(seen.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(own_child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(given).alias("saved_tokens"), *up), "nodes")

    ends = last_ids(steps.where("depth = n_turns"))
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    n_nodes = nodes.count()
    rows = look_up(nodes, parents, ["depth", "up_high", "up_low"], "weight", n_nodes, ["conv_id"]).drop("weight").join(ends, NODE, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def last_ids(ends: DataFrame) -> DataFrame:
    """depth, high, low and ends_sha256: the digest of the ids that end at each node."""
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(_join_ids, "depth long, high long, low long, ends_sha256 string")
