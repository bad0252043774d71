"""Prefix trie of conversations, built by van Emde Boas recursion.

A trie of depths 0 .. H-1 (H a power of two above the longest conversation) is cut at half depth, its upper trie and the
lower forests are cut at half of theirs, and so on; all parts of one size are worked on in the same Spark job, so a trie
takes log2 H rounds instead of one per depth:

1. **Digests.** A turn is the SHA-256 of its role and text. Digests of aligned blocks of 2, 4, ... turns come from pairs
   of blocks of half the size: a geometric series of narrow rows.
2. **Names.** A prefix is named by the smallest conversation that starts with it. Round by round, from the largest part
   down: the prefix at the cut of a part is (name at the part's top, digest of the block up to the cut); its name is the
   least member. The names of a round are written before members look theirs up, so AQE can split a common prefix.
3. **Nodes.** The row of a named prefix whose conversation is the name itself is the node. Its parent's name stands in
   that conversation's row one depth above.
4. **Totals.** From the smallest part up, each cut node passes the totals of its lower tree to its ancestors in the upper
   trie of the same part; later rounds pass them on. So a node sends log2 H times at most, not once per ancestor.

No row carries a text. A conversation of any length is one row per turn, never an array; positions come from a range sort
with offsets, so no conversation is in one task. The list of ids that end in a node is hashed as a stream of packed
pieces, so one that holds a third of all ids needs no memory to speak of.

Defined cases: null roles and texts are empty; a null turn comes first, equal turns in the order of their SHA-256; every
repeated row is a turn. Rows with a null conv_id belong to no conversation and are left out. A conversation that is left
without turns ends in the root. An empty table gives no rows, not even the root. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailwarden.llm.common import shuffle_partitions, written

#: Bytes of joined ids in one piece of a node's list.
PIECE = 1 << 16


def _turn_digest() -> Column:
    """SHA-256 of "<length of role>:<role><text>"."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def ordered_turns(df: DataFrame) -> DataFrame:
    """(conv, pos, digest, chars): turns numbered from 1 within their conversation.

    The rows are range-sorted by (conversation, turn, digest) and written; a row's place is its place within its task's
    share of the conversation plus the shares before.
    """
    narrow = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", _turn_digest().alias("digest"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = narrow.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    laid = written(dealt.select("conv", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "trie_turns")
    shares = laid.groupBy("part", "conv").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per task at most
    starts = written(shares.select("part", "conv", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "trie_starts")
    return laid.join(starts, ["part", "conv"]).select(
        "conv", (F.col("place") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "chars")


def shared_starts(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are replaced by those of the first conversation of their block of ``span`` ids.

    h is the CRC-32 of the decimal id, modulo ``most``. Returns the turns, and (conv, len) of all conversations.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    lengths = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "trie_lengths")
    convs = lengths.select("conv", "own", h, (F.col("conv") - F.col("conv") % span).alias("base"))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("own").alias("_base_len")), "base", "left").select(
        "conv", "base", "own", "h", F.least("h", F.coalesce("_base_len", F.lit(0))).alias("taken"))
    convs = written(convs, "trie_convs")
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "digest", "chars")
    head = convs.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv", "pos", "digest", "chars")
    tail = turns.join(convs, "conv").filter(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    length = (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("taken")).alias("len")
    return head.union(tail), convs.select("conv", length)


def _block_digests(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """Per size 2^j: (conv, at, digest) of the complete aligned blocks of turns; ``at`` counts blocks of that size."""
    blocks = [turns.select("conv", (F.col("pos") - 1).alias("at"), "digest")]
    for _ in range(1, rounds):
        odd = (F.col("at") % 2).cast("boolean")
        pairs = blocks[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(~odd, F.col("digest"))).alias("l"), F.max(F.when(odd, F.col("digest"))).alias("r"))
        whole = pairs.filter("l is not null and r is not null")
        blocks.append(written(whole.select("conv", "at", F.sha2(F.concat("l", "r"), 256).alias("digest")), "trie_blocks"))
    return blocks


def prefix_names(turns: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """(conv, depth, name, len): the name of every prefix of every conversation, depths 0 to its length."""
    blocks = _block_digests(turns, rounds)
    root = lengths.agg(F.min("conv").alias("name"))
    levels = [written(lengths.crossJoin(F.broadcast(root)).select("conv", F.lit(0).cast("long").alias("depth"), "name", "len"), "trie_names")]   # root: one row
    for j in range(rounds, 0, -1):
        tops = None                                       # names at the tops of the parts of depth 2^j
        for level in levels:
            tops = level if tops is None else tops.union(level)
        half = 1 << (j - 1)
        cut = blocks[j - 1].filter("at % 2 = 0").select("conv", (F.col("at") * half).alias("depth"), "digest")
        members = written(tops.join(cut, ["conv", "depth"]).select(
            "conv", (F.col("depth") + half).alias("depth"), F.col("name").alias("top"), "digest", "len"), "trie_members")
        named = written(members.groupBy("depth", "top", "digest").agg(F.min("conv").alias("name")), "trie_groups")
        levels.append(written(members.join(named, ["depth", "top", "digest"]).select("conv", "depth", "name", "len"), "trie_names"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def _nodes(names: DataFrame, turns: DataFrame) -> DataFrame:
    """(name, depth, parent, chars, n_convs, n_children) of every node; written."""
    members = names.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_convs"))
    above = names.filter("depth < len").select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv", F.col("pos").alias("depth"), "chars")
    found = members.withColumnRenamed("name", "conv").join(above, ["conv", "depth"], "left").join(last, ["conv", "depth"], "left")
    found = written(found.select(F.col("conv").alias("name"), "depth", "parent", F.coalesce("chars", F.lit(0)).alias("chars"), "n_convs"), "trie_found")
    children = found.filter("parent is not null").groupBy(
        F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(found.join(children, ["name", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie_nodes")


def _totals(nodes: DataFrame, names: DataFrame, rounds: int) -> DataFrame:
    """(name, depth, n_leaves, saved_tokens) over the subtree of every node: totals of lower trees grafted upward."""
    own = nodes.select("name", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    parts = own
    for j in range(1, rounds + 1):
        size, half = 1 << j, 1 << (j - 1)
        cut = parts.filter(F.col("depth") % size == half).groupBy("name", "depth").agg(*sums).select(
            F.col("name").alias("conv"), F.shiftright("depth", j).alias("part"), "n_leaves", "saved_tokens")
        upper = names.filter(F.col("depth") % size < half).select("conv", F.shiftright("depth", j).alias("part"), "depth", "name")
        grafted = upper.join(cut, ["conv", "part"]).groupBy("name", "depth").agg(*sums)
        parts = parts.union(written(grafted, "trie_grafted"))
    return parts.groupBy("name", "depth").agg(*sums)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, depth, conv) to pieces (name, depth, first, ids): comma-joined ids of one node, in bounded strings."""
    kinds = pa.schema([("name", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, held, size, out = None, [], 0, []

    def close():
        out.append((*node, held[0], ",".join(map(str, held))))

    for batch in batches:
        for name, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (node != (name, depth) or size >= PIECE):
                close()
                held, size = [], 0
            node = name, depth
            held.append(conv)
            size += len(str(conv)) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)
            out.clear()
    if held:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of a task's nodes to (name, depth, ends_sha256)."""
    kinds = pa.schema([("name", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, state, out = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    for batch in batches:
        for name, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node == (name, depth):
                state.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, state.hexdigest()))
            node, state = (name, depth), hashlib.sha256(ids.encode())
        if out:
            yield flush()
            out.clear()
    if node:
        out.append((*node, state.hexdigest()))
        yield flush()


def _ends(names: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256) of the nodes where conversations end: their ids in ascending order, hashed as a stream.

    A range sort deals the ids of one node over tasks; each packs its share, and what meets in the node's task is a few
    strings that are read in order.
    """
    ended = names.filter("depth = len").select("name", "depth", "conv")
    order = ["name", "depth", "conv"]
    dealt = ended.repartitionByRange(shuffle_partitions(names.sparkSession), *order).sortWithinPartitions(*order)
    packed = dealt.mapInArrow(_pieces, "name long, depth long, first long, ids string")
    return packed.repartition("name", "depth").sortWithinPartitions("name", "depth", "first").select("name", "depth", "ids").mapInArrow(
        _hashes, "name long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations: ``turns`` (conv, pos from 1, digest, chars) and ``lengths`` (conv, len).

    One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.
    """
    turns, lengths = written(turns, "trie_rebuilt"), written(lengths, "trie_rebuilt_lengths")
    longest = lengths.agg(F.max("len")).first()[0] or 0
    rounds = int(longest).bit_length()
    names = prefix_names(turns, lengths, rounds)
    nodes = _nodes(names, turns)
    empty = hashlib.sha256(b"").hexdigest()
    out = nodes.join(_totals(nodes, names, rounds), ["name", "depth"]).join(_ends(names), ["name", "depth"], "left")
    return out.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt on shared starts (``shared_starts``)."""
    return trie(*shared_starts(written(ordered_turns(conversations), "trie_ordered")))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = written(ordered_turns(conversations), "trie_ordered")
    return trie(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len")))
