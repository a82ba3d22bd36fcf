"""The trie of all prefixes of conversations, by hashes of fixed-length blocks of turns.

Conversations are cut into blocks of `BLOCK` turns, and grouped by the blocks before and the block itself: copies and
common beginnings meet as blocks, not as turns. Where a prefix has one block to follow it, every turn of that block has
the block's members and nothing more is grouped. Only where blocks diverge are their turns' boundaries grouped, and by
then a group of copies is one row.

A node belongs to its smallest member. The nodes that a conversation owns are an end of its path, so the trie is a tree
of such chains, each hanging on a node of a smaller conversation's chain. Sums over subtrees first pass between chains
by pointer doubling (as many rounds as the logarithm of how deep chains hang on chains), then along each chain.

Hot prefixes: groups are counted before they are shuffled; rows that look up a prefix that a third of all
conversations may share are salted. Prefixes are told apart by 128 bits.

Defined cases: rows without conv_id are left out; without rows there is no node. A null role or text is empty. Turns go
by number, null first; turns of one number in the order of a hash of role and text. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, scratch, small_batches, stored

#: Turns of a block, and parts that a hot prefix is dealt to.
BLOCK, SALTS = 8, 16
#: Bytes of joined ids that a task hands on at a time.
PIECE = 1 << 16
KEY = ["depth", "h1", "h2"]
_NODE = [("depth", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]
PIECES, DIGESTS = pa.schema([*_NODE, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*_NODE, ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def places(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, n_bytes): every turn by its place from 1, with two hashes and the UTF-8 bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    return turns.withColumn("place", F.row_number().over(order)).select("conv_id", "place", "t1", "t2", "n_bytes")


def with_roots(turns: DataFrame) -> DataFrame:
    """The turns with a place 0 for each conversation, which all conversations share."""
    roots = turns.filter("place = 1").select("conv_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("n_bytes"))
    return turns.unionByName(roots)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, k, turns, p1, p2, c1, c2, ends): each conversation's blocks, with the digests of all before and all so far."""
    hashed = turns.select("conv_id", "place", "n_bytes", F.xxhash64("place", "t1", "t2").alias("x1"), F.xxhash64(F.lit(1), "t2", "place", "t1").alias("x2"))
    own = hashed.repartition("conv_id").groupBy("conv_id", F.floor(F.col("place") / BLOCK).cast("int").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("place", "x1", "x2", "n_bytes"))).alias("turns"), F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    so_far = Window.partitionBy("conv_id").orderBy("k")
    chained = own.withColumn("c1", F.bit_xor("b1").over(so_far)).withColumn("c2", F.bit_xor("b2").over(so_far)).withColumn("ends", F.lead("k").over(so_far).isNull())
    return chained.select("conv_id", "k", "turns", F.col("c1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("c2").bitwiseXOR(F.col("b2")).alias("p2"), "c1", "c2", "ends")


def _salted(big: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "left") -> DataFrame:
    """A join of many rows that may share a key with few rows that don't."""
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def _nodes(blocks: DataFrame) -> DataFrame:
    """(depth, h1, h2, g1, g2, n_bytes, n_convs, conv_id): nodes with their prefix's digest, its parent's, members and the smallest."""
    shared = stored(blocks.groupBy("k", "p1", "p2", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "blocks")
    forks = shared.groupBy("k", "p1", "p2").agg(F.count("*").alias("ways")).filter("ways > 1").withColumn("forked", F.lit(True)).drop("ways")
    marked = _salted(shared, forks, ["k", "p1", "p2"], "turns")
    # The digest at each turn of a block, and at the turn before.
    along = "transform(turns, (t, i) -> struct(t.place AS depth, t.n_bytes AS n_bytes, {}))".format(", ".join(f"aggregate(slice(turns, 1, i + {more}), p{c}, (a, u) -> a ^ u.x{c}) AS {name}{c}" for name, more in (("h", 1), ("g", 0)) for c in (1, 2)))
    turns = marked.select("n", "conv_id", F.coalesce("forked", F.lit(False)).alias("forked"), F.explode(F.expr(along)).alias("t")).select("n", "conv_id", "forked", "t.*")
    columns = ["depth", "h1", "h2", "g1", "g2", "n_bytes", "n_convs", "conv_id"]
    alike = turns.filter("NOT forked").withColumnRenamed("n", "n_convs").select(columns)
    apart = turns.filter("forked").groupBy("depth", "h1", "h2", "g1", "g2", "n_bytes").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")).select(columns)
    return stored(alike.unionByName(apart), "nodes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, h1, h2, conv_id) to pieces of joined ids: (depth, h1, h2, first id, ids)."""
    key, first, ids, size = None, None, [], 0
    rows: list[tuple] = []
    for batch in batches:
        for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key or size >= PIECE:
                if ids:
                    rows.append((*key, first, ",".join(ids)))
                key, first, ids, size = at, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if rows:
            yield _batch(rows, PIECES)
            rows = []
    if ids:
        rows.append((*key, first, ",".join(ids)))
        yield _batch(rows, PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (depth, h1, h2, SHA-256 of all ids joined): a node's ids are never held together."""
    key, sha = None, None
    for batch in batches:
        rows = []
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if at != key:
                if key:
                    rows.append((*key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if rows:
            yield _batch(rows, DIGESTS)
    if key:
        yield _batch([(*key, sha.hexdigest())], DIGESTS)


def _ends(blocks: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of the nodes at which conversations end."""
    kinds = "depth int, h1 long, h2 long"
    at = blocks.filter("ends").select(F.element_at("turns", -1)["place"].alias("depth"), F.col("c1").alias("h1"), F.col("c2").alias("h2"), "conv_id")
    order = ["h1", "h2", "depth"]
    ranged = at.repartitionByRange(*order, "conv_id").sortWithinPartitions(*order, "conv_id")
    pieces = arrow_map(ranged, _pieces, f"{kinds}, first long, ids string")
    return arrow_map(pieces.repartition(*order).sortWithinPartitions(*order, "first"), _digests, f"{kinds}, ends_sha256 string")


def _totals(chains: DataFrame, spark) -> DataFrame:
    """(conv_id, leaves, saved) of each chain with all that hangs on it: (conv_id, up, leaves, saved) by pointer doubling."""
    now = stored(chains, "totals")
    while not now.filter("up IS NOT NULL").isEmpty():
        sums = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        # The next pointer: only what is pointed at and points on itself need be looked up.
        on = sums.select("conv_id").join(now.filter("up IS NOT NULL").select("conv_id", F.col("up").alias("next")), "conv_id").withColumnRenamed("conv_id", "up")
        moved = _salted(now, on, ["up"], "conv_id")
        now = stored(moved.join(sums, "conv_id", "left").select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "totals")
    return now.drop("up")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, place, t1, t2, n_bytes); place 0 is the root's.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the smallest member (with
    the depth it names the node), the parent's, members, children, childless nodes below, what sharing saves below
    (members but one, times the bytes of each node's text), and a hash of the ids of the conversations that end here.
    """
    spark = turns.sparkSession
    small_batches(spark)
    with scratch(spark) as keep:
        blocks = stored(_blocks(turns), "turns")
        nodes = _nodes(blocks)
        chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by("g1", "depth").alias("h1"), F.min_by("g2", "depth").alias("h2"), F.sum((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
        chains = stored(chains.withColumn("depth", F.col("top") - 1), "chains")
        # Nodes that a chain hangs on, or at which conversations end, find their owner.
        hooks = chains.filter("top > 0").groupBy(*KEY).agg(F.lit(None).cast("string").alias("ends_sha256"), F.count("*").alias("tops"))
        asked = hooks.unionByName(_ends(blocks).withColumn("tops", F.lit(0).cast("long"))).groupBy(*KEY).agg(F.max("ends_sha256").alias("ends_sha256"), F.sum("tops").alias("tops"))
        known = stored(asked.join(nodes.select(*KEY, F.col("conv_id").alias("owner")), KEY), "known")
        hung = stored(_salted(chains.filter("top > 0"), known.filter("tops > 0").select(*KEY, "owner"), KEY, "conv_id", "inner").select("conv_id", "top", "depth", "owner"), "hung")
        # A chain's last node is a leaf if nothing hangs on it.
        held = hung.groupBy(F.col("owner").alias("conv_id"), F.col("depth").alias("bottom")).agg(F.lit(0).alias("leaf"))
        lone = chains.join(held, ["conv_id", "bottom"], "left").join(hung.select("conv_id", F.col("owner").alias("up")), "conv_id", "left")
        totals = _totals(lone.select("conv_id", "up", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves"), "saved"), spark)
        below = hung.join(totals, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count("*").alias("tops"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        none, zero = F.lit(None), F.lit(0).cast("long")
        facts = below.select("conv_id", "depth", "tops", "leaves", "saved", none.cast("long").alias("up"), none.cast("string").alias("sha"))
        facts = facts.unionByName(hung.select("conv_id", F.col("top").alias("depth"), zero.alias("tops"), zero.alias("leaves"), zero.alias("saved"), F.col("owner").alias("up"), none.cast("string").alias("sha")))
        facts = facts.unionByName(known.filter("ends_sha256 IS NOT NULL").select(F.col("owner").alias("conv_id"), "depth", zero.alias("tops"), zero.alias("leaves"), zero.alias("saved"), none.cast("long").alias("up"), F.col("ends_sha256").alias("sha")))
        facts = facts.groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in ("tops", "leaves", "saved")), F.max("up").alias("up"), F.max("sha").alias("sha"))
        upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
        rows = nodes.select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own")).join(facts, ["conv_id", "depth"], "left")
        tops, place = F.coalesce("tops", zero), F.row_number().over(upward)
        out = rows.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"), "n_convs",
            (tops + F.when(place > 1, 1).otherwise(0)).alias("n_children"),
            (F.sum(F.coalesce("leaves", zero)).over(upward) + F.first(F.when(tops == 0, 1).otherwise(0)).over(upward)).alias("n_leaves"),
            F.sum(F.col("own") + F.coalesce("saved", zero)).over(upward).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        out = stored(out, "trie")
        keep.append(out)
        return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(with_roots(places(conversations)))
