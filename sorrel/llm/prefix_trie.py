"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns (role, text), the root the empty
one.  Conversations are cut into blocks of ``BLOCK`` turns.  Blocks are digested, and
conversations grouped by the chain of their successive block digests, so a group of
copies is one row from the first block on.  Only where the blocks that follow one
chain differ are they opened: each distinct block, with its number of
conversations, yields its turn prefixes, which are merged again.  A block that is alone
gives its turns as a chain with the same members.

Chains of very long conversations are built in levels: digests of at most
``CHAIN`` blocks are chained in one row, and the ends of these chains are chained
alike, so no row or task holds a whole conversation of any length.  Texts are
digested first (SHA-256 of role and text with their lengths) and never shuffled.

Sums over subtrees are taken by pointer jumping over nodes that several
conversations share: in round i each node adds the sums of those whose pointer
shows at it and then points twice as high, so rounds grow with the logarithm of
the depth.  Nodes of one conversation are chains with one leaf and nothing to save.

Turns are ordered by turn number (null first), then by digest; repeated rows are turns of
their own.  Null roles and texts count as empty.  Rows without a conversation id are
left out, as no conversation holds them.  An empty table has no node.
Other columns are left out; very long texts count by their digest and length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sorrel.plans.staging import assign_position, rank_within, skew_join, small_side, stage

BLOCK, CHAIN = 16, 1024
# Turns of a conversation that are numbered by one task; longer ones are numbered by a range sort.
NUMBERED = 20_000
# Ids written into one piece of a list of ids.
IDS = 4096
EMPTY = ""


def digested(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(c, turn, d, len)``: digest and code points of every turn."""
    role_text = F.coalesce(F.col(role).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.length(role_text).cast("string"), F.lit(":"), role_text, body)
    return rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.unhex(F.sha2(whole, 256)).alias("d"),
        F.length(body).cast("long").alias("len"),
    )


def numbered(turns: DataFrame, limit: int = NUMBERED) -> DataFrame:
    """``(c, p, d, len)``: turns with their place from 1 on, whatever a conversation's size."""
    order = [F.col("turn").asc_nulls_first(), F.col("d").asc()]
    several = stage(turns.groupBy("c").count().filter(F.col("count") > limit).select("c"), "long")
    if several.isEmpty():
        return turns.withColumn("p", F.row_number().over(Window.partitionBy("c").orderBy(*order)).cast("long")).select("c", "p", "d", "len")
    turns = stage(turns, "turns")
    long = turns.join(small_side(several), "c", "left_semi").withColumn("tie", F.monotonically_increasing_id())
    ranked = rank_within(long, ["c"], [*order, F.col("tie").asc()], "p").select("c", "p", "d", "len")
    rest = turns.join(small_side(several), "c", "left_anti")
    return numbered(rest, 1 << 62).unionByName(ranked)


def chained(blocks: DataFrame, width: int = CHAIN) -> DataFrame:
    """``(c, k, chain)`` of ``(c, k, d)``: digest of the first blocks up to and with block k (from 0)."""
    grouped = blocks.groupBy("c", F.floor(F.col("k") / width).alias("s")).agg(F.sort_array(F.collect_list(F.struct("k", "d"))).alias("b"))
    steps = F.aggregate(
        "b",
        F.struct(F.lit(EMPTY).cast("binary").alias("at"), F.array().cast("array<struct<k:long,chain:binary>>").alias("out")),
        lambda s, x: _step(s, x),
    )
    runs = stage(grouped.select("c", "s", steps["out"].alias("run")), "chains")
    inner = runs.select("c", "s", F.explode("run").alias("x")).select("c", "s", "x.k", "x.chain")
    if runs.filter(F.col("s") > 0).isEmpty():
        return inner.select("c", "k", "chain")
    ends = runs.select("c", F.col("s").alias("k"), F.element_at("run", -1)["chain"].alias("d"))
    before = chained(ends, width).select("c", (F.col("k") + 1).alias("s"), F.col("chain").alias("before"))
    whole = F.when(F.col("before").isNull(), F.col("chain")).otherwise(F.unhex(F.sha2(F.concat("before", "chain"), 256)))
    return inner.join(before, ["c", "s"], "left").select("c", "k", whole.alias("chain"))


def _step(state: Column, x: Column) -> Column:
    at = F.unhex(F.sha2(F.concat(state["at"], x["d"]), 256))
    return F.struct(at.alias("at"), F.concat(state["out"], F.array(F.struct(x["k"].cast("long").alias("k"), at.alias("chain")))).alias("out"))


def block_groups(turns: DataFrame, block: int = BLOCK, width: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Distinct blocks after each chain, and the last chain of every conversation.

    The first are ``(up, chain, k, turns, m, c)``: chain before and with the block, its
    turns ``(d, len)``, number of conversations and smallest id.  The second are
    ``(c, key)`` with the node at which a conversation ends.
    """
    place = F.struct("p", "d", "len")
    cut = turns.groupBy("c", F.floor((F.col("p") - 1) / block).alias("k")).agg(F.sort_array(F.collect_list(place)).alias("turns"))
    cut = stage(
        cut.select(
            "c", "k", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["len"].alias("len"))).alias("turns"),
            F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""), 256)).alias("d"),
        ),
        "blocks",
    )
    chains = stage(chained(cut.select("c", "k", "d"), width), "chained")
    before = chains.select("c", (F.col("k") + 1).alias("k"), F.col("chain").alias("up"))
    linked = cut.join(chains, ["c", "k"]).join(before, ["c", "k"], "left")
    linked = linked.withColumn("up", F.coalesce("up", F.lit(EMPTY).cast("binary")))
    groups = linked.groupBy("up", "chain", "k").agg(F.count("*").alias("m"), F.min("c").alias("c"), F.min("turns").alias("turns"))
    last = linked.withColumn("n", F.max("k").over(Window.partitionBy("c"))).filter(F.col("k") == F.col("n"))
    ends = last.select("c", F.element_at(prefixes(block), -1)["key"].alias("key"))
    return stage(groups, "groups"), ends


def prefixes(block: int = BLOCK) -> Column:
    """Nodes ``(j, key, up, len)`` of a block's turns, from its ``up``, ``chain`` and ``turns``.

    The last turn of a full block is the node of its chain; others are digests of
    the chain before and the block's turns so far.
    """
    start = F.struct(
        F.col("up").alias("at"), F.lit(EMPTY).cast("binary").alias("seen"),
        F.array().cast("array<struct<j:int,key:binary,up:binary,len:long>>").alias("out"),
    )

    def grow(s: Column, t: Column) -> Column:
        seen = F.unhex(F.sha2(F.concat(s["seen"], t["d"]), 256))
        j = F.size(s["out"]) + 1
        key = F.when(j == block, F.col("chain")).otherwise(F.unhex(F.sha2(F.concat(F.col("up"), seen), 256)))
        node = F.struct(j.alias("j"), key.alias("key"), s["at"].alias("up"), t["len"].alias("len"))
        return F.struct(key.alias("at"), seen.alias("seen"), F.concat(s["out"], F.array(node)).alias("out"))

    return F.aggregate("turns", start, grow)["out"]


def nodes_of(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, up, depth, len, m, c)`` of every node but the root, from the distinct blocks."""
    siblings = stage(groups.groupBy("up").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "siblings")
    opened = groups.withColumn("x", F.explode(prefixes(block))).select(
        "x.key", F.col("x.up").alias("prev"), (F.col("k") * block + F.col("x.j")).alias("depth"), "x.len", "m", "c", "up"
    )
    alone = opened.join(small_side(siblings.select("up")), "up", "left_anti")
    parted = skew_join(opened, siblings, ["up"], freq="n", how="left_semi")
    merged = parted.groupBy("key").agg(
        F.min("prev").alias("prev"), F.min("depth").alias("depth"), F.min("len").alias("len"), F.sum("m").alias("m"), F.min("c").alias("c")
    )
    columns = ["key", F.col("prev").alias("up"), "depth", "len", "m", "c"]
    return alone.select(*columns).unionByName(merged.select(*columns))


def subtree_sums(shared: DataFrame) -> DataFrame:
    """``(key, leaves, saved)`` summed over subtrees, from ``(key, up, leaves, saved)``; the root's ``up`` is null."""
    now = stage(shared, "sums")
    root = F.lit(EMPTY).cast("binary")
    while not now.filter(F.col("up").isNotNull()).isEmpty():
        added = now.filter(F.col("up").isNotNull()).groupBy("up").agg(
            F.sum("leaves").alias("more"), F.sum("saved").alias("kept"), F.count("*").alias("n")
        )
        added = stage(added, "added")
        above = stage(added.join(now.select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("up", "next", "n"), "above")
        grown = now.join(added.select(F.col("up").alias("key"), "more", "kept"), "key", "left").select(
            "key", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("kept", F.lit(0))).alias("saved")
        )
        # The root shows nowhere, and so does what showed at it.
        still = grown.filter(F.col("up").isNotNull() & (F.col("up") != root))
        done = grown.filter(F.col("up").isNull() | (F.col("up") == root)).withColumn("up", F.lit(None).cast("binary"))
        jumped = skew_join(still, above, ["up"], freq="n").select("key", F.col("next").alias("up"), "leaves", "saved")
        now = stage(jumped.unionByName(done), "sums")
    return now.drop("up")


def id_lists(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """``(key, ends_sha256)`` of ``(key, c)``: digest of each key's ids, ascending and comma-joined.

    Ids are numbered by a range sort and joined in pieces; the pieces of a key are then
    digested in order as a stream, since a digest has to be taken in order.
    """
    placed = assign_position(ends, [F.col("key").asc(), F.col("c").asc()], "pos")
    pieces = placed.groupBy("key", F.floor(F.col("pos") / ids).alias("piece")).agg(F.sort_array(F.collect_list("c")).alias("c"))
    joined = pieces.select("key", "piece", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"))
    ordered = joined.repartition("key").sortWithinPartitions("key", "piece")
    return ordered.mapInArrow(_digests, "key binary, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    key, state = None, None
    for batch in batches:
        keys, out = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                keys.append(key)
                out.append(state.hexdigest())
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(out, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, width: int = CHAIN) -> DataFrame:
    """All nodes of the trie of ``turns(c, p, d, len)``, places from 1 without gaps, for the conversations ``convs(c)``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.
    """
    groups, ends = block_groups(turns, block, width)
    root = F.lit(EMPTY).cast("binary")
    turnless = convs.join(turns.filter("p = 1").select("c"), "c", "left_anti").select("c", root.alias("key"))
    top = convs.agg(F.min("c").alias("c"), F.count("*").alias("m")).select(
        root.alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("len"), "m", "c"
    ).filter("m > 0")
    nodes = stage(nodes_of(groups, block).unionByName(top), "nodes")
    children = stage(nodes.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children")), "children")
    counted = stage(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "counted")
    # A node of one conversation ends in one leaf; the topmost of such a chain stands for it.
    several = (F.col("m") > 1) | (F.col("depth") == 0)
    chains_at = counted.filter(~several).groupBy(F.col("up").alias("key")).agg(F.count("*").alias("chains"))
    shared = counted.filter(several).join(chains_at, "key", "left").select(
        "key", "up",
        (F.coalesce("chains", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves"),
        (F.greatest(F.col("m") - 1, F.lit(0)) * F.col("len")).alias("saved"),
    )
    sums = subtree_sums(shared)
    above = nodes.select(F.col("key").alias("up"), F.col("c").alias("parent_conv_id"))
    above = stage(above.join(children.select(F.col("key").alias("up"), "n_children"), "up").select("up", "parent_conv_id", "n_children"), "parents")
    below = counted.filter(F.col("up").isNotNull())
    joined = skew_join(below, above.withColumnRenamed("n_children", "n"), ["up"], freq="n").drop("n").unionByName(
        counted.filter(F.col("up").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    digests = id_lists(ends.unionByName(turnless))
    out = joined.join(sums, "key", "left").join(digests, "key", "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("m").alias("n_convs"), "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def with_heads(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of rebuilt conversations: the first h turns of c - c % ``every``, then those of c after its first h.

    h is the unsigned CRC-32 of the decimal id modulo ``heads``.
    """
    convs = stage(turns.groupBy("c").agg(F.count("*").alias("n")), "convs")
    convs = convs.select("c", "n", (F.col("c") - F.col("c") % every).alias("base"), (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
    # Of no conversation but those that others begin with are more than the first turns' rows joined.
    first = turns.filter((F.col("c") % every == 0) & (F.col("p") < heads)).select(F.col("c").alias("base"), "p", "d", "len")
    begun = convs.join(first, "base").filter(F.col("p") <= F.col("h")).select("c", "p", "d", "len")
    size = convs.select(F.col("c").alias("base"), F.col("n").alias("had")).filter(F.col("base") % every == 0)
    shift = convs.join(size, "base", "left").select("c", "h", (F.least(F.coalesce("had", F.lit(0)), "h") - F.col("h")).alias("shift"), F.col("n").alias("n"))
    own = skew_join(turns, stage(shift, "shift"), ["c"], freq="n").filter(F.col("p") > F.col("h"))
    return begun.unionByName(own.select("c", (F.col("p") + F.col("shift")).alias("p"), "d", "len")), convs.select("c")


def conversation_trie(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = False
) -> DataFrame:
    """Nodes of the prefix trie of conversations, as they are or ``rebuilt`` by ``with_heads``."""
    turns = stage(numbered(digested(rows, conv, turn, role, text)), "turns")
    if rebuilt:
        turns, convs = with_heads(turns)
        turns = stage(turns, "rebuilt")
    else:
        convs = turns.filter("p = 1").select("c")
    return trie(turns, convs)
