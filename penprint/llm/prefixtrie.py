"""A trie of conversation prefixes, named by van Emde Boas recursion, with subtree totals.

A node is a distinct sequence of first turns. Naming every prefix of every conversation by
hashing the whole prefix would cost the square of its length. Here prefixes are named the
van Emde Boas way: a block of 2^(k+1) turns is cut at half depth; a prefix that ends in the
upper half keeps the name it has in the upper trie, and one that ends in the lower half is
named by the pair (name of the cut prefix, its name in the lower forest below that cut).
All blocks of one level are built in parallel by one join, bottom up, so the whole trie
takes log2(longest conversation) joins over the turns, each a written table.

Totals are grafted upward without walking the tree: a node's subtree total is a sum over
its members of a suffix sum along each member's own path, with every descendant counted
once through its smallest member.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .whitening import join_back

GROUP = 100
CUTS = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
RESULT = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(c, p, role, text)``: turns numbered from 0 by turn (null first), then role, text.

    Null role or text becomes empty; rows with a null conv_id are left out. Repeated rows
    stay as separate turns. Only conv_id, turn, role and text are read.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("c"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("c is not null")
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("c", (F.row_number().over(order) - 1).cast("bigint").alias("p"), "role", "text")


def rebuilt_turns(conversations: DataFrame, group: int = GROUP, cuts: int = CUTS) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations ``(c, p, role, text)`` and every conv_id ``(c)``.

    Conversation c takes the first h turns of conversation c - c % group (all of them if
    fewer, none if it is absent), then its own turns after its first h, with h the unsigned
    CRC-32 of c in decimal, modulo ``cuts``.
    """
    turns = materialize(ordered_turns(conversations))
    convs = turns.select("c").distinct().select(
        "c",
        (F.col("c") - F.col("c") % group).alias("b"),
        (F.crc32(F.col("c").cast("string")) % cuts).alias("h"),
    )
    lengths = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    head = turns.where(F.col("p") < cuts).select(F.col("c").alias("b"), "p", "role", "text")
    from_base = convs.join(head, "b").where(F.col("p") < F.col("h")).select("c", "p", "role", "text")
    taken = convs.join(lengths.select(F.col("c").alias("b"), F.col("n").alias("bn")), "b", "left").select(
        "c", "h", F.least(F.coalesce("bn", F.lit(0)), F.col("h")).alias("k")
    )
    own = turns.join(taken, "c").where(F.col("p") >= F.col("h")).select(
        "c", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "role", "text"
    )
    return from_base.unionByName(own), convs.select("c")


def _pair(a1, a2, b1, b2):
    return F.xxhash64(a1, a2, b1, b2), F.xxhash64(F.lit(7), a1, a2, b1, b2)


def name_prefixes(rebuilt: DataFrame) -> DataFrame:
    """``(c, p, n1, n2)``: a 128-bit name of the prefix of turns 0..p of each conversation.

    Level k holds, for each turn, the name of the part of its block of 2^k turns up to it.
    Going to level k + 1 cuts each block of 2^(k+1) at half depth: turns of the upper half
    keep their names; a turn of the lower half is named by the pair (name of the full upper
    half, its own name in the lower half).
    """
    level = materialize(
        rebuilt.select(
            "c", "p",
            F.xxhash64(F.lit(1), "role", "text").alias("n1"),
            F.xxhash64(F.lit(2), "role", "text").alias("n2"),
        )
    )
    longest = level.agg(F.max("p")).first()[0]
    k = 0
    while longest is not None and (1 << k) <= longest:
        size = 1 << k
        block = F.shiftright("p", k + 1)
        lower = F.shiftright("p", k) % 2 == 1
        cut = level.where(~lower & (F.col("p") % size == size - 1)).select(
            "c", block.alias("blk"), F.col("n1").alias("u1"), F.col("n2").alias("u2")
        )
        upper_rows = level.where(~lower)
        lower_rows = level.where(lower).withColumn("blk", block).join(cut, ["c", "blk"])
        n1, n2 = _pair("u1", "u2", "n1", "n2")
        level = materialize(
            upper_rows.unionByName(lower_rows.select("c", "p", n1.alias("n1"), n2.alias("n2")))
        )
        k += 1
    return level


def _ends(members: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: SHA-256 of the ascending conv_ids that end at each node.

    The ids are sorted within partitions by (node, id) and hashed by a running digest, so a
    node with millions of ending conversations is streamed, never held whole.
    """

    def digest(batches):
        current, state = None, None
        keys, shas = [], []
        for batch in batches:
            ks = batch.column("kh").to_pylist()
            ids = batch.column("c").to_pylist()
            for key, c in zip(ks, ids):
                if key != current:
                    if current is not None:
                        keys.append(current)
                        shas.append(state.hexdigest())
                    current, state = key, hashlib.sha256(str(c).encode())
                else:
                    state.update(b"," + str(c).encode())
            if len(keys) >= 4096:
                yield pa.RecordBatch.from_pydict({"kh": keys, "ends_sha256": shas})
                keys, shas = [], []
        if current is not None:
            keys.append(current)
            shas.append(state.hexdigest())
        if keys:
            yield pa.RecordBatch.from_pydict({"kh": keys, "ends_sha256": shas})

    keyed = members.select(F.to_json("key").alias("kh"), "c")
    streamed = keyed.repartition("kh").sortWithinPartitions("kh", "c")
    done = streamed.mapInArrow(digest, "kh string, ends_sha256 string")
    return done.select(F.from_json("kh", "d bigint, n1 bigint, n2 bigint").alias("key"), "ends_sha256")


def prefix_trie(conversations: DataFrame, group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """One row per trie node, as ``RESULT`` says.

    conv_id: smallest member; depth; parent_conv_id (root: null); n_convs: members, that is
    rebuilt conversations starting with the node (a turnless one is a member of the root
    only); n_children; n_leaves: childless nodes in the subtree, itself included;
    saved_tokens: over the subtree, (n_convs - 1) times the code points of the node's last
    text (the root has none); ends_sha256: SHA-256 of the comma-joined ascending conv_ids of
    members with exactly ``depth`` turns (none: the hash of the empty string). Equal turns
    repeated in a conversation are separate turns. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    rebuilt, convs = rebuilt_turns(conversations, group, cuts)
    rebuilt = materialize(rebuilt)
    names = name_prefixes(rebuilt)
    lengths = convs.join(rebuilt.groupBy("c").agg(F.count(F.lit(1)).alias("L")), "c", "left").select(
        "c", F.coalesce("L", F.lit(0)).cast("bigint").alias("L")
    )
    if lengths.limit(1).count() == 0:
        return spark.createDataFrame([], RESULT)
    zero = F.lit(0).cast("bigint")
    prev = names.select("c", (F.col("p") + 1).alias("p"), F.col("n1").alias("q1"), F.col("n2").alias("q2"))
    paths = materialize(
        names.join(rebuilt.select("c", "p", F.char_length("text").cast("bigint").alias("len")), ["c", "p"])
        .join(prev, ["c", "p"], "left")
        .select(
            "c", (F.col("p") + 1).alias("d"), "n1", "n2", "len",
            F.coalesce("q1", zero).alias("q1"), F.coalesce("q2", zero).alias("q2"),
        )
        .unionByName(
            lengths.select(
                "c", zero.alias("d"), zero.alias("n1"), zero.alias("n2"), zero.alias("len"),
                F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"),
            )
        )
        .select("*", F.struct("d", "n1", "n2").alias("key"))
    )
    nodes = materialize(
        paths.groupBy("key").agg(
            F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        )
    )
    parent_key = F.when(F.col("key.d") > 0, F.struct((F.col("key.d") - 1).alias("d"), F.col("q1").alias("n1"), F.col("q2").alias("n2")))
    children = nodes.where("key.d > 0").groupBy(parent_key.alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(
        nodes.join(children, "key", "left").select(
            "key", "conv_id", "n_convs", "q1", "q2", F.coalesce("n_children", zero).alias("n_children")
        )
    )
    # Each path row learns its node's smallest member and whether that node is a leaf.
    owned = join_back(
        paths.select("c", "d", "len", "key"),
        nodes.select("key", "n_convs", "conv_id", "n_children"),
        "key",
        "n_convs",
    ).join(lengths, "c")
    own = F.col("c") == F.col("conv_id")
    path_order = Window.partitionBy("c").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    graded = owned.select(
        "c", "key", "n_convs",
        F.sum(F.when(own, zero).otherwise(F.col("len"))).over(path_order).alias("suffix"),
        F.max(F.when(own & (F.col("n_children") == 0) & (F.col("d") == F.col("L")), 1).otherwise(0))
        .over(Window.partitionBy("c")).alias("leaf"),
        (F.col("d") == F.col("L")).alias("ends"),
    )
    graded = materialize(graded)
    totals = graded.groupBy("key").agg(
        F.sum("suffix").cast("bigint").alias("saved_tokens"), F.sum("leaf").cast("bigint").alias("n_leaves")
    )
    ends = _ends(graded.where("ends").select("key", "c"))
    parents = nodes.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals, "key")
        .join(ends, "key", "left")
        .join(parents, parent_key == F.col("pkey"), "left")
        .select(
            "conv_id", F.col("key.d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
