"""Shards of near equal size by fixed virtual slots and a versioned slot map.

A record's hash gives its virtual slot for good; there are thousands of slots, whatever the
corpus. Bytes are summed per slot, and a map deals slots to shards, largest first, each to
the shard with the fewest bytes. The map is a small table with a version. Rebalancing edits
it: only slots named in the new version move. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

SLOTS = 4096


def record_hash(key: Column) -> Column:
    """A number below 2**32 from the first hex digits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def slot_bytes(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(vslot, bytes)`` for every slot, empty ones too."""
    every = placed.sparkSession.range(slots).select(F.col("id").alias("vslot"))
    summed = placed.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    return every.join(summed, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def deal_slots(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A slot map ``(version, vslot, shard)``: the largest slot first, to the lightest shard.

    ``sizes`` has one row per slot, so the fold over all of them has a fixed bound.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"),
        F.array().cast("array<struct<vslot:bigint,shard:int>>").alias("dealt"),
    )

    def put(acc: Column, slot: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(
            acc["loads"], lambda x, i: F.when(i == lightest, x - slot["minus"]).otherwise(x)
        )
        entry = F.struct(slot["vslot"].alias("vslot"), lightest.alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(acc["dealt"], F.array(entry)).alias("dealt"))

    dealt = sizes.agg(F.aggregate(ordered, start, put, lambda acc: acc["dealt"]).alias("dealt"))
    return dealt.select(F.explode("dealt").alias("d")).select(
        F.lit(version).alias("version"), "d.vslot", "d.shard"
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new slot sizes or a new number of shards.

    Every shard keeps its slots, smallest first, up to an even share of the bytes; only
    the rest, and slots of shards that no longer exist, move to the shards with room, in
    order. One row per slot, so the sort of all of them has a fixed bound.
    """
    rows = slot_map.join(sizes, "vslot")
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    held = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("share", share).withColumn("upto", F.sum("bytes").over(held)).withColumn(
        "stays", (F.col("upto") <= F.col("share")) & (F.col("shard") < shards)
    )
    kept = marked.where("stays")
    load = kept.groupBy("shard").agg(F.sum("bytes").alias("load"))
    room = (
        marked.sparkSession.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(load, "shard", "left")
        .crossJoin(marked.select("share").limit(1))
        .select("shard", (F.col("share") - F.coalesce("load", F.lit(0))).alias("room"))
    )
    whole = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = room.withColumn("high", F.sum("room").over(whole)).withColumn("low", F.col("high") - F.col("room"))
    line = Window.orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    moving = marked.where("not stays").select("version", "vslot", "bytes").withColumn(
        "middle", F.sum("bytes").over(line) - F.col("bytes") / 2
    )
    moved = moving.join(
        room, (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")), "left"
    ).select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("shard", F.lit(shards - 1)).alias("shard"))
    return kept.select((F.col("version") + 1).alias("version"), "vslot", "shard").union(moved)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map table; earlier versions stay for readers that use them."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest by default."""
    table = spark.read.parquet(path).select("version", "vslot", "shard")
    chosen = F.lit(version) if version is not None else table.agg(F.max("version")).scalar()
    return table.where(F.col("version") == chosen)


def sized_records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """``(id, size, text_crc32, hash, vslot)`` of each row.

    ``size`` is the text's UTF-8 bytes plus one; a null text is an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = record_hash(F.col(id_col))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed.alias("hash"),
        (hashed % slots).alias("vslot"),
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    slot_map: DataFrame | None = None,
) -> DataFrame:
    """Every row's shard and its place there: ``(id_col, size, text_crc32, law, shard, slot,
    grown_shard, vslot)``.

    The law is ``bytes``: shards get nearly equal bytes. ``slot`` counts from 0 within the
    shard without gaps, by virtual slot and then by id. Rows of one id share a virtual slot,
    null ids too, and each has its own place; an empty table gives no rows. ``slot_map``
    takes a stored map in place of a fresh one.
    """
    placed = sized_records(docs, id_col, text_col, slots)
    if slot_map is None:
        slot_map = deal_slots(slot_bytes(placed, slots), shards)
    counts = placed.groupBy("vslot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        slot_map.join(counts, "vslot")
        .select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("vslot").orderBy("hash", "id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    # The map has one row per virtual slot: a fixed bound, so it is broadcast.
    return ranked.join(F.broadcast(bases), "vslot").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
