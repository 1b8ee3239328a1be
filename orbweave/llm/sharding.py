"""Operator 8: sharding by fixed virtual slots.

A record's hash names one of a fixed number of virtual slots; it never changes. Bytes are summed by slot, and
a small versioned map says which shard each slot is on: slots are dealt from the largest to the least loaded
shard. Rebalancing edits the map alone; growing it by one shard moves slots to the new shard and nowhere
else. The map has as many rows as there are slots, whatever the input, so it is broadcast.

All of it is DataFrame operations. Texts are read once; what is shuffled is a narrow table, by slot.

Defined cases: a null text has size 1 and checksum 0, as an empty one; rows without an id are dealt by
their texts, so that they aren't one slot; repeated rows are separate records in the same slot; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import materialise, text_or_empty

#: Virtual slots: enough that one is a small part of a shard, few enough for a map that fits anywhere.
SLOTS, SHARDS = 4096, 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row."""
    text = text_or_empty(text_col)
    named = F.xxhash64(F.col(id_col), F.lit("slot"))
    slot = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit("slot"))).otherwise(named), F.lit(slots)).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _deal(slots: Column, loads: Column, targets: Column) -> Column:
    """Folds over slots (vslot, bytes, rows) and deals each to the least loaded of the target shards."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,bytes:bigint,rows:bigint,shard:int>>").alias("map"))

    def step(acc: Column, x: Column) -> Column:
        least = F.array_min(F.transform(targets, lambda t: F.struct(F.element_at(acc["loads"], t + 1).alias("load"), t.alias("t"))))["t"]
        more = F.transform(acc["loads"], lambda load, i: F.when(i == least, load + x["bytes"]).otherwise(load))
        put = F.array_append(acc["map"], F.struct(x["vslot"].alias("vslot"), x["bytes"].alias("bytes"), x["rows"].alias("rows"), least.cast("int").alias("shard")))
        return F.struct(more.alias("loads"), put.alias("map"))

    return F.aggregate(slots, start, step, lambda acc: acc["map"])


def build_map(sizes: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map: version, vslot, bytes, rows, shard. sizes: slot_sizes()."""
    largest = F.sort_array(F.collect_list(F.struct(F.col("bytes").alias("bytes"), F.col("vslot").alias("vslot"), F.col("rows").alias("rows"))), asc=False)
    dealt = sizes.groupBy().agg(_deal(largest, F.array_repeat(F.lit(0).cast("bigint"), shards), F.sequence(F.lit(0), F.lit(shards - 1))).alias("map"))
    return dealt.select(F.inline("map")).select(F.lit(version).alias("version"), "vslot", "bytes", "rows", "shard")


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number `shards` added: each old shard gives it its smallest slots, up to its part.

    A slot either stays where it is or goes to the new shard.
    """
    by_shard = Window.partitionBy("shard")
    given = F.sum("bytes").over(by_shard.orderBy("bytes", "vslot"))
    part = F.sum("bytes").over(by_shard) / F.lit(shards + 1)
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", "bytes", "rows", F.when(given <= part, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def edit_map(slot_map: DataFrame, sizes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The next version for new sizes: shards over the mean by more than the tolerance give slots, the others take them.

    Slots of shards within the tolerance stay, so a small drift moves few records.
    """
    now = sizes.join(F.broadcast(slot_map.select("vslot", F.col("shard"), F.col("version"))), "vslot", "left")
    version = slot_map.agg(F.max("version")).first()[0]
    shards = slot_map.agg(F.max("shard")).first()[0] + 1
    total = now.agg(F.sum("bytes")).first()[0] or 0
    most = total / shards * (1 + tolerance)
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot"))
    marked = now.withColumn("stays", (F.col("shard").isNotNull()) & (held <= most))
    loads = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    load = F.map_from_entries(F.collect_list(F.struct("shard", "load")))
    base = loads.agg(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(load[i.cast("int")], F.lit(0)).cast("bigint")).alias("loads")).first()["loads"]
    moved = F.sort_array(F.collect_list(F.struct(F.col("bytes").alias("bytes"), F.col("vslot").alias("vslot"), F.col("rows").alias("rows"))), asc=False)
    dealt = marked.filter("not stays").groupBy().agg(_deal(moved, F.array(*[F.lit(int(x)).cast("bigint") for x in base]), F.sequence(F.lit(0), F.lit(shards - 1))).alias("map")).select(F.inline("map"))
    kept = marked.filter("stays").select("vslot", "bytes", "rows", F.col("shard").cast("int").alias("shard"))
    return kept.unionByName(dealt).select(F.lit(version + 1).alias("version"), "vslot", "bytes", "rows", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version to the map's history."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version; the latest by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).select("version", "vslot", "bytes", "rows", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, map). rows: doc_id, size, text_crc32, vslot, shard and position, gapless from 0 within the shard."""
    rows = materialise(records(docs, id_col, text_col, slots), "sharding")
    slot_map = build_map(slot_sizes(rows), shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("vslot", "shard", "start")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(starts), "vslot")
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("place")).cast("long").alias("position")), slot_map
