"""Shards by fixed virtual slots, with DataFrame functions alone.

A record's id is hashed into one of thousands of virtual slots, for good. Bytes are added up a slot, and a map of slots to
shards is kept as a table of versions: version 0 deals slots out by their numbers, and each later version is an edit of the one
before, made from the slots' bytes. Whatever the number of records, a map has one row a slot, and records move with their slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.session import shared_dir, written

#: Virtual slots. The number holds for every size of a corpus: a record's slot never changes.
SLOTS = 8192
#: Bytes that a record has besides its text's.
OVERHEAD = 8
#: Edits that follow the first map. Each lets a shard keep its largest slots, so the second mends what a large slot has displaced.
EDITS = 3


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of an id; rows without one are dealt by their texts."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), F.coalesce(text, F.lit(""))))), F.lit(slots)).cast("int")


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) a row: what sharding needs to know of a record, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col(id_col), F.col(text_col), slots).alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): one row a slot that has records, added up in part before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, shard): slots dealt out by their numbers."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def _kept(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map with bytes, and `stays`: whether a shard's slots, the largest first, still fit its even share; its largest always does."""
    held = slot_map.select("virtual_slot", "shard").join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    # A window over a shard's slots, of which there are as many as the map has rows at most.
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    share = held.agg((F.sum("bytes") / shards).alias("share")).scalar()
    held = held.withColumns({"place": F.row_number().over(largest_first), "upto": F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0))})
    return held.withColumn("stays", (F.col("shard") < shards) & ((F.col("place") == 1) | (F.col("upto") <= share)))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map, edited so that the shards 0 to shards - 1 have about equal bytes.

    A shard keeps its largest slots as far as its even share goes. The others, the largest first, go each to the shard that has
    least so far. Slots of a shard that has no more than its share stay where they are. The fold runs over the slots of a map,
    a fixed number.
    """
    held = _kept(slot_map, sizes, shards)
    # What stays comes first, then what is free, the largest first.
    slots = held.agg(F.sort_array(F.collect_list(F.struct((~F.col("stays")).alias("free"), (-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"))

    def deal(state: Column, slot: Column) -> Column:
        to = F.when(slot["free"], F.array_position(state["loads"], F.array_min(state["loads"])) - 1).otherwise(slot["shard"]).cast("int")
        moves = F.when(slot["free"], F.concat(state["moves"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("to"))))).otherwise(state["moves"])
        return F.struct(F.transform(state["loads"], lambda load, i: F.when(i == to, load - slot["less"]).otherwise(load)).alias("loads"), moves.alias("moves"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<virtual_slot:int,to:int>>").alias("moves"))
    moves = slots.select(F.explode(F.aggregate("slots", start, deal)["moves"]).alias("move")).select("move.*")
    return slot_map.select("virtual_slot", "shard").join(moves, "virtual_slot", "left").select("virtual_slot", F.coalesce("to", "shard").alias("shard"))


def grown(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map of one more shard, number `shards`: each other gives it the slots that exceed its new share, and gets none."""
    return _kept(slot_map, sizes, shards + 1).select("virtual_slot", F.when(F.col("stays"), F.col("shard")).otherwise(F.lit(shards)).alias("shard"))


class MapStore:
    """Versions of a slot map under a path, one folder each. A version is written once: a second writer of it fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, slot_map: DataFrame, version: int) -> DataFrame:
        slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")

    def latest(self) -> int:
        """The last version's number."""
        return self.spark.read.parquet(self.path).agg(F.max("version")).first()[0]


def balanced_map(store: MapStore, sizes: DataFrame, shards: int, *, slots: int = SLOTS, edits: int = EDITS) -> tuple[DataFrame, int]:
    """The first map and its edits for these sizes, all committed; the last and its version."""
    current, version = store.commit(first_map(store.spark, shards, slots), 0), 0
    for version in range(1, edits + 1):
        current = store.commit(rebalanced(current, sizes, shards), version)
    return current, version


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """rows with their shard, and slot: their place in it from 0, without gaps.

    A shard's virtual slots follow each other, and so do a virtual slot's rows by id, so no task ranks a whole shard. Rows that
    repeat an id share a virtual slot; rows without an id come first in theirs.
    """
    known = slot_map.join(sizes, "virtual_slot")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    known = known.select("virtual_slot", "shard", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")) - 1
    return rows.withColumn("slot", place).join(known, "virtual_slot").withColumn("slot", (F.col("slot") + F.col("before")).cast("long")).drop("before")


def shard_documents(docs: DataFrame, shards: int, *, store: MapStore | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, edits: int = EDITS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, slot, shard, map_version) a row: shards of about equal bytes.

    A null text has no bytes, a null id is dealt by its text, and an empty table gives no rows. Copies of a text are dealt out by
    their ids like all others, so no group of them fills a shard. Rows that repeat an id go together, as a slot is the least that
    moves: should one id hold more than a shard's even share, its shard has nothing else. Other columns are left out; what is
    shuffled are these few numbers, never texts. `with_shards` gives documents their shard without a shuffle.
    """
    spark = docs.sparkSession
    rows = written(records(docs, id_col=id_col, text_col=text_col, slots=slots), "records")
    sizes = written(slot_sizes(rows), "slot_sizes")
    slot_map, version = balanced_map(store or MapStore(spark, f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"), sizes, shards, slots=slots, edits=edits)
    return placed(rows, sizes, slot_map, id_col=id_col).withColumn("map_version", F.lit(version))


def with_shards(docs: DataFrame, slot_map: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs with a column `shard`, for a write partitioned by it. The map has one row a slot, so it is broadcast."""
    known = slot_map.select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("shard"))
    return docs.drop("shard").withColumn("__slot", virtual_slot(F.col(id_col), F.col(text_col), slots)).join(F.broadcast(known), "__slot").drop("__slot")


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
