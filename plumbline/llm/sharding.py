"""Sharding over fixed virtual slots, with DataFrame functions only.

Records hash into SLOTS virtual slots, whose number never changes. The bytes of each slot
are summed, and a slot-to-shard map is made: largest slot first, always into the lightest
shard, so shards come out near equal in bytes. The map is a small table that is stored, a
folder for each version. A later run reads the last version and keeps it while it serves;
else rebalanced() edits it and the edit is stored as the next version: whole slots move, and
rows move with their slot; the hash of a record never changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, stored

SLOTS = 4096
SHARDS = 24
DRIFT = 0.02  # over the mean, besides one slot, that a kept map may go
OVERHEAD = 8  # bytes that a record takes besides its text


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(slots: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_stats(rows: DataFrame) -> DataFrame:
    """rows(vslot, size) -> vslot, bytes, rows: at most SLOTS of them."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(slots: DataFrame, loads: Column | DataFrame, shards: int) -> DataFrame:
    """vslot, bytes, rows, shard: largest slot first into the lightest shard, over the given loads (one row: `loads`).

    The fold runs over at most SLOTS entries in one task.
    """
    ordered = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "rows"))).alias("s"))
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, x: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda load, i: F.when(i + 1 == lightest, load - x["minus"]).otherwise(load)).alias("loads"),
            F.concat(acc["to"], F.array(lightest - 1)).alias("to"),
        )

    dealt = ordered.join(loads).select("s", F.aggregate("s", start, put, lambda acc: acc["to"]).alias("to"))  # one row each
    return dealt.select(F.explode(F.arrays_zip("s", "to")).alias("x")).select("x.s.vslot", (-F.col("x.s.minus")).alias("bytes"), "x.s.rows", F.col("x.to").alias("shard"))


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """version 1: vslot, bytes, rows, shard."""
    empty = stats.sparkSession.range(1).select(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"))
    return _dealt(stats, empty, shards).withColumn("version", F.lit(1))


def rebalanced(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of the map: for more or fewer shards, new slots or loads that have drifted apart.

    A shard over the new mean hands slots over, in a fixed order of their hashes, as long as it
    stays at or above the mean; a shard that is gone hands over all. They and the slots that are
    new are dealt, largest first, to the lightest. Nothing else moves: one more shard takes from
    all others and nothing passes between those.
    """
    now = stats.join(slot_map.select("vslot", "shard", "version"), "vslot", "left").withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    mean = F.sum("bytes").over(W.partitionBy(F.lit(0))) / shards  # at most SLOTS rows
    now = now.withColumn("mean", mean).withColumn("load", F.sum("bytes").over(W.partitionBy("shard")))
    handed = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.xxhash64("vslot", "shard"), "vslot"))
    version = F.max("version").over(W.partitionBy(F.lit(0))) + 1
    moves = F.col("shard").isNull() | (F.col("load") - handed >= F.col("mean"))
    now = stored(now.select("vslot", "bytes", "rows", "shard", moves.alias("moves"), version.alias("version")))
    kept = now.where("not moves")
    held = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))  # an entry for each shard
    loads = held.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("loads"))
    dealt = _dealt(now.where("moves"), loads, shards).join(now.agg(F.max("version").alias("version")))  # one row
    return kept.select("vslot", "bytes", "rows", "shard", "version").unionByName(dealt)


def uneven(slot_map: DataFrame, stats: DataFrame, shards: int) -> bool:
    """Does a map serve no more: slots without a shard, another number of shards, or one DRIFT over the mean?"""
    now = stats.join(slot_map.select("vslot", "shard"), "vslot", "left")
    by = now.groupBy("shard").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("largest"))
    over = F.max("b") > F.sum("b") / shards * (1 + DRIFT) + F.max("largest")
    r = by.agg(F.count_if(F.col("shard").isNull()).alias("new"), F.count("shard").alias("n"), F.max("shard").alias("top"), over.alias("over")).first()  # one row
    have = slot_map.agg(F.max("shard")).first()[0]
    return bool(r.new or r.over or have is None or have + 1 != shards)


def last_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the map stored under path, None if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    versions = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if s.getPath().getName().startswith("version=")]
    return spark.read.parquet(f"{path}/version={max(versions)}").withColumn("version", F.lit(max(versions))) if versions else None


def kept_map(spark: SparkSession, path: str, stats: DataFrame, shards: int) -> DataFrame:
    """The map to use for stats: the stored one while it serves, else its edit or the first, stored as a version of its own."""
    last = last_map(spark, path)
    if last is not None and not uneven(last, stats, shards):
        return last
    new = stored(first_map(stats, shards) if last is None else rebalanced(last, stats, shards))
    version = new.agg(F.max("version")).first()[0] or 1  # one row
    new.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")
    return last_map(spark, path)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard and slot, a row's place in its shard (0, 1, ... without a gap).

    A place is the slot's first place plus the row's number in its virtual slot, so no task
    holds more than a slot's narrow rows.
    """
    now = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")  # at most SLOTS rows
    before = F.sum("n").over(W.partitionBy("shard").orderBy("vslot")) - F.col("n")
    begin = F.broadcast(now.select("vslot", "shard", before.alias("begin")))
    number = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("number", number).join(begin, "vslot").withColumn("slot", (F.col("begin") + F.col("number")).cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of every row.

    maps: the folder with the versions of the slot map; a run that names it again goes on from
    the last version. Without, the map begins anew in the shared folder.

    A group of equal texts can hold a third of all bytes, which no law of equal sizes allows in
    one shard: virtual slots hash the id, checksum and size, so copies of a text are split over
    the slots and shards. Null texts have size OVERHEAD and no checksum; null ids hash like a
    value. Rows equal in all three are numbered within an input partition and from the second
    on hash their number too, so they spread as well; such rows may change slots if the input
    is partitioned anew, all others never do. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", record_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("read_by"))
    known = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    again = F.row_number().over(W.partitionBy(*known, "read_by").orderBy("size")) - 1  # at most an input partition's rows
    vslot = F.when(F.col("again") == 0, slot_of(slots, *known)).otherwise(slot_of(slots, *known, F.col("again")))
    rows = stored(rows.withColumn("again", again).select(*known, vslot.alias("vslot")))
    path = maps or f"{shared_folder(spark)}/slot-maps-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    slot_map = kept_map(spark, path, stored(slot_stats(rows)), shards)
    return placed(rows, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
