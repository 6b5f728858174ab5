"""Fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes are summed for each slot, and a versioned map assigns slots to
shards so that the shards' bytes come out nearly equal. The map is written and read again by version; rebalancing writes the next one, in which few
slots move, and never touches the hash. The map has as many rows as there are slots, whatever the input's size, so it may be broadcast.

The hash is that of the id and the text's checksum and size, so a null or repeated id does not fill a slot. What repeats as a whole row can: a
slot above its share (``spread`` in the map) is dealt out over all slots by the place of each row in the input, which is
written down with the records once. So no slot, and no task, holds more than its share.

One scan reads the texts. Positions in a shard are prefix sums over the slot counts plus a rank inside the slot, so no task ever sorts a shard.

Edge cases: a null text has no bytes (size 1 with the separator). A null id hashes like the text "". Repeated rows get
positions of their own; among equal rows it does not matter which gets which. A very long text is one record and stays in one shard. An empty table gives
an empty result (the map then deals all slots evenly). Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactdq.llm.common import shared_dir, written

SLOTS = 4096

#: A slot of several rows with more than this part of a shard's fair share is dealt out.
MOST = 1 / 64

MAP_SCHEMA = "version int, vslot int, shard int, bytes long, spread boolean"


def virtual_slot(key, slots: int = SLOTS):
    """The slot of a key string: the first 12 bits (or more) of its MD5, so any engine can recompute it."""
    digits = max(3, (max(1, slots - 1).bit_length() + 3) // 4)
    return (F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long") % slots).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes of each of the slots, empty ones included; partial sums are made before the shuffle."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(used), "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def overfull(records: DataFrame, shards: int) -> DataFrame:
    """The slots (``vslot``; at most a few for each shard) whose rows are dealt out."""
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return sums.withColumn("every", F.sum("bytes").over(Window.partitionBy(F.lit(0)))).filter(f"n > 1 AND bytes * {int(shards / MOST)} > every").select("vslot")


def spread_out(records: DataFrame, over: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The records with the rows of some slots dealt over all slots by ``place``."""
    marked = records.join(F.broadcast(over.withColumn("spread", F.lit(True))), "vslot", "left")
    dealt = virtual_slot(F.concat_ws(":", "vslot", "place"), slots)
    return marked.withColumn("vslot", F.when(F.col("spread"), dealt).otherwise(F.col("vslot"))).drop("spread")


def _least_loaded(items: str, start: str) -> str:
    """SQL that gives items, heaviest first, to the shard with the least load so far: a fold over a bounded array."""
    return f"""aggregate({items}, named_struct('load', {start}, 'out', cast(array() AS array<struct<vslot:int,shard:int,bytes:bigint>>)),
      (acc, x) -> named_struct(
        'load', transform(acc.load, (l, i) -> CASE WHEN i = array_position(acc.load, array_min(acc.load)) - 1 THEN l + x.bytes ELSE l END),
        'out', array_append(acc.out, named_struct('vslot', x.vslot, 'shard', int(array_position(acc.load, array_min(acc.load)) - 1), 'bytes', x.bytes))),
      acc -> acc.out)"""


def new_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A first map: slots by falling bytes, each to the shard with the fewest bytes so far."""
    heavy = loads.agg(F.expr("array_sort(collect_list(struct(vslot, bytes)), (a, b) -> CASE WHEN a.bytes > b.bytes THEN -1 WHEN a.bytes < b.bytes THEN 1 ELSE int(a.vslot - b.vslot) END)").alias("items"))
    dealt = heavy.select(F.explode(F.expr(_least_loaded("items", f"array_repeat(0L, {int(shards)})"))).alias("m"))
    return dealt.select(F.lit(version).cast("int").alias("version"), "m.vslot", "m.shard", "m.bytes", F.lit(False).alias("spread"))


def rebalanced(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new loads or another number of shards.

    Slots stay where they are as long as their shard exists and stays within its fair part of all bytes; the others
    (the last of an overfull shard in slot order) are dealt out again, heaviest first, to the least loaded shards.
    """
    now = old.select("version", "vslot", "shard").join(loads, "vslot")
    every = Window.partitionBy(F.lit(0))
    run = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = now.withColumn("upto", F.sum("bytes").over(run)).withColumn("stays", (F.col("shard") < shards) & (F.col("upto") <= F.ceil(F.sum("bytes").over(every) / F.lit(shards))))
    held = F.expr(
        f"transform(sequence(0, {int(shards) - 1}), s -> aggregate(filter(rows, r -> r.stays AND r.shard = s), 0L, (t, r) -> t + r.bytes))"
    )
    one = marked.agg(F.max("version").alias("version"), F.collect_list(F.struct("vslot", "shard", "bytes", "stays")).alias("rows"))
    one = one.withColumn("held", held).withColumn("moving", F.expr("array_sort(transform(filter(rows, r -> NOT r.stays), r -> named_struct('vslot', r.vslot, 'bytes', r.bytes)), (a, b) -> CASE WHEN a.bytes > b.bytes THEN -1 WHEN a.bytes < b.bytes THEN 1 ELSE int(a.vslot - b.vslot) END)"))
    kept = F.expr("transform(filter(rows, r -> r.stays), r -> named_struct('vslot', r.vslot, 'shard', r.shard, 'bytes', r.bytes))")
    dealt = one.select("version", F.explode(F.concat(kept, F.expr(_least_loaded("moving", "held")))).alias("m"))
    known = old.select("vslot", "spread")
    return dealt.select((F.col("version") + 1).cast("int").alias("version"), "m.vslot", "m.shard", "m.bytes").join(F.broadcast(known), "vslot").select("version", "vslot", "shard", "bytes", "spread")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to a folder of maps."""
    slot_map.coalesce(1).write.mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, the last one if none is named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(folder)
    return maps.filter(F.col("version") == (maps.agg(F.max("version")).first()[0] if version is None else version))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Id, size in bytes with the separator, CRC-32 of the text, virtual slot and place in the input of every record."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("place")
    )
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    return base.withColumn("vslot", virtual_slot(key, slots))


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and ``slot``, its place in that shard from 0 without gaps."""
    counts = records.groupBy("vslot").agg(F.count("*").alias("n"))
    within = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("version", "vslot", "shard").join(F.broadcast(counts), "vslot").withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    rank = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "place")
    ranked = records.withColumn("rank", F.row_number().over(rank) - 1)
    return ranked.join(F.broadcast(starts.select("vslot", "shard", "version", "first")), "vslot").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank")).cast("long").alias("slot"), "vslot", F.col("version").alias("map_version")
    )


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None, rebalance_to: int | None = None
) -> DataFrame:
    """Shard and place of every record under the last map of ``folder``; where there is none, a first map is made for these records and written there.

    With ``rebalance_to``, the next version of the map is made for that many shards, written too, and gives ``rebalanced_shard``.
    """
    spark = docs.sparkSession
    records = written(sized(docs, id_col, text_col, slots), "records")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder or f"{shared_dir(spark)}/slot-map")
    folder = place.toString()
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        over = load_map(spark, folder).filter("spread").select("vslot")
        records = spread_out(records, over, slots)
    else:
        over = written(overfull(records, shards), "overfull")
        records = spread_out(records, over, slots)
        first = new_map(slot_bytes(records, slots), shards)
        marks = over.withColumn("over", F.lit(True))
        save_map(first.join(F.broadcast(marks), "vslot", "left").select("version", "vslot", "shard", "bytes", F.coalesce("over", F.lit(False)).alias("spread")), folder)
    now = load_map(spark, folder)
    found = placed(records, now)
    if rebalance_to is None:
        return found
    save_map(written(rebalanced(now, slot_bytes(records, slots), rebalance_to), "next"), folder)
    after = load_map(spark, folder).select("vslot", F.col("shard").cast("int").alias("rebalanced_shard"))
    return found.join(F.broadcast(after), "vslot").select(*found.columns, "rebalanced_shard")
