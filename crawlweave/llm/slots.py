"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes are summed per slot, and a slot-to-shard map is stored under a version. Rebalancing
edits the map: only slots that must move do."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlweave.runtime import new_path, small, written

SLOTS, SHARDS = 4096, 8
MAP = "slot int, shard int, bytes long, count long"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, virtual_slot of each row of docs(doc_id, text).

    The record's key decides its slot, so an edited text stays where it is. Only rows that share an id, or have none, are told apart by
    their text and, where that is equal too, by a number, so one id with very many rows is spread over all slots."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    kinds = written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "slot-rows")
    often = written(kinds.groupBy("doc_id").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("doc_id").alias("again")), "slot-repeats")
    each = kinds.join(small(often), F.col("doc_id").eqNullSafe(F.col("again")), "left")
    repeats = F.col("again").isNotNull() | F.col("doc_id").isNull()
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    own = F.when(repeats, F.xxhash64("doc_id", "text_crc32", "copy")).otherwise(F.xxhash64("doc_id"))
    return each.select("doc_id", "size", "text_crc32", "copy", F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"))


def loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: one row for each of the fixed slots, at most."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def balanced(load: dict[int, tuple[int, int]], shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """A first map: slots by falling bytes, each to the shard that has least."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-load.get(s, (0, 0))[0], s)):
        have, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (have + load.get(slot, (0, 0))[0], shard))
    return out


def rebalanced(old: dict[int, int], load: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """The old map with as few slots moved as bring every shard near the mean. Slots of shards that are gone move first; with one
    more shard, slots move only into it."""
    size = lambda s: load.get(s, (0, 0))[0]
    out = dict(old)
    have = [0] * shards
    homeless = []
    for slot, shard in out.items():
        if shard < shards:
            have[shard] += size(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size(s), s)):
        out[slot] = min(range(shards), key=lambda x: (have[x], x))
        have[out[slot]] += size(slot)
    mean = sum(have) / shards
    new = [s for s in range(shards) if s > max(old.values(), default=-1)]
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        own[shard].append(slot)
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda s: (-size(s), s)):
            if have[shard] <= mean * (1 + tolerance) or not size(slot) or shard in new:
                continue
            to = min(new or range(shards), key=lambda x: (have[x], x))
            if have[shard] - size(slot) >= mean * (1 - tolerance) and have[to] + size(slot) <= mean * (1 + tolerance):
                out[slot] = to
                have[shard], have[to] = have[shard] - size(slot), have[to] + size(slot)
    return out


def save(spark: SparkSession, folder: str, version: int, shard_of: dict[int, int], load: dict[int, tuple[int, int]]) -> None:
    """Writes the map as a version that must be new; older versions stay readable."""
    rows = [(s, x, *load.get(s, (0, 0))) for s, x in sorted(shard_of.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{folder}/version={version}")


def read(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r[0]: r[1] for r in spark.read.schema(MAP).parquet(f"{folder}/version={version}").select("slot", "shard").collect()}


def placed(rows: DataFrame, shard_of: dict[int, int], load: dict[int, tuple[int, int]]) -> DataFrame:
    """rows with shard and slot, the record's place in its shard, gapless from 0: slots follow each other, records of a slot by id."""
    base, at = {}, {}
    for slot in sorted(shard_of):
        shard = shard_of[slot]
        base[slot] = at.get(shard, 0)
        at[shard] = base[slot] + load.get(slot, (0, 0))[1]
    table = rows.sparkSession.createDataFrame([(s, shard_of[s], base[s]) for s in sorted(shard_of)], "virtual_slot int, shard int, base long")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    ranked = rows.withColumn("place", F.row_number().over(w) - 1)
    return ranked.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("base") + F.col("place")).drop("base", "place", "copy")  # as many rows as slots


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of each row of docs(doc_id, text); shards are near equal in bytes.

    Null and empty texts have size 1. Rows that repeat an id, with other or equal texts, and rows of null id are spread over the slots. The map is saved as version 1 of folder. Other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = written(slotted(docs, slots), "slotted")
    load = loads(rows)
    first = balanced(load, shards, slots)
    save(spark, folder or new_path(spark, "slot-map"), 1, first, load)
    return placed(rows, first, load)
