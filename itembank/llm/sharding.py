"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. Bytes are summed per slot, and a versioned table maps slots to shards.
Rebalancing edits that table only: it moves whole slots, and every record follows its slot.

Defined cases: a null text counts no bytes; a null key is replaced by a digest of the text; equal keys share a slot;
an empty table gives an empty result and a map of empty slots; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import fresh_dir
from .common import n_bytes, record_key

N_SLOTS = 4096
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long, first_position long"


def with_virtual_slot(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, overhead: int = 8) -> DataFrame:
    """docs with `size` (UTF-8 bytes and an overhead per record) and `virtual_slot` in [0, n_slots)."""
    slot = F.pmod(F.xxhash64(record_key(F.col(key), F.col(text))), F.lit(n_slots)).cast("int")
    return docs.withColumns({"size": n_bytes(F.col(text)) + F.lit(overhead).cast("long"), "virtual_slot": slot})


def slot_loads(slotted: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot. At most n_slots rows reach the driver, whatever the input's size."""
    loads = [(0, 0)] * n_slots
    for slot, size, rows in slotted.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        loads[slot] = (size, rows)
    return loads


def dealt(n_slots: int, n_shards: int) -> list[int]:
    """The first version of a map: slots dealt in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalanced(shard_of: Sequence[int], slot_bytes: Sequence[int], n_shards: int) -> list[int]:
    """An edited map. Slots move one at a time from the fullest shard to the emptiest for as long as that narrows
    their gap, so slots that need not move stay. Shards that are new start empty."""
    shard_of = list(shard_of)
    members: list[set[int]] = [set() for _ in range(n_shards)]
    load = [0] * n_shards
    for slot, shard in enumerate(shard_of):
        members[shard].add(slot)
        load[shard] += slot_bytes[slot]
    while True:
        full, empty = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        movable = [s for s in members[full] if 0 < slot_bytes[s] < gap]
        if not movable:
            return shard_of
        slot = min(movable, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
        members[full].remove(slot)
        members[empty].add(slot)
        shard_of[slot] = empty
        load[full] -= slot_bytes[slot]
        load[empty] += slot_bytes[slot]


def save_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int], loads: Sequence[tuple[int, int]]) -> None:
    """Write one version of the map below path. Earlier versions stay and can be read again."""
    position: dict[int, int] = {}
    rows = []
    for slot, (shard, (size, count)) in enumerate(zip(shard_of, loads, strict=True)):
        rows.append((slot, shard, size, count, position.get(shard, 0)))
        position[shard] = position.get(shard, 0) + count
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").withColumn("map_version", F.lit(version))


def balanced_map(slotted: DataFrame, n_shards: int, n_slots: int = N_SLOTS, path: str | None = None) -> tuple[str, int]:
    """Store version 1 (dealt) and version 2 (rebalanced on the measured bytes); return the folder and the version to use."""
    spark = slotted.sparkSession
    path = path or fresh_dir(spark, "slot_map")
    loads = slot_loads(slotted, n_slots)
    first = dealt(n_slots, n_shards)
    save_map(spark, path, 1, first, loads)
    save_map(spark, path, 2, rebalanced(first, [b for b, _ in loads], n_shards), loads)
    return path, 2


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `size`, `virtual_slot`, `shard` and `map_version`. The map has n_slots rows, so it is broadcast."""
    slotted = with_virtual_slot(docs, key, text, n_slots)
    at = load_map(docs.sparkSession, *balanced_map(slotted.select("size", "virtual_slot"), n_shards, n_slots))
    return slotted.drop("shard", "map_version").join(F.broadcast(at.select("virtual_slot", "shard", "map_version")), "virtual_slot")


def sharded_positions(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS) -> DataFrame:
    """Per document its shard and its place there (`slot`, gapless from 0): rows are numbered inside each virtual slot
    and shifted by the rows of the slots before it in the shard, so no task holds a whole shard."""
    text = F.col("text")
    slim = with_virtual_slot(docs.select("doc_id", "text"), n_slots=n_slots).withColumn("text_crc32", F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))).drop("text")
    at = load_map(docs.sparkSession, *balanced_map(slim.select("size", "virtual_slot"), n_shards, n_slots))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return slim.withColumn("rank", rank).join(F.broadcast(at), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_position") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
