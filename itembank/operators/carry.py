"""Ordered windows over keys of any size, in two levels.

Rows are dealt by ranges of (keys, order) into chunks that are kept as a table; a window runs inside each chunk, and what
goes over a chunk's border (the last value, a sum, the first row of the next chunk) is carried by a short table of chunk
ends. Only the first and the last key of a range can go over its borders, so that table has at most two rows a chunk and is
broadcast. The largest task is a range, however many rows one key has.

Results equal those of the plain window. `order` must tell the rows of a key apart; keys are not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import checkpointed

CHUNK = "_chunk"


def in_chunks(rows: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """rows with their chunk, kept: ranges of (keys, order), as many as shuffle partitions by default."""
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def _inside(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(CHUNK, *keys).orderBy(*order)


def _ends(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """A row per key and chunk, of keys that lie in more than one."""
    ends = rows.groupBy(*keys, CHUNK).agg(*[v.alias(n) for n, v in values.items()])
    return ends.withColumn("_many", F.count("*").over(Window.partitionBy(*keys))).where("_many > 1").drop("_many")


def _joined(rows: DataFrame, ends: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """ends of both levels, at most two rows a chunk."""
    right = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(CHUNK).alias("_c"), *names)
    on = F.col(CHUNK) == F.col("_c")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    return rows.join(F.broadcast(right), on, "left").drop("_c", *[f"_k{i}" for i in range(len(keys))])


def carry_last(rows: DataFrame, keys: list[str], order: list[str], include: bool = True, **values: Column) -> DataFrame:
    """rows(in chunks) with, per name, the last value that is not null up to the row (include) or before it."""
    stop = 0 if include else -1
    past = _inside(keys, order).rowsBetween(Window.unboundedPreceding, stop)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = _ends(rows, keys, **{f"_e_{n}": F.max_by(v, F.when(v.isNotNull(), place)) for n, v in values.items()})
    ends = ends.withColumns({f"_b_{n}": F.last(f"_e_{n}", ignorenulls=True).over(before) for n in values})
    local = rows.withColumns({n: F.last(v, ignorenulls=True).over(past) for n, v in values.items()})
    out = _joined(local, ends, keys, [f"_b_{n}" for n in values])
    return out.withColumns({n: F.coalesce(n, f"_b_{n}") for n in values}).drop(*[f"_b_{n}" for n in values])


def carry_sum(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """rows(in chunks) with, per name, the sum of the values up to and with the row."""
    past = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = _ends(rows, keys, **{f"_e_{n}": F.sum(v) for n, v in values.items()})
    ends = ends.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)) for n in values})
    local = rows.withColumns({n: F.sum(v).over(past) for n, v in values.items()})
    out = _joined(local, ends, keys, [f"_b_{n}" for n in values])
    return out.withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in values}).drop(*[f"_b_{n}" for n in values])


def carry_next(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """rows(in chunks) with, per name, the value of the key's next row; null at its last."""
    after = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = _ends(rows, keys, **{f"_e_{n}": F.min_by(v, F.struct(*order)) for n, v in values.items()})
    ends = ends.withColumns({f"_b_{n}": F.lead(f"_e_{n}").over(after) for n in values})
    inside = _inside(keys, order)
    local = rows.withColumns({"_last": F.lead(F.lit(1)).over(inside).isNull(), **{n: F.lead(v).over(inside) for n, v in values.items()}})
    out = _joined(local, ends, keys, [f"_b_{n}" for n in values])
    return out.withColumns({n: F.when(F.col("_last"), F.col(f"_b_{n}")).otherwise(F.col(n)) for n in values}).drop("_last", *[f"_b_{n}" for n in values])
