"""Mixing sources to target weights with DataFrame functions only.

Words are summed per source, targets are set by weight under a ceiling, and the rate of a source is its target over its
words. Each document is emitted floor(rate) times, and once more if its seeded hash, a number in [0, 1), lies below the
rate's fraction.

Defined cases: a null or blank text has size 0 and counts nothing; the null source is a source of its own, ordered last;
documents with equal ids draw the same number (a null id draws by its text); a source without words has target 0 and
emits nothing; very long texts are counted whole; sources with equal ceiling over weight fill in order of source; an empty
table gives an empty mix; `mixed` keeps every column of its input, also those named like the columns computed here.

The table of sources has a row per source, not per document: it is shared out in one task, as levels need all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, record_key, stored

#: Up to so many sources, the table of sources is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def drawn(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of a digest of seed and record: any engine gives the same."""
    digest = F.md5(F.concat(F.lit(seed + ":"), record_key(doc_id, text)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size, target, rate. Weights repeat over sources in order. A source that its weight would lift
    above ceiling * source_size stops there, and the rest is shared again by weight: in order of ceiling over weight,
    the sources below some level are full and all others get level * weight."""
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.asc_nulls_last("source"))
    filling = everything.orderBy("full_at", F.asc_nulls_last("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sums.withColumn("place", F.row_number().over(ordered)).withColumn("weight", weight)
    rows = rows.withColumn("most", F.col("source_size") * F.lit(ceiling)).withColumn("full_at", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    over = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level_here", left / over)
    level = F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "level_here"))).over(everything)
    rows = rows.withColumn("level", level["level_here"])
    target = F.round(F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))), 6)
    return rows.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: str = SEED) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `copies`, the times that the mix takes the document."""
    doc_id, text = F.col("doc_id"), F.col("text")
    sized = docs.drop("size", "source_size", "target", "copies").withColumns({"size": n_words(text), "__drawn": drawn(doc_id, text, seed)})
    sources = stored(source_targets(sized.select("source", "size"), weights, share, ceiling), "mix_sources")
    sources = sources.withColumnRenamed("source", "__source").withColumnRenamed("rate", "__rate")
    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    whole = F.floor("__rate")
    copies = (whole + F.when(F.col("__drawn") < F.col("__rate") - whole, 1).otherwise(0)).cast("int")
    return sized.join(side, F.col("source").eqNullSafe(F.col("__source"))).withColumn("copies", copies).drop("__source", "__rate", "__drawn")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the columns of docs with their values, whatever their names, each document as often as it is taken."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    taken = with_copies(packed, **kw).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    rows = with_copies(docs.select("doc_id", "text", "source"), **kw)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS drawn
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sums
), levels AS (
  SELECT *, most / weight AS full_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level_here
  FROM weighed
), targets AS (
  SELECT source, source_size, round(least(most, coalesce((SELECT arg_min(level_here, full_at) FROM levels WHERE level_here <= full_at) * weight, most)), 6) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), taken AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, s.source, CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM taken
"""
