"""Mixing sources to target weights.

Each source's words are summed, the words asked for are shared out by weight, and a source that would
pass `most` times its size stops there while the others share the rest. A document is emitted
floor(rate) times and once more if a hash of its identity and text falls below the fraction of the rate:
the same rows give the same mix on every run and any cluster.

A null source is a source of its own, after all others; null text has no words; rows that repeat draw
alike; an empty table or a table without words gives targets of 0 and no copies. Sources may be many: their ranks and sums are
taken in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: So many sources at most are broadcast; more are joined by shuffle, where Spark splits skewed keys.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with _rank, the number of each source by code point, nulls last: ranks within sorted partitions, and what partitions before hold."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(sizes.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "mix-parts")
    # a row a partition: as many as the session has shuffle partitions, however many sources there are
    held = parts.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.join(F.broadcast(held.select("_part", "_before")), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    return ranked.withColumn("_rank", rank).drop("_part", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Filling by weight with an upper bound of most * source_size has one solution: an amount per unit of weight, at which the sources
    whose bound it passes stop, and all others share what these leave. The amount is found by sums over all sources, which
    stop more of them each time until no more do.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = _ranked(sizes).withColumn("weight", weight).withColumn("_bound", most * F.col("source_size")).drop("_rank")
    ranked = materialize(ranked, "mix-ranked")
    total, all_weights = ranked.agg(share * F.sum("source_size"), F.sum("weight")).first()
    amount, stopped = (total or 0.0) / (all_weights or 1.0), -1
    while True:
        stops = F.col("weight") * F.lit(amount) >= F.col("_bound")
        n, bounds, left = ranked.agg(F.count_if(stops), F.sum(F.when(stops, F.col("_bound"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if n == stopped or not left:
            break
        amount, stopped = (total - (bounds or 0.0)) / left, n
    return ranked.select("source", "source_size", "weight", F.when(stops, F.col("_bound")).otherwise(F.col("weight") * F.lit(amount)).alias("target"))


def draw(seed: str, *columns: str) -> Column:
    """A number in [0, 1) from an MD5 of the seed and the columns; nulls differ from empty values."""
    parts = [F.concat(F.lit("="), F.col(c).cast("string")) for c in columns]
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p, F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _checked(shares: DataFrame) -> DataFrame:
    """One row a source, stored; sent to all tasks only if counted to be few, so that no task gets a whole hot source."""
    shares = materialize(shares, "mix-targets")
    return F.broadcast(shares) if shares.count() <= BROADCAST_SOURCES else shares


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies, by one pass over the texts for their
    sizes and draws and one join on the source."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(seed, "doc_id", "text").alias("_draw"))
    sized = materialize(sized, "mix-sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    shares = _checked(shares.withColumnRenamed("source", "_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = sized.join(shares, sized["source"].eqNullSafe(shares["_source"])).withColumn("_rate", rate)
    copies = F.floor("_rate") + F.when(F.col("_draw") < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as its copies say, with a column copy (0, 1, ...) in place of any of that name."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = _checked(shares.select(F.col("source").alias("__mix_source"), rate.alias("__mix_rate")))
    out = docs.join(shares, F.col("source").eqNullSafe(F.col("__mix_source")))
    copies = F.floor("__mix_rate") + F.when(draw(seed, "doc_id", "text") < F.col("__mix_rate") - F.floor("__mix_rate"), 1).otherwise(0)
    out = out.withColumn("__mix_copies", copies.cast("int")).filter("__mix_copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1))).drop("__mix_copies", "__mix_rate", "__mix_source")


def op10_mixing(spark, sf_dir):
    out = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = {"op10_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws(chr(31), '{SEED}', coalesce('=' || doc_id::VARCHAR, '-'), coalesce('=' || text, '-'))), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, 2.0::DOUBLE * source_size AS bound FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS weight FROM r),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY bound / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
g AS (SELECT *, max(CASE WHEN weight * (rest / weights) < bound THEN rest / weights END) OVER () AS per FROM f),
t AS (SELECT source, source_size, CASE WHEN weight * (rest / weights) >= bound THEN bound ELSE weight * per END AS target FROM g),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM j)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c"""}
