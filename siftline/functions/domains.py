"""Public suffixes as a dimension table: distinct hosts are resolved once and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small set of public-suffix rules; a full list is given as a file with one rule a line.
RULES = "com org net info biz edu gov int name pro io ai app dev nz co.nz org.nz net.nz ac.nz govt.nz school.nz uk co.uk org.uk ac.uk gov.uk au com.au org.au net.au edu.au gov.au de fr es it nl be at ch eu us ca ie se no dk fi pl pt br com.br jp co.jp *.ck !www.ck".split()


def rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule, kind, n): a rule without its mark, exact, wildcard or exception, and its number of labels. From a file only
    the lines before the private section count."""
    if path:
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.split_part("value", F.lit("===BEGIN PRIVATE"), F.lit(1)), "\n")).alias("rule"))
        lines = lines.select(F.trim("rule").alias("rule")).filter((F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
    else:
        lines = spark.createDataFrame([(r,) for r in RULES], "rule string")
    kind = F.when(F.startswith("rule", F.lit("!")), "exception").when(F.startswith("rule", F.lit("*.")), "wildcard").otherwise("exact")
    return lines.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind"))


def dimension(hosts: DataFrame, rules_: DataFrame) -> DataFrame:
    """hosts (host) to (host, suffix, reg_domain, listed): the longest rule wins, an exception over a wildcard; a host without
    a rule has its last label as suffix and is not listed. reg_domain is null for a bare suffix."""
    each = hosts.select("host").distinct().withColumn("labels", F.split("host", r"\."))
    tails = each.select("host", "labels", F.posexplode("labels").alias("i", "_")).select("host", "labels", "i", F.array_join(F.expr("slice(labels, i + 1, size(labels))"), ".").alias("rule"))
    hit = tails.join(rules_, "rule")
    n = F.size("labels") - F.col("i")
    n = F.when(F.col("kind") == "wildcard", n + 1).when(F.col("kind") == "exception", n - 1).otherwise(n)
    hit = hit.withColumn("n", n).filter(F.col("n") <= F.size("labels"))
    best = hit.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), F.col("n"))).alias("b"))
    out = each.join(best, "host", "left").withColumn("n", F.coalesce("b.n", F.lit(1)))
    take = lambda k: F.array_join(F.expr(f"slice(labels, greatest(size(labels) - n + 1 - {k}, 1), n + {k})"), ".")
    return out.select("host", take(0).alias("suffix"), F.when(F.size("labels") > F.col("n"), take(1)).alias("reg_domain"), F.col("b").isNotNull().alias("listed"))
