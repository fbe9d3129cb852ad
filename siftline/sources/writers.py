"""Writers: ordered CSV rows, filtered and unique sets, partitioned places, appended logs."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.filters import SuffixFilter, filter_rows
from siftline.sources.readers import input_files


def rows_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, in order of (si, ei); the committer renames it into place."""
    rows.orderBy("si", "ei").select("name", "email", "website", "link").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def filtered_path(root: str, group: str, base: str, f: SuffixFilter) -> str:
    """Where the filtered rows of a list go: a folder of its group by the filter's tag."""
    return f"{root}/{group}/filtered/{base}.{f.tag()}.csv"


def filtered_csv(rows: DataFrame, root: str, group: str, base: str, f: SuffixFilter, log: str, run: str) -> str:
    """Writes the rows that the filter keeps and an event with what it dropped by ending."""
    path = filtered_path(root, group, base, f)
    kept, dropped = filter_rows(rows, f)
    rows_csv(kept, path)
    counts = dropped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dropped"), F.to_json(F.map_from_entries(F.collect_list(F.struct("suffix", "n")))).alias("endings"))
    append(event(counts.withColumn("path", F.lit(path)), "filter.end", run), log)
    return path


def next_list(spark: SparkSession, root: str, category: str, name: str) -> str:
    """The path of a new list: the first number from 2 on that is free, or the bare name."""
    taken = {p.rsplit("/", 1)[1] for p in input_files(spark, root)}
    names = itertools.chain([f"{name}.csv"], (f"{name}-{i}.csv" for i in itertools.count(2)))
    return f"{root}/{category}/{next(n for n in names if n not in taken)}"


def manifest(spark: SparkSession, path: str, schema: int, migrations: dict[str, int]) -> None:
    """One JSON row that says what a store is; the committer renames it into place."""
    row = spark.range(1).select(F.lit(schema).alias("schema"), F.current_timestamp().alias("created_at"), F.lit(json.dumps(migrations, sort_keys=True)).alias("migrations"))
    row.coalesce(1).write.mode("overwrite").json(path)


def unique_csv(rows: DataFrame, path: str) -> None:
    rows.select("category", "name", "email", "website", "link").write.mode("overwrite").partitionBy("category").option("header", True).csv(path)


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def event(df: DataFrame, kind: str, run: str) -> DataFrame:
    """An event row for the log: its fields as JSON."""
    return df.select(F.lit(2).alias("version"), F.lit(kind).alias("type"), F.lit(run).alias("run"), F.unix_millis(F.current_timestamp()).alias("at"), F.to_json(F.struct(*df.columns)).alias("payload"))


def places(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("country").option("compression", "zstd").parquet(path)
