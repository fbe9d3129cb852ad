"""Incremental upkeep of latest-wins tables from growing folders of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 32


def upsert(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over the state and a batch; older late rows change nothing, whatever their order of arrival."""
    both = batch if state is None else state.unionByName(batch)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def _versions(spark: SparkSession, out: str, before: int | None = None) -> dict[int, int]:
    """The newest whole version of each part (before a batch's number): one whose writer has left its last file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/part-*/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    newest: dict[int, int] = {}
    for f in found:
        p, v = (int(re.sub(r"\D", "", x)) for x in f.getPath().toString().split("/")[-3:-1])
        if before is None or v < before:
            newest[p] = max(v, newest.get(p, -1))
    return newest


def _read(spark: SparkSession, out: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{out}/part-{p}/v{v}" for p, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, schema: str, out: str, gone: str | None = None) -> DataFrame:
    """The table as it stands. Rows whose newest version is a tombstone (`gone` holds) are kept for late rows, but not shown."""
    df = _read(spark, out, _versions(spark, out), schema)
    return df.filter(~F.coalesce(F.expr(gone), F.lit(False))) if gone else df


def run_available(spark: SparkSession, source: str, schema: str, keys: list[str], order: list[str], out: str, checkpoint: str, files_per_trigger: int = 16, parts: int = PARTS, gone: str | None = None) -> DataFrame:
    """Takes in all files of `source` that are new since the last run and returns the current table.

    The table lies in `parts` parts by a hash of the keys; a batch rewrites only the parts that it has rows for, each as a version of the
    batch's number, so a batch that is repeated after a failure starts from the same versions and overwrites its own result only. `gone`
    is a condition that makes a row a tombstone: it takes its key out until a newer row puts it back.
    """
    part: Column = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        touched = sorted(r["p"] for r in batch.select(part.alias("p")).distinct().collect())  # `parts` numbers at most
        if not touched:
            return
        before = {p: v for p, v in _versions(s, out, number).items() if p in touched}
        new = upsert(_read(s, out, before, batch.schema), batch, keys, order).select(*batch.columns)
        new = new.withColumn("_part", part).repartition("_part")
        folder = f"{out}/batch-{number}"
        new.write.mode("overwrite").partitionBy("_part").parquet(folder)
        _publish(s, out, folder, touched, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return current(spark, schema, out, gone)


def _publish(spark: SparkSession, out: str, folder: str, parts: list[int], number: int) -> None:
    """Moves a batch's parts to their places, marks each as whole, and drops the versions before the last two."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path_of(out).getFileSystem(conf)
    for p in parts:
        target = path_of(f"{out}/part-{p}/v{number}")
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        fs.rename(path_of(f"{folder}/_part={p}"), target)
        fs.create(path_of(f"{out}/part-{p}/v{number}/_SUCCESS")).close()
        old = sorted((int(f.getPath().getName()[1:]), f.getPath()) for f in fs.listStatus(target.getParent()))
        for _, path in old[:-2]:
            fs.delete(path, True)
    fs.delete(path_of(folder), True)
