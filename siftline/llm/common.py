"""What the corpus operators share: tables in the shared folder and bounded collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.shared import new_path

#: Characters that separate words: space and U+0009 to U+000D (as a Java and RE2 class body).
SPACES = r"\x20\x09-\x0D"


#: Parquet options for rows of megabytes: Spark's writer holds a row group, its reader decodes one at once, and by default a group
#: is measured only every 100 rows.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and reads it back.

    Cuts lineage, survives lost executors, and keeps costly columns from being computed again. options are the writer's.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*stored: DataFrame) -> None:
    """Deletes tables that `materialize` made and nothing reads any more."""
    for df in stored:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark drops the shuffle files of finished steps once nothing there refers to them."""
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, stored once with a number of each row in `__row`: repeated or null ids name rows no longer."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: str, n: int):
    """crc32 of a whole number's decimal text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def words(text):
    """Array of the maximal runs without SPACES; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")
