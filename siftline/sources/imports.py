"""What older versions have left: page and result logs, text logs, outputs, markers; each source is taken in once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.readers import output_rows, text_log

#: Fixed field names of version 1, and today's.
RENAMES = {"t": "type", "k": "page_key", "m": "mode", "at": "fetched_at"}
SCHEMAS = {
    "pages": "page_key string, mode string, fetched_at long, k string, m string, at long, page string, gone boolean",
    "results": "site string, business string, finalUrl string, emails array<struct<email: string, name: string, source: string, link: string>>, error string, pages int, t string, type string",
}
LEDGER = "source string, kind string, rows long"


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines (value) of JSON records, those glued to one line apart; what is no whole record goes."""
    each = lines.select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\{(?=\"[A-Za-z_]+\"\s*:)", "}\n{"), "\n")).alias("value"))
    return each.filter(F.trim("value").rlike(r"^\{.*\}$"))


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a log of `kind` (pages or results) with today's names; a field of either version counts."""
    rows = whole_records(spark.read.text(path)).select(F.from_json("value", SCHEMAS[kind], {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    for old, new in RENAMES.items():
        if old in rows.columns and new in rows.columns:
            rows = rows.withColumn(new, F.coalesce(new, old)).drop(old)
    key = "page_key" if kind == "pages" else "site"
    return rows.filter(F.col(key).isNotNull())


def markers(spark: SparkSession, path: str) -> DataFrame:
    """Files whose existence is the fact, by their names: marker."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("marker"))


READERS = {"pages": lambda s, p: records(s, p, "pages"), "results": lambda s, p: records(s, p, "results"), "log": text_log, "rows": output_rows, "marker": markers}


def not_imported(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources (source, kind, path) that the ledger does not have."""
    return sources.join(ledger.select("source").distinct(), "source", "left_anti")


def take_in(spark: SparkSession, sources: DataFrame, ledger: str, out: str) -> dict[str, int]:
    """Imports what the ledger at its path does not have. A source's rows replace what an import that broke off has left, and the ledger
    names it last, so each counts once whenever a run ends. Returns the rows of each source taken in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(LEDGER).parquet(ledger) if there else spark.createDataFrame([], LEDGER)
    counts = {}
    for r in not_imported(sources, done).orderBy("source").collect():  # a row a file, not a row of data
        target = f"{out}/{r['kind']}/source={r['source']}"
        READERS[r["kind"]](spark, r["path"]).write.mode("overwrite").parquet(target)
        counts[r["source"]] = spark.read.parquet(target).count()
        spark.createDataFrame([(r["source"], r["kind"], counts[r["source"]])], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return counts


TIME_LIMIT = "(?i)(time limit|time budget|out of time)"


def time_limits(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines about time limits: the latest of each (file, site), of equal times the first written."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    r = lines.select("ord", F.from_json("value", "time long, msg string, file string, site string").alias("r")).select("ord", "r.*")
    r = r.filter(F.col("msg").rlike(TIME_LIMIT) & F.col("site").isNotNull())
    return r.groupBy("file", "site").agg(F.max_by(F.struct("time", "msg"), F.struct("time", -F.col("ord"))).alias("m")).select("file", "site", "m.*")


def mark_budget(limits: DataFrame, stored: DataFrame, lists: DataFrame) -> DataFrame:
    """Stored rows (cat, list, site, budget_queued) to append, marked as out of time, for limits (file, site): a file counts only if just one list of
    lists (cat, list) has its name, and rows marked already stay."""
    one = lists.distinct().groupBy("list").agg(F.count("*").alias("n"), F.min("cat").alias("cat")).filter("n = 1").select("cat", "list")
    named = limits.select(F.regexp_replace("file", r"\.csv$", "").alias("list"), "site").distinct().join(one, "list")
    return stored.filter("budget_queued IS NULL").join(named, ["cat", "list", "site"], "left_semi").withColumn("budget_queued", F.lit(0))
