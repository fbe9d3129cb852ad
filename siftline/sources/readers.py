"""Readers: lists, logs, sitemaps, robots rules, word lists, outputs, partitioned places."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.sources.shared import stored


def encoding_of(head: bytes) -> tuple[str, str]:
    """(encoding, separator) from a file's first bytes: a byte-order mark, and tabs in UTF-16 lists without a comma."""
    for mark, name in ((codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if head.startswith(mark):
            line = head[2:].decode(name, "ignore").split("\n")[0]
            return name, "\t" if "\t" in line and "," not in line else ","
    return "UTF-8", ","


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, in order, by the file system that Spark reads; hidden ones are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(str(f.getPath().toString()) for f in found if not f.getPath().getName().startswith((".", "_")) and not f.getPath().getParent().getName().startswith("."))


def input_files(spark: SparkSession, root: str) -> list[str]:
    """The lists of a folder and of the folders in it."""
    return sorted(_files(spark, f"{root}/*.csv") + _files(spark, f"{root}/*/*.csv"))


def output_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """The outputs of each group folder; the folder of combined ones is no group, and folders in groups are not looked into."""
    out: dict[str, list[str]] = {}
    for path in _files(spark, f"{root}/*/*.csv"):
        group = path.rsplit("/", 2)[1]
        if group != "unique":
            out.setdefault(group, []).append(path)
    return out


def csv_list(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a list, one array a line, in order: ord, cells. Quoted cells may hold separators and line ends, rows any number of
    cells; empty cells stay. Spark reads the file; its head settles the encoding."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("h")).first()
    encoding, sep = encoding_of(bytes(head["h"]))
    text = F.regexp_replace(F.decode("content", encoding), "^\ufeff|\r", "")
    # A record is what lies between line ends outside quotes, a cell what lies between separators outside them. A quote counts at the
    # start of a cell only; an open one ends with the file.
    cell = rf'(?:[ ]*"(?:[^"]|"")*+(?:"|\z)[^{sep}\n]*+|[^{sep}\n]*+)'
    records = F.regexp_extract_all(text, F.lit(rf"(?:\A|\n)({cell}(?:{sep}{cell})*+)"), F.lit(1))
    lines = spark.read.format("binaryFile").load(path).select(F.posexplode(records).alias("ord", "line")).filter(F.trim("line") != "")
    cells = F.regexp_extract_all(F.concat(F.lit(sep), "line"), F.lit(rf"{sep}({cell})"), F.lit(1))

    def tidy(x: Column) -> Column:
        quoted = F.regexp_extract(x, r'(?s)^[ ]*"((?:[^"]|"")*+)"?\s*$', 1)
        return F.trim(F.when(F.trim(x).startswith('"'), F.regexp_replace(F.when(quoted != "", quoted).otherwise(F.regexp_replace(F.trim(x), '^"+$', "")), '""', '"')).otherwise(x))

    return lines.select(F.col("ord").cast("long").alias("ord"), F.transform(cells, tidy).alias("cells"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole lines of an append-only log; damaged ones are skipped. Only the columns asked for are parsed."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").filter(F.trim("value").rlike(r"^\{.*\}$"))
    return rows.select("r.*")


def xml_text(text: Column) -> Column:
    """Text of an element: marks of literal text and white space around it gone, named and numeric entities decoded."""
    out = F.regexp_replace(F.regexp_replace(text, r"^\s*<!\[CDATA\[", ""), r"\]\]>\s*$", "")
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"(?i)&#(x[0-9a-f]{1,6}|\d{1,6});"), F.lit(1)))

    def decoded(held: Column, number: Column) -> Column:
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.replace(held, F.concat(F.lit("&#"), number, F.lit(";")), char)).otherwise(held)

    out = F.aggregate(numbers, out, decoded)
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.regexp_replace(out, f"&{entity};", char)
    return F.trim(out)


SITEMAP_FILES = 8
SITEMAP_URLS = 2000
LISTING = r"(?i)(stock|inventory|vehicle|listing|product|used|new-car|demo)"


def unpacked(content: Column) -> Column:
    """Stored bytes as text; gzip by its first bytes, up to 50 MB, damaged gzip as nothing."""

    @F.pandas_udf("string")
    def told(x):
        import zlib

        def one(b):
            if b is None or b[:2] != b"\x1f\x8b":
                return None if b is None else b.decode("utf-8", "replace")
            try:
                return zlib.decompressobj(31).decompress(b, 50 << 20).decode("utf-8", "replace")
            except zlib.error:
                return ""

        return x.map(one)

    return told(content)


def sitemap(files: DataFrame, roots: DataFrame, most_files: int = SITEMAP_FILES, most_urls: int = SITEMAP_URLS) -> DataFrame:
    """files (url, content) and roots (site, url, ord): the page URLs (site, n, loc) of each site's sitemaps, from the roots on in their order.

    Each round every site reads one file: the first pending one, listings last. An index adds files, a set adds pages. A site stops
    after `most_files` files that exist, or once it has `most_urls` pages; the pages of a file that is read all count.
    """
    xml = unpacked(F.col("content"))
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1)), xml_text)
    parsed = files.select("url", xml.alias("xml")).select("url", F.lower(F.regexp_extract("xml", r"(?i)<(urlset|sitemapindex)\b", 1)).alias("root"), F.filter(locs, lambda x: ~x.rlike(r"[<\s]") & (x != "")).alias("locs"))
    parsed = stored(parsed, "sitemaps")
    pending = roots.groupBy("site", "url").agg(F.min(F.struct(F.lit(0).alias("round"), F.col("ord").cast("long").alias("i"))).alias("at"))
    pending = stored(pending.withColumn("listing", F.col("url").rlike(LISTING)), "sitemap-pending")
    taken = stored(pending.limit(0).select("site", "url"), "sitemap-taken")
    pages = stored(pending.limit(0).select("site", F.lit(0).alias("round"), F.lit(0).alias("i"), F.col("url").alias("loc")), "sitemap-pages")
    # A file that is not stored is no read; it only leaves the queue.
    have = pending.join(parsed.select("url"), "url", "left_semi")
    for n in range(1, most_files + 1):
        full = pages.groupBy("site").agg(F.count("*").alias("k")).filter(F.col("k") >= most_urls).select("site")
        left = have.join(taken, ["site", "url"], "left_anti").join(full, "site", "left_anti")
        now = stored(left.groupBy("site").agg(F.min(F.struct("listing", "at", "url")).alias("m")).select("site", "m.url"), "sitemap-now")
        if now.isEmpty():
            break
        read = now.join(parsed, "url")
        found = stored(read.select("site", "root", F.posexplode("locs").alias("i", "loc")), "sitemap-found")
        taken = taken.unionByName(now.select("site", "url"))
        pages = pages.unionByName(found.filter("root = 'urlset'").select("site", F.lit(n).alias("round"), "i", "loc"))
        more = found.filter("root = 'sitemapindex'").groupBy("site", F.col("loc").alias("url")).agg(F.min(F.struct(F.lit(n).alias("round"), F.col("i").cast("long").alias("i"))).alias("at"))
        more = more.withColumn("listing", F.col("url").rlike(LISTING)).join(parsed.select("url"), "url", "left_semi")
        have = stored(have.unionByName(more.join(have.select("site", "url"), ["site", "url"], "left_anti")), "sitemap-have")
    first = pages.groupBy("site", "loc").agg(F.min(F.struct("round", "i")).alias("o"))
    return first.select("site", F.row_number().over(Window.partitionBy("site").orderBy("o")).alias("n"), "loc")


def robots_rules(files: DataFrame) -> DataFrame:
    """files (origin, http_status, body): origin, status (unavailable, none, rules), rules (allow, pattern), disallow, crawl_delay, sitemaps
    for all agents."""
    group = F.regexp_extract(F.col("body"), r"(?is)user-agent:\s*\*\s*\n(.*?)(?:\nuser-agent:|\z)", 1)
    status = F.when(F.col("http_status") >= 500, "unavailable").when((F.col("http_status") >= 400) | ~F.col("body").rlike("(?i)user-agent:") | F.col("body").rlike("(?i)<html"), "none").otherwise("rules")

    def patterns(kind: str) -> Column:
        return F.filter(F.regexp_extract_all(group, F.lit(rf"(?im)^\s*{kind}:[ \t]*(\S*)"), F.lit(1)), lambda p: p != "")

    def told(kind: str) -> Column:
        return F.transform(patterns(kind), lambda p: F.struct(F.lit(kind == "allow").alias("allow"), p.alias("pattern")))

    return files.select(
        "origin", status.alias("status"), F.concat(told("allow"), told("disallow")).alias("rules"), patterns("disallow").alias("disallow"),
        F.regexp_extract(group, r"(?im)^\s*crawl-delay:\s*([0-9.]+)", 1).try_cast("double").alias("crawl_delay"), F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)).alias("sitemaps"),
    )


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("word")).filter("word <> ''").distinct()


def output_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows written before: missing columns are empty, rows without an address go."""
    df = spark.read.option("header", True).csv(path)
    for c in ("name", "email", "website", "link"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.na.fill("").filter(F.trim("email") != "").select("name", "email", "website", "link", F.input_file_name().alias("file"))


def places(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Hive-partitioned places; the country prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("country") == country) if country else df


def decode_page(content: Column, header_charset: Column) -> Column:
    """Bytes to text: the header's charset, one named in the first 2 KB, else UTF-8; a name that no decoder has counts as UTF-8."""

    @F.pandas_udf("string")
    def told(body, named):
        import codecs as c
        import re

        def one(b, name):
            if b is None:
                return None
            if not name and (m := re.search(rb"(?i)<meta[^>]+charset=[\"']?([a-z0-9_-]+)", b[:2048])):
                name = m[1].decode()
            try:
                c.lookup(name or "utf-8")
            except LookupError:
                name = "utf-8"
            return b.decode({"iso-8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252"}.get((name or "utf-8").lower(), name or "utf-8"), "replace")

        import pandas as pd

        return pd.Series([one(b, n) for b, n in zip(body, named.astype(object).where(named.notna(), None), strict=True)], dtype=object)

    return told(content, header_charset)


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a plain log, parted by blank lines, with the counts that their heads name."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    return blocks.select(F.regexp_extract("value", r"^([^\n]*)", 1).alias("head"), F.regexp_extract("value", r"(\d+) sites?", 1).try_cast("int").alias("sites"), F.regexp_extract("value", r"(\d+) e-?mails?", 1).try_cast("int").alias("emails"), F.col("value").alias("text"))
