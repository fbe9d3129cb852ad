"""Building input lists: columns, validation, known and blocked sites, chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import domains as D
from siftline.functions import urls as U

HEADERS = ("website", "url", "site", "domain", "web", "homepage")
_URL = re.compile(r"(?i)^\s*[\"']?(https?://|www\.)?([a-z0-9-]+\.)+[a-z]{2,}(/\S*)?[\"']?\s*$")


def find_columns(rows: list[list[str]]) -> tuple[int, int | None, bool]:
    """(website column, name column, whether row 0 is a header) from the first rows: an exact header, then one that speaks of
    web, url, domain, site or link, then the column with the most URL-like cells (the first of equals)."""
    head = [h.strip() for h in rows[0]]
    lower = [h.lower() for h in head]
    exact = next((lower.index(h) for h in HEADERS if h in lower), None)
    fuzzy = next((i for i, h in enumerate(lower) if re.search("web|url|domain|site|link", h) and not _URL.match(h)), None)
    width = max(map(len, rows))
    counts = [sum(bool(_URL.match(r[i])) for r in rows[:200] if i < len(r)) for i in range(width)]
    site = exact if exact is not None else fuzzy if fuzzy is not None else counts.index(max(counts))
    header = not (site < len(head) and _URL.match(head[site]))
    name = next((i for i, h in enumerate(lower) if header and i != site and re.fullmatch(r"(business|company|clinic|practice|organi[sz]ation|trading)?[ _-]?(name|title)|business|company", h)), None)
    return site, name, header


def tidy_name(name: Column) -> Column:
    t = F.trim(F.regexp_replace(name, r"[\s ]+", " "))
    return F.when(F.length(t).between(1, 120), t)


def input_list(rows: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (ord, site, input_name): the first of each site key with its URL, and one row with counts of invalid and repeated.
    With rules, hosts that are no IP address need a known public suffix and a label before it."""
    r = rows.withColumn("url", U.normalize_input("site"))
    if rules is not None:
        host = U.host("url")
        good = D.dimension(r.select(host.alias("host")).filter("host IS NOT NULL"), rules).filter("listed AND reg_domain IS NOT NULL").select(F.col("host").alias("_h"), F.lit(True).alias("_good"))
        r = r.withColumn("_h", host).join(good, "_h", "left")
        r = r.withColumn("url", F.when(F.col("_good") | F.col("_h").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.col("url"))).drop("_h", "_good")
    r = r.withColumn("key", U.site_key(F.col("url")))
    first = r.filter("url IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("ord", "url", tidy_name(F.col("input_name")).alias("input_name")), "ord").alias("f"), F.count("*").alias("n"))
    totals = r.agg(F.count_if(F.col("url").isNull()).alias("invalid"), (F.count("url") - F.countDistinct("key")).alias("duplicates"))
    return first.select("f.*", "key"), totals


def listed(cells: DataFrame) -> DataFrame:
    """cells (ord, cells) of a list file to (ord, site, input_name), its columns found from the first 200 rows."""
    head = [r["cells"] for r in cells.orderBy("ord").limit(200).collect()]
    if not head:
        return cells.select("ord", F.lit("").alias("site"), F.lit("").alias("input_name"))
    site, name, header = find_columns(head)
    first = cells.agg(F.min("ord").alias("_first"))
    rows = cells.join(F.broadcast(first), F.col("ord") == F.col("_first"), "left_anti") if header else cells
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select("ord", F.coalesce(cell(site), F.lit("")).alias("site"), (F.lit(None).cast("string") if name is None else cell(name)).alias("input_name"))


def skip_reason(force: bool, new_only: bool, retry: bool, summary_only: bool) -> Column:
    """Of lists (has_output, interrupted): finished ones are left alone unless asked for, and a retry needs an output; else null."""
    asked = force or new_only or retry or summary_only
    finished = F.lit(not asked) & F.col("has_output") & ~F.col("interrupted")
    return F.when(finished, "finished").when(F.lit(retry) & ~F.col("has_output"), "no-output-to-retry")


def unique_label(bases: list[str]) -> str:
    """A combined file's name: what all names share before their first mark, else `all`."""
    heads = {re.split("[._-]", b)[0] for b in bases}
    return heads.pop() or "all" if len(heads) == 1 else "all"


def classify(candidates: DataFrame, known: DataFrame, blocked: DataFrame, country: str | None = None) -> DataFrame:
    """candidates (ord, site): class in this order: invalid, blocked, foreign, known, repeated, new."""
    c = candidates.withColumn("url", U.normalize_input("site")).withColumn("key", U.site_key(F.col("url"))).withColumn("domain", U.simple_domain(U.base_host(U.host("url"))))
    c = c.join(known.select("key", F.lit(True).alias("k")).distinct(), "key", "left").join(blocked.select("domain", F.lit(True).alias("b")).distinct(), "domain", "left")
    official = F.col("domain").rlike(r"(^|\.)(edu|gov|govt|ac|mil)(\.[a-z]{2})?$")
    tld = F.element_at(F.split("domain", r"\."), -1)
    foreign = F.lit(False) if country is None else (F.length(tld) == 2) & (tld != country) & ~tld.isin("io", "ai", "co", "me", "tv", "cc", "fm", "app")
    first = c.filter("url IS NOT NULL").groupBy("key").agg(F.min("ord").alias("f"))
    c = c.join(first, "key", "left")
    what = F.when(F.col("url").isNull(), "invalid").when(F.coalesce("b", F.lit(False)) | official, "blocked").when(foreign, "foreign").when(F.col("k"), "known").when(F.col("ord") > F.col("f"), "repeated").otherwise("new")
    return c.select("ord", "site", "url", "key", what.alias("class"))


def split_chains(sites: DataFrame, known: list[str] = (), hosting: list[str] = (), least: int = 3) -> DataFrame:
    """sites (site): whether its domain is a known chain or has `least` sites or more; hosting platforms are none."""
    s = sites.withColumn("domain", U.simple_domain(U.base_host(U.host("site"))))
    n = s.groupBy("domain").agg(F.count("*").alias("n"))
    out = s.join(n, "domain")
    return out.withColumn("chain", (F.col("domain").isin(list(known)) | (F.col("n") >= least)) & ~F.col("domain").isin(list(hosting)))
