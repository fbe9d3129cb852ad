"""Views over append-only logs: the newest versions, generations, interrupted lists, retries, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import urls as U
from siftline.operators.rows import registered, tidy_business


def _latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def pages_current(log: DataFrame) -> DataFrame:
    """The newest version of each (mode, page_key); of equal times the later written."""
    return _latest(log, ["mode", "page_key"], ["fetched_at", "seq"])


def look_up(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The current version of each wanted (mode, page_key) that is stored and not gone; the keys reach the log before it is grouped."""
    some = log.join(wanted.select("mode", "page_key").distinct(), ["mode", "page_key"], "left_semi")
    return pages_current(some).filter(~F.coalesce("gone", F.lit(False)))


def not_stored(sites: DataFrame, log: DataFrame) -> DataFrame:
    """Sites of a list without a current stored result: what a run of new ones, or one that goes on, has to do."""
    return sites.join(sites_current(log).select("cat", "list", "site").distinct(), ["cat", "list", "site"], "left_anti")


def touched(log: DataFrame, touches: DataFrame) -> DataFrame:
    """Current pages whose time is renewed by later validations (mode, page_key, validated_at)."""
    t = touches.groupBy("mode", "page_key").agg(F.max("validated_at").alias("_v"))
    return pages_current(log).join(t, ["mode", "page_key"], "left").withColumn("fetched_at", F.greatest("fetched_at", F.coalesce("_v", "fetched_at"))).drop("_v")


def sites_current(log: DataFrame) -> DataFrame:
    """Of each list's newest generation the last row of each site; a drop takes the site out. One aggregation: the newest generation
    of a site's rows is compared with that of its list."""
    newest = log.groupBy("cat", "list").agg(F.max("generation").alias("generation"))
    return _latest(log.join(newest, ["cat", "list", "generation"], "left_semi"), ["cat", "list", "generation", "site"], ["seq"]).filter("type = 'site'")


def list_summaries(log: DataFrame) -> DataFrame:
    return sites_current(log).groupBy("cat", "list", "generation").agg(F.count("*").alias("n_sites"))


def interrupted(events: DataFrame) -> DataFrame:
    """Lists whose last start has no later end."""
    last = events.filter(F.col("type").isin("list.start", "list.end")).groupBy("cat", "list").agg(F.max_by("type", "seq").alias("last"))
    return last.filter("last = 'list.start'").select("cat", "list")


def begin_list(log: DataFrame, events: DataFrame, retry: bool = False) -> DataFrame:
    """What a run of each list does: resume an interrupted one, keep the generation to retry, or begin a new one."""
    newest = log.groupBy("cat", "list").agg(F.max("generation").alias("generation"))
    cut = interrupted(events).withColumn("cut", F.lit(True))
    out = newest.join(cut, ["cat", "list"], "left")
    action = F.when(F.col("cut"), "resume").when(F.lit(retry), "keep").otherwise("new")
    return out.select("cat", "list", action.alias("action"), (F.col("generation") + (action == "new").cast("int")).alias("generation"))


def domain_business(sites: DataFrame) -> DataFrame:
    """sites (seq, landing, input, business, related): the last good name of each domain, for the landing's always and the
    input's if it is related and another."""
    both = F.array_compact(F.array("landing", F.when(F.col("related") & (F.col("input") != F.col("landing")), F.col("input"))))
    return sites.filter("business IS NOT NULL").select("seq", "business", F.explode(both).alias("domain")).groupBy("domain").agg(F.max_by("business", "seq").alias("business"))


def reuse_class(links: DataFrame, pages: DataFrame, cutoff: Column) -> DataFrame:
    """links (mode, page_key) against current pages (mode, page_key, fetched_at, gone): reuse, gone, stale or missing."""
    p = pages.select("mode", "page_key", "fetched_at", "gone")
    fresh = F.col("fetched_at") >= cutoff
    what = F.when(F.col("fetched_at").isNull(), "missing").when(~fresh, "stale").when(F.col("gone"), "gone").otherwise("reuse")
    return links.distinct().join(p, ["mode", "page_key"], "left").select("mode", "page_key", what.alias("action"))


def domain_names(results: DataFrame, rules: DataFrame) -> DataFrame:
    """results (seq, site, final_url, business) of all lists to (domain, business), the newest good name of each registrable domain. Names
    of a section's page and names that are only a host do not count."""
    r = results.withColumn("business", tidy_business()("business")).filter("business IS NOT NULL").filter(~F.col("business").rlike(r"^[A-Za-z0-9_.-]+\.[A-Za-z]{2,}$"))
    r = r.filter(U.section_prefix("site", "final_url").isNull())
    r = r.withColumn("_in", U.base_host(U.host("site"))).withColumn("_out", U.base_host(U.host("final_url")))
    r = registered(r, {"input": "_in", "landing": "_out"}, rules)
    return domain_business(r.select("seq", "landing", "input", "business", U.related("input", "landing", F.lit(None).cast("string")).alias("related")))


def put_if_newer(log: DataFrame, new: DataFrame) -> DataFrame:
    """New page rows to append: those without a stored version as new or newer."""
    held = pages_current(log).select("mode", "page_key", F.col("fetched_at").alias("_at"))
    return new.join(held, ["mode", "page_key"], "left").filter("_at IS NULL OR _at < fetched_at").drop("_at")


def plan_retries(results: DataFrame, failed: bool = False, limited: bool = False, budget: bool = False, capped: bool = False) -> DataFrame:
    """results (site, error, rate_limited, budget_queued, cap_queued): site, action, and the parts to resume."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    wants = {"budget": n("budget_queued") & F.lit(budget), "limited": n("rate_limited") & F.lit(limited), "capped": n("cap_queued") & F.lit(capped)}
    crawl = F.col("error").isNotNull() & F.lit(failed)
    any_part = wants["budget"] | wants["limited"] | wants["capped"]
    action = F.when(crawl, "recrawl").when(any_part, "resume").otherwise("none")
    return results.select("site", action.alias("action"), F.struct(*[F.when(crawl, False).otherwise(w).alias(k) for k, w in wants.items()]).alias("parts"))


def upgrade(log: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rows of older versions read with today's names: the new field, else the old one."""
    out = log
    for old, new in renames.items():
        if old in out.columns:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in out.columns else F.col(old)).drop(old)
    return out


def compact(log: DataFrame) -> DataFrame:
    """What a compaction writes: the newest version of each key; rows without a key are damaged and go."""
    return pages_current(log.filter("page_key IS NOT NULL AND mode IS NOT NULL"))
