"""Which pages a crawl would reach over stored links: level by level, bounded in depth and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import urls as U
from siftline.sources.shared import stored


def reach(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """links (site, src, dst), seeds (site, key): each key reached within a site with its least depth. Every level is an
    anti join against all seen; the loop is bounded by max_depth and ends early. With max_pages, a site's first ones by depth and key."""
    seen = level = stored(seeds.select("site", "key").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        to = level.join(links, (level["site"] == links["site"]) & (level["key"] == links["src"])).select(level["site"], F.col("dst").alias("key")).distinct()
        level = stored(to.join(seen, ["site", "key"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if max_pages is None:
        return seen
    return best(seen, F.col("depth"), max_pages).select("site", "key", "depth")


def best(frontier: DataFrame, priority: Column, most: int) -> DataFrame:
    """The first `most` of each site by (priority, depth, key), with the number there were."""
    w = Window.partitionBy("site")
    ranked = frontier.withColumn("pri", priority).withColumn("rank", F.row_number().over(w.orderBy("pri", "depth", "key"))).withColumn("total", F.count("*").over(w))
    return ranked.filter(F.col("rank") <= most)


def enqueue(seen: DataFrame, links: DataFrame, depth: int, max_depth: int, robots: DataFrame | None = None) -> DataFrame:
    """links (site, url, host, key) that a crawl would add at `depth`: not deeper than max_depth, crawlable, allowed by the rules of their
    origin in robots (origin, status, rules), and not seen (site, key); each key once, by the smallest URL."""
    new = links.filter(F.lit(depth <= max_depth) & U.crawlable("url", "host"))
    if robots is not None:
        origin = F.concat(U.scheme("url"), F.lit("://"), U.host("url"))
        new = new.withColumn("_o", origin).join(robots.select(F.col("origin").alias("_o"), "status", "rules"), "_o", "left")
        new = new.filter(U.robots_allows(F.coalesce("status", F.lit("none")), F.col("rules"), F.col("url")))
    new = new.groupBy("site", "key").agg(F.min("url").alias("url")).withColumn("depth", F.lit(depth))
    return new.join(seen.select("site", "key"), ["site", "key"], "left_anti")


def seeds(landings: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Where a crawl begins: each site's landing page (site, url) at depth 0 and the pages of its sitemaps (site, loc) at depth 1, by key."""
    start = landings.select("site", "url", F.lit(0).alias("depth"))
    more = sitemap_urls.join(landings.select("site", F.col("url").alias("_l")), "site").filter(U.crawlable("loc", U.host("_l"))).select("site", F.col("loc").alias("url"), F.lit(1).alias("depth"))
    each = start.unionAll(more).withColumn("key", U.page_key("url")).filter("key IS NOT NULL")
    return each.groupBy("site", "key").agg(F.min_by(F.struct("url", "depth"), F.struct("depth", "url")).alias("s")).select("site", "key", "s.*")


def landed(redirects: DataFrame, robots: DataFrame) -> DataFrame:
    """redirects (site, from_url, to_url): those that stay on their site, or whose target's rules allow it, are followed."""
    origin = F.concat(U.scheme("to_url"), F.lit("://"), U.host("to_url"))
    r = redirects.withColumn("_o", origin).join(robots.select(F.col("origin").alias("_o"), "status", "rules"), "_o", "left")
    same = U.same_site(U.host("from_url"), U.host("to_url"))
    allowed = U.robots_allows(F.coalesce("status", F.lit("none")), F.col("rules"), F.col("to_url"))
    return r.withColumn("follow", F.coalesce((same | F.col("to_url").rlike("^https?://")) & allowed, F.lit(False))).drop("_o", "status", "rules")


def ingested(pages: DataFrame) -> DataFrame:
    """pages (site, url, section, landing_key, title): page_title only inside a section and not on the landing page."""
    inside = F.coalesce(U.in_section("url", "section"), F.lit(False)) & ~F.coalesce(U.page_key("url") == F.col("landing_key"), F.lit(False))
    return pages.withColumn("page_title", F.when(inside, F.col("title"))).drop("title")


def counters(loads: DataFrame) -> DataFrame:
    """loads (site, key, ok, reused): attempts, pages and reused ones of each site; a key counts as one page however often it is tried."""
    return loads.groupBy("site").agg(F.count("*").alias("attempts"), F.countDistinct(F.when(F.col("ok"), F.col("key"))).alias("pages"), F.countDistinct(F.when(F.col("ok") & F.col("reused"), F.col("key"))).alias("reused"))


def choose_mode(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """pages (site, mode, js_rendered): the sites whose browser pages are taken too, as the landing page is built by scripts or plain
    pages gave no addresses: site, reason."""
    plain = pages.filter("mode = 'http'").groupBy("site").agg(F.max(F.col("js_rendered").cast("int")).alias("js"))
    found = hits.select("site").distinct().withColumn("some", F.lit(True))
    out = plain.join(found, "site", "left")
    return out.select("site", F.when(F.col("js") == 1, "js-rendered").when(F.col("some").isNull(), "no-emails").alias("reason")).filter("reason IS NOT NULL")


PAGE = "struct<url: string, depth: int>"
SAVED = 2000


def limited_pages(carried: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rate-limited pages (site, url, depth, seq) carried over and new: each URL once, at its first place with its last depth."""
    both = carried.withColumn("_f", F.lit(0)).unionByName(fresh.withColumn("_f", F.lit(1)))
    at = F.struct("_f", "seq")
    return both.groupBy("site", "url").agg(F.min(at).alias("at"), F.max_by("depth", at).alias("depth")).select("site", "url", "depth", "at")


def resume_state(stops: DataFrame, queue: DataFrame, limited: DataFrame, seen: DataFrame, most: int = SAVED) -> DataFrame:
    """What crawls leave: stops (site, stop done|time|cap, carried_capped, attempts, browser), queue (site, url, depth, pri), limited (site, url, depth,
    at), seen (site, key) to (site, resume, total).

    The best `most` of the queue are saved, `total` says how many there were; a queue stays capped unless time ran out; the keys seen
    and not pending are saved with it. A site that leaves nothing has no row.
    """
    w = Window.partitionBy("site").orderBy("pri", "depth", "url")
    ranked = queue.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    saved = ranked.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url", "depth"))), lambda x: F.struct(x["url"].alias("url"), x["depth"].alias("depth"))).alias("queued"))
    total = queue.groupBy("site").agg(F.count("*").alias("total"))
    late = limited.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url", "depth"))), lambda x: F.struct(x["url"].alias("url"), x["depth"].alias("depth"))).alias("limited"))
    done = leftover(seen, queue.select("site", U.canonical("url").alias("key")).distinct()).groupBy("site").agg(F.array_sort(F.collect_set("key")).alias("seen"))
    out = stops
    for df in (saved, total, late, done):
        out = out.join(df, "site", "left")
    none = F.array().cast(f"array<{PAGE}>")
    some = F.col("queued").isNotNull()
    out = out.filter(some | F.col("limited").isNotNull() | F.col("browser").isNotNull())
    capped = some & ((F.col("stop") == "cap") | (F.col("stop") == "done") & F.coalesce("carried_capped", F.lit(False)))
    state = F.struct(F.coalesce("queued", none).alias("queued"), capped.alias("capped"), F.coalesce("limited", none).alias("limited"), F.when(some | F.col("limited").isNotNull(), F.coalesce("seen", F.array().cast("array<string>"))).alias("seen"), "attempts", "browser")
    return out.select("site", state.alias("resume"), F.coalesce("total", F.lit(0)).alias("total"))


def resume_merge(previous: DataFrame, passes: DataFrame) -> DataFrame:
    """previous results (site, pages, reused, rate_limited, queued, error, owed) and the passes that went on with them (site, pages, reused,
    rate_limited, queued, took_queued, took_limited, has_emails, aborted): counts summed, a timeout cleared, an owed browser phase dropped
    once there are addresses, and carried counts kept for the parts a pass did not work on."""
    p = previous.select("site", *[F.col(c).alias(f"p_{c}") for c in ("pages", "reused", "rate_limited", "queued", "error", "owed")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = passes.join(p, "site")
    error = F.when(F.col("p_error") != "timeout", F.col("p_error"))
    return r.select(
        "site", (n("p_pages") + n("pages")).alias("pages"), (n("p_reused") + n("reused")).alias("reused"),
        (F.when(F.col("took_limited"), 0).otherwise(n("p_rate_limited")) + n("rate_limited")).alias("rate_limited"),
        (F.when(F.col("took_queued"), 0).otherwise(n("p_queued")) + n("queued")).alias("queued"),
        F.coalesce(error, F.when(F.col("aborted"), "timeout")).alias("error"), F.when((F.col("p_owed") == "no-emails") & F.col("has_emails"), None).otherwise(F.col("p_owed")).alias("owed"),
    )


def leftover(seen: DataFrame, done: DataFrame) -> DataFrame:
    """What is seen but not done."""
    return seen.join(done, ["site", "key"], "left_anti")
