"""Counts and texts about lists, rows and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import urls as U
from siftline.operators.rows import kind_counts


def list_summary(results: DataFrame) -> DataFrame:
    """results (error, n_emails, pages, reused): one row of counts."""
    return results.agg(
        F.count("*").alias("sites"), F.count_if(F.expr("n_emails > 0")).alias("with_emails"), F.count_if(F.expr("error IS NULL AND n_emails = 0")).alias("without"),
        F.count_if(F.expr("error IS NOT NULL")).alias("failed"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.sum(F.coalesce("reused", F.lit(0))).alias("reused"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Failed sites by reason, and by reason and detail, in one rollup; a null detail is the reason's total."""
    return results.filter("reason IS NOT NULL").rollup("reason", "detail").agg(F.count("*").alias("n")).filter("reason IS NOT NULL")


def top(df: DataFrame, by: str, tie: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def role_candidates(emails: DataFrame, least: int = 15) -> DataFrame:
    """emails (local, domain): local parts that very many domains use."""
    return emails.groupBy("local").agg(F.countDistinct("domain").alias("n_domains")).filter(F.col("n_domains") >= least)


def token_frequency(names: DataFrame, column: str) -> DataFrame:
    return names.select(F.explode(F.split(F.lower(F.col(column)), "[^a-z]+")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def popular_names(rows: DataFrame, most: int = 1500) -> DataFrame:
    """rows (name, year, percent): the names of the most years, then of the highest share."""
    return rows.groupBy("name").agg(F.countDistinct("year").alias("years"), F.max("percent").alias("percent")).orderBy(F.desc("years"), F.desc("percent"), "name").limit(most)


def vocabulary(*sources: DataFrame) -> DataFrame:
    """Weights (word, weight) added up."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.groupBy("word").agg(F.sum("weight").alias("weight"))


def unknown_firsts(firsts: DataFrame, given: DataFrame) -> DataFrame:
    """firsts (first, email): first parts that are no given names, with three examples."""
    return firsts.join(given.select(F.col("word").alias("first")), "first", "left_anti").groupBy("first").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("email")), 1, 3).alias("examples"))


def rule_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Results of two rule versions (keys, email, name, owner): how many rows are dropped, added, renamed, moved or alike."""
    o = old.select(*keys, F.lit(1).alias("o"), F.col("name").alias("on"), F.col("owner").alias("oo"))
    n = new.select(*keys, F.lit(1).alias("n"), F.col("name").alias("nn"), F.col("owner").alias("no"))
    what = (
        F.when(F.col("n").isNull(), "dropped").when(F.col("o").isNull(), "added").when(~F.col("oo").eqNullSafe(F.col("no")), "moved")
        .when(F.col("on").eqNullSafe(F.col("nn")), "same").when(F.col("nn").isNull(), "name lost").when(F.col("on").isNull(), "name gained").otherwise("name changed")
    )
    return o.join(n, keys, "full").groupBy(what.alias("change")).agg(F.count("*").alias("n"))


TOP = 5
#: Reasons that results carry; older rows hold other texts, which count as one.
REASONS = ("unreachable", "robots-disallowed", "robots-unavailable", "timeout", "browser-error", "internal-error")


def reason_code(error):
    return F.when(error.isin(*REASONS), error).when(error.isNotNull(), "internal-error")


def full_summary(sites: DataFrame, results: DataFrame) -> DataFrame:
    """sites (si, site) against results (site, n_emails, error, error_detail, pages, reused, used_browser, rate_limited, budget_queued, cap_queued):
    one row of all counts; a site without a result is missing, one with addresses and an error partial."""
    r = sites.select("si", "site").join(results.withColumn("stored", F.lit(True)), "site", "left")
    n, bad = F.coalesce("n_emails", F.lit(0)), F.col("error").isNotNull()
    held = F.col("stored").isNotNull()
    add = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    some = lambda c: F.count_if(F.coalesce(c, F.lit(0)) > 0)
    return r.agg(
        F.count("*").alias("sites"), F.count_if(held & (n > 0)).alias("with_emails"), F.count_if(held & (n == 0) & ~bad).alias("no_emails"), F.count_if(held & (n == 0) & bad).alias("failed"),
        F.count_if(held & (n > 0) & bad).alias("partial"), F.count_if(~held).alias("missing"), (add("pages") - add("reused")).alias("fetched"), add("reused").alias("reused"), F.count_if(F.coalesce("used_browser", F.lit(False))).alias("browser_sites"),
        some("rate_limited").alias("limited_sites"), add("rate_limited").alias("limited_pages"), some("budget_queued").alias("late_sites"), add("budget_queued").alias("late_pages"), some("cap_queued").alias("capped_sites"), add("cap_queued").alias("capped_pages"),
    )


def _listing(df: DataFrame, what, order: list, most: int | None = TOP) -> DataFrame:
    """One row (text): the first `most` of df in an order, as one string."""
    df = df.select(what.alias("w"), F.struct(*order).alias("o")).orderBy("o")
    df = df.limit(most) if most else df
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "w"))), lambda x: x["w"]), ", ").alias("text"))


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two aggregates of one row each as one row."""
    return one.withColumn("_one", F.lit(0)).join(other.withColumn("_one", F.lit(0)), "_one").drop("_one")


def summary_text(sites: DataFrame, results: DataFrame, rows: DataFrame, title: str, most: int = TOP) -> DataFrame:
    """The lines of a list's report, (n, line), those without anything to say left out: counts, rows by the rule that named them, crawl,
    failures with details, partial, limited, late and capped sites with the first few of each, and the sites with most addresses."""
    r = sites.select("si", "site").join(results, "site")
    host = U.base_host(U.host("site"))
    counts = _beside(_beside(full_summary(sites, results), kind_counts(rows)), rows.agg(F.count("*").alias("unique")))
    failed = r.filter("n_emails = 0 AND error IS NOT NULL").withColumn("reason", reason_code(F.col("error")))
    why = failed.groupBy("reason", "error_detail").agg(F.count("*").alias("n"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error_detail").isNotNull(), F.struct((-F.col("n")).alias("m"), "error_detail", "n")))), lambda x: F.concat(x["error_detail"], F.lit("="), x["n"].cast("string"))), ", ")
    why = why.groupBy("reason").agg(F.sum("n").alias("n"), inner.alias("inner"))
    parts = {"why": _listing(why, F.concat("reason", F.lit("="), F.col("n").cast("string"), F.when(F.col("inner") != "", F.concat(F.lit(" ("), "inner", F.lit(")"))).otherwise("")), [-F.col("n"), F.col("reason")], None)}
    for name, c in (("top", "n_emails"), ("limited", "rate_limited"), ("late", "budget_queued"), ("capped", "cap_queued")):
        parts[name] = _listing(r.filter(F.coalesce(c, F.lit(0)) > 0), F.concat(host, F.lit(" ("), F.col(c).cast("string"), F.lit(")")), [-F.col(c), F.col("si")], most)
    for name, df in parts.items():
        counts = _beside(counts, df.withColumnRenamed("text", name))
    said = lambda form, *cols: F.format_string(form, *[F.col(c) for c in cols])
    lines = [
        F.lit(title),
        said("Websites: %d total, %d with e-mails, %d without, %d failed", "sites", "with_emails", "no_emails", "failed"),
        said("E-mails: %d unique (%d person, %d department, %d mailbox, %d input name, %d business, %d domain)", "unique", "person", "department", "mailbox", "input", "business", "domain"),
        said("Crawl: %d pages fetched, %d reused, browser on %d sites", "fetched", "reused", "browser_sites"),
        F.when(F.col("missing") > 0, said("Missing: %d sites without a result", "missing")),
        F.when(F.col("why") != "", said("Failures: %s", "why")),
        F.when(F.col("partial") > 0, said("Partial: %d sites kept what was found before an error", "partial")),
        F.when(F.col("limited_sites") > 0, said("Limited: %d pages on %d sites: %s", "limited_pages", "limited_sites", "limited")),
        F.when(F.col("late_sites") > 0, said("Out of time: %d pages on %d sites: %s", "late_pages", "late_sites", "late")),
        F.when(F.col("capped_sites") > 0, said("Capped: %d pages on %d sites: %s", "capped_pages", "capped_sites", "capped")),
        F.when(F.col("top") != "", said("Top sites: %s", "top")),
    ]
    return counts.select(F.posexplode(F.array_compact(F.array(*lines))).alias("n", "line"))


def site_lists(sites: DataFrame, results: DataFrame) -> DataFrame:
    """The report's lists, a row a site: (si, list, host, detail) of failed sites and of those without addresses."""
    r = sites.select("si", "site").join(results, "site").filter("n_emails = 0")
    detail = F.concat_ws(": ", "error", "error_detail")
    return r.select("si", F.when(F.col("error").isNull(), "no e-mails").otherwise("failed").alias("list"), U.base_host(U.host("site")).alias("host"), detail.alias("detail"))


def preview(plans: DataFrame) -> DataFrame:
    """What a run would do, in words, from plans (list, site, action): one line a list."""
    n = plans.groupBy("list").pivot("action", ["recrawl", "resume", "new", "none"]).count().na.fill(0)
    return n.select("list", F.format_string("%s: %d to crawl again, %d to continue, %d new, %d left alone", "list", "recrawl", "resume", "new", "none").alias("line"))


def completeness(old: DataFrame, new: DataFrame, keys: list[str], parts: int = 1) -> DataFrame:
    """How many of the old keys the new store holds: checked, missing. `parts` > 1 checks the one in `parts` with hash 0, a report's sample."""
    sample = old.select(*keys).distinct().filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == 0)
    held = sample.join(new.select(*keys).distinct().withColumn("_held", F.lit(True)), keys, "left")
    return held.agg(F.count("*").alias("checked"), F.count_if(F.col("_held").isNull()).alias("missing"))
