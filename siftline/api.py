"""Entry points: what a run over stored results does, one function each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import names as N
from siftline.operators import filters, reports, rows, store


@dataclass(frozen=True)
class Options:
    """Parameters of a run; what excludes what is checked when they are made."""

    include: str = ""
    exclude: str = ""
    junk_domains: bool = True
    retry_failed: bool = False
    retry_limited: bool = False
    retry_budget: bool = False
    retry_capped: bool = False
    new_only: bool = False
    summary_only: bool = False
    revalidate_days: float | None = None
    max_pages: int = 150
    max_depth: int = 7

    def __post_init__(self):
        if self.retry and (self.new_only or self.summary_only):
            raise ValueError("a retry is neither a run of new sites nor a summary")
        if self.new_only and self.summary_only:
            raise ValueError("a summary takes in no new sites")
        if self.max_pages < 1 or self.max_depth < 0:
            raise ValueError("limits must be positive")

    @property
    def retry(self) -> bool:
        return self.retry_failed or self.retry_limited or self.retry_budget or self.retry_capped

    @property
    def suffixes(self) -> filters.SuffixFilter:
        return filters.SuffixFilter(tuple(filters.parse_suffixes(self.include)), tuple(filters.parse_suffixes(self.exclude)))

    def cutoff(self, start_ms: int) -> int:
        """Stored pages from this time on are used again."""
        return start_ms if self.revalidate_days is None else int(start_ms - self.revalidate_days * 86_400_000)


def build_rows(sites: DataFrame, hits: DataFrame, rules: DataFrame, history: DataFrame | None = None, words: N.Words | None = None, options: Options = Options()) -> DataFrame:
    """The pure query: sites (si, site, final_url, business, input_name) and stored hits (si, ei, email, name, source, name_from, link, page_title), re-checked under
    today's rules, credited and named. history: results of all lists (seq, site, final_url, business)."""
    again = rows.recheck(hits.withColumn("site", F.col("si")).withColumn("seq", F.col("ei")), words, options.junk_domains).drop("site")
    again = again.withColumn("ei", F.col("position")).drop("position", "seq")
    known = store.domain_names(history, rules) if history is not None else None
    tidy = sites.withColumn("business", F.coalesce(rows.tidy_business()("business"), rows.U.base_host(rows.U.host(F.coalesce("final_url", "site")))))
    return rows.assign_rows(tidy, again, words, known, rules)


def unique_rows(found: DataFrame) -> DataFrame:
    return rows.unique_across(found)


def filter_rows(found: DataFrame, options: Options, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return filters.filter_rows(found, options.suffixes, rules)


def drop_undeliverable(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    return filters.drop_undeliverable(found, verdicts)


def plan_retries(results: DataFrame, options: Options) -> DataFrame:
    return store.plan_retries(results, options.retry_failed, options.retry_limited, options.retry_budget, options.retry_capped)


def preview(results: DataFrame, options: Options) -> DataFrame:
    """What a run would do with each list, from its results (list, site, ...), in words; nothing is done."""
    plans = plan_retries(results, options).join(results.select("list", "site").distinct(), "site")
    return reports.preview(plans)
