"""Suffix filters, undeliverable domains, tags and places."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import domains as D
from siftline.functions import emails as E
from siftline.sources.shared import stored


def parse_suffixes(text: str) -> list[str]:
    """Comma-separated suffixes; a leading dot is optional, empty ones are ignored, others than domain-like are refused."""
    out = [x.strip().lower().lstrip(".") for x in text.split(",") if x.strip()]
    for x in out:
        if not re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)*", x):
            raise ValueError(f"not a domain suffix: {x}")
    return out


@dataclass(frozen=True)
class SuffixFilter:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def tag(self) -> str:
        parts = [f"{k}-{'-'.join(sorted(set(v)))}" for k, v in (("only", self.include), ("not", self.exclude)) if v]
        return "_".join(parts) or "all"


def _ends(domain: Column, suffix: str) -> Column:
    return (domain == suffix) | domain.endswith("." + suffix)


def keep(email: Column, f: SuffixFilter) -> Column:
    d = E.domain_of(email)
    no = reduce(or_, (_ends(d, s) for s in f.exclude), F.lit(False))
    yes = reduce(or_, (_ends(d, s) for s in f.include), F.lit(not f.include))
    return F.coalesce(~no & yes, F.lit(False))


def filter_rows(rows: DataFrame, f: SuffixFilter, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the dropped ones counted by public suffix (by last label without rules)."""
    gone = rows.filter(~keep(F.col("email"), f)).select(E.domain_of(F.col("email")).alias("host"))
    if rules is None:
        ends = gone.select(F.element_at(F.split("host", r"\."), -1).alias("suffix"))
    else:
        ends = gone.join(D.dimension(gone, rules).select("host", "suffix"), "host", "left")
    return rows.filter(keep(F.col("email"), f)), ends.groupBy("suffix").agg(F.count("*").alias("n"))


def known_addresses(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose address is under a known public suffix. One that is not counts as turned by 13 letters if that is."""
    turned = E.rot13(F.col("email"))
    both = rows.select(E.domain_of(F.col("email")).alias("host")).unionAll(rows.select(E.domain_of(turned).alias("host")))
    good = stored(D.dimension(both, rules).filter("listed AND reg_domain IS NOT NULL").select("host"), "suffixes")
    out = rows.withColumn("_d", E.domain_of(F.col("email"))).withColumn("_t", E.domain_of(turned))
    out = out.join(good.select(F.col("host").alias("_d"), F.lit(True).alias("_good")), "_d", "left").join(good.select(F.col("host").alias("_t"), F.lit(True).alias("_turned")), "_t", "left")
    out = out.withColumn("email", F.when(F.col("_good"), F.col("email")).when(F.col("_turned"), turned))
    return out.filter("email IS NOT NULL").select(*rows.columns)


def drop_undeliverable(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts (domain, ok): only a definite no drops an address."""
    bad = verdicts.filter("ok = false").select(F.col("domain").alias("_d")).distinct()
    return rows.join(bad, E.domain_of(F.col("email")) == F.col("_d"), "left_anti")


def tag_selector(tags: Column, any_of: list[list[tuple[str, str]]]) -> Column:
    """Any of some rules, each of which asks for all its key ~ pattern pairs; patterns match anywhere, in any case."""
    rule = lambda pairs: reduce(and_, (F.coalesce(F.try_element_at(tags, F.lit(k)).rlike(f"(?i){p}"), F.lit(False)) for k, p in pairs))
    return reduce(or_, map(rule, any_of), F.lit(False))


def place_website(tags: Column) -> Column:
    first = F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in ("website", "contact:website", "url")])
    return F.trim(F.split_part(first, F.lit(";"), F.lit(1)))


def places_query(places: DataFrame, categories: str | None = None, names: str | None = None, bbox: tuple[float, float, float, float] | None = None, need_website: bool = True) -> DataFrame:
    """places (name, website, labels, latitude, longitude): any category or name pattern, within a box, by name and website."""
    any_of = [F.array_join("labels", "|").rlike(f"(?i){categories}")] if categories else []
    any_of += [F.col("name").rlike(f"(?i){names}")] if names else []
    out = places.filter(reduce(or_, any_of)) if any_of else places
    if bbox:
        west, south, east, north = bbox
        out = out.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    if need_website:
        out = out.filter(F.trim(F.coalesce("website", F.lit(""))) != "")
    return out.orderBy("name", "website")


def label_counts(places: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Labels that hold the pattern, with their places and those with a website; with `most`, that many of the most frequent, in order."""
    each = places.select(F.explode("labels").alias("label"), "website").filter(F.col("label").ilike(f"%{pattern}%"))
    out = each.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("website", F.lit(""))) != "").alias("with_website"))
    return out.orderBy(F.desc("n"), "label").limit(most) if most else out


def public_address(address: Column) -> Column:
    """Whether an IP address is neither private, local, reserved nor multicast."""

    @F.pandas_udf("boolean")
    def told(x):
        import ipaddress

        def one(a):
            try:
                ip = ipaddress.ip_address(a)
            except ValueError:
                return False
            mapped = getattr(ip, "ipv4_mapped", None)
            return bool((mapped or ip).is_global and not (mapped or ip).is_multicast)

        return x.map(one)

    return told(address)
