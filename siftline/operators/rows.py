"""First and best rows by key, ownership credit and the naming of output rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import domains as D
from siftline.functions import emails as E
from siftline.functions import names as N
from siftline.functions import urls as U
from siftline.sources.shared import stored


def first_named(hits: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first hit of each key that has a name, else the first; `position` is where the key was first seen. An aggregate,
    so combining starts before the shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    out = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("name").isNull().alias("n"), F.col(seq).alias("s"))).alias("h"), F.min(seq).alias("position"))
    return out.select(*keys, "h.*", "position")


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order, as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select(*keys, "r.*")


def owner_credit(hits: DataFrame) -> DataFrame:
    """hits (email, si, ei, source, owner boolean): the credited row of each address: an owner's, else one not only from raw
    HTML, else any; the first by (si, ei)."""
    tier = F.when(F.col("owner"), 0).when(F.coalesce(F.col("source"), F.lit("")) != "raw", 1).otherwise(2)
    return first_by(hits.withColumn("tier", tier), ["email"], ["tier", "si", "ei"])


def unique_across(rows: DataFrame) -> DataFrame:
    """rows (file_ord, row_ord, email, ...): the first row of each address, whatever its case and outer spaces."""
    return first_by(rows.withColumn("key", F.lower(F.trim("email"))), ["key"], ["file_ord", "row_ord"])


def overlaps(rows: DataFrame) -> DataFrame:
    """How many addresses a later file shares with the file that had them first: first_file, later_file, n."""
    own = rows.select(F.lower(F.trim("email")).alias("key"), "file_ord").distinct()
    first = own.groupBy("key").agg(F.min("file_ord").alias("first_file"))
    return own.join(first, "key").filter("file_ord > first_file").groupBy("first_file", F.col("file_ord").alias("later_file")).agg(F.count("*").alias("n"))


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows and the new ones with keys not seen before."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def demote_shared_names(hits: DataFrame, least: int = 2) -> DataFrame:
    """A page name that several addresses of a site carry is taken from those it does not match; names from a local part
    and from structured data stay."""
    shared = F.count("*").over(Window.partitionBy("site", "name"))
    first = F.split(F.lower(F.col("name")), " ")
    local = F.lower(F.split_part(F.col("email"), F.lit("@"), F.lit(1)))
    matches = F.exists(first, lambda w: (F.length(w) > 1) & local.contains(w))
    loses = (shared >= least) & ~matches & (F.coalesce(F.col("name_from"), F.lit("page")) == "page") & ~F.coalesce(F.col("source"), F.lit("")).isin("jsonld", "microdata")
    return hits.withColumn("name", F.when(F.col("name").isNotNull() & loses, None).otherwise(F.col("name")))


def demote_role_prefixes(hits: DataFrame, least: int = 5) -> DataFrame:
    """A first part of local parts with five or more different rests at a site is a branch or role: names from it go."""
    parts = F.split(F.split_part(F.col("email"), F.lit("@"), F.lit(1)), r"[._-]", 2)
    h = hits.withColumn("_first", F.element_at(parts, 1)).withColumn("_rest", F.try_element_at(parts, F.lit(2)))
    many = F.size(F.collect_set(F.when(F.col("name_from") == "local", F.col("_rest"))).over(Window.partitionBy("site", "_first"))) >= least
    return h.withColumn("name", F.when((F.col("name_from") == "local") & many, None).otherwise(F.col("name"))).drop("_first", "_rest")


LOCAL = "kind string, text string"


def local_kind(words: N.Words | None = None):
    """An Arrow function (local, domain) -> struct of LOCAL."""
    held = words or N.Words()

    @F.pandas_udf(LOCAL)
    def told(local, domain):
        import pandas as pd

        return pd.DataFrame([N.local_name(a or "", b or "", held) for a, b in zip(local, domain)], columns=["kind", "text"])

    return told


def domain_name(words: N.Words | None = None):
    """An Arrow function: a domain's display name."""
    held = words or N.Words()

    @F.pandas_udf("string")
    def named(domain):
        return domain.map(lambda d: None if d is None else N.name_from_domain(d, held))

    return named


RECHECKED = "email string, name string, name_from string, page_title string"


def recheck(hits: DataFrame, words: N.Words | None = None, junk_domains: bool = True) -> DataFrame:
    """Stored hits (site, seq, email, name, source, name_from, link, page_title) under today's rules: addresses cleaned and merged by site
    (the first with a name, else the first), names that do not hold any more taken away."""
    held = words or N.Words()

    @F.pandas_udf(RECHECKED)
    def told(email, name, source, name_from, title):
        import pandas as pd

        none = (None,) * 4
        rows = zip(*(c.astype(object).where(c.notna(), None) for c in (email, name, source, name_from, title)))
        return pd.DataFrame([N.recheck(*r, junk_domains, held) or none for r in rows], columns=["email", "name", "name_from", "page_title"], dtype=object)

    new = hits.withColumn("_r", told("email", "name", "source", "name_from", "page_title")).filter("_r.email IS NOT NULL")
    for c in ("email", "name", "name_from", "page_title"):
        new = new.withColumn(c, F.col(f"_r.{c}"))
    return demote_shared_names(demote_role_prefixes(first_named(new.drop("_r"), ["site", "email"])))


def tidy_business():
    """An Arrow function: a page's title or name tidied for output, null if nothing of it is a name."""

    @F.pandas_udf("string")
    def told(text):
        return text.map(N.business_name)

    return told


def registered(df: DataFrame, hosts: dict[str, str], rules: DataFrame) -> DataFrame:
    """df with a registrable domain (else the host) for each of some host columns; distinct hosts are resolved once. Of what only looks
    like a suffix (or.nz) the label before is kept."""
    every = None
    for h in hosts.values():
        one = df.select(F.col(h).alias("host")).filter("host IS NOT NULL").distinct()
        every = one if every is None else every.unionAll(one)
    known = stored(D.dimension(every.distinct(), rules).select("host", F.coalesce("reg_domain", "host").alias("reg")), "registered")
    labels = F.split("host", r"\.")
    bogus = F.col("reg").rlike(r"^(co|or|org|net|com|gov|govt|edu|ac|ne|id|asn)\.[a-z]{2}$") & (F.size(labels) > 2)
    known = known.withColumn("reg", F.when(bogus, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.col("reg")))
    for name, h in hosts.items():
        df = df.join(known.select(F.col("host").alias(h), F.col("reg").alias(name)), h, "left")
    return df


def site_context(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites (si, site, final_url, business, input_name) with domain, landing, section, away, own (domains), labels, root, crowd.

    A site's own domains are its input's and, unless that is an unrelated one outside a section, its landing page's. `crowd` counts the
    sites of an input domain: many mean a shared host."""
    url = F.coalesce("final_url", "site")
    c = sites.withColumn("_in", U.base_host(U.host("site"))).withColumn("_out", U.base_host(U.host(url)))
    c = registered(c, {"domain": "_in", "landing": "_out"}, rules).withColumn("section", U.section_prefix("site", url))
    c = c.withColumn("away", ~U.related("domain", "landing", "input_name") & F.col("section").isNull())
    c = c.withColumn("own", F.array_distinct(F.array_compact(F.when(F.col("away"), F.array("domain")).otherwise(F.array("domain", "landing")))))
    c = c.withColumn("labels", F.filter(F.transform("own", U.first_label), lambda x: F.length(x) >= 4))
    c = c.withColumn("root", F.regexp_replace(U.path("site"), "/+$", "") == "")
    crowd = stored(c.groupBy("domain").agg(F.count("*").alias("crowd")), "crowd")  # stored: the join can split a host that very many sites share
    return c.join(crowd.hint("merge"), "domain", "left").drop("_in", "_out")


def redirects(sites: DataFrame, emails: DataFrame, rules: DataFrame) -> DataFrame:
    """Sites with addresses whose landing page is on an unrelated domain: si, input, landing."""
    away = site_context(sites, rules).filter("away").join(emails.select("si").distinct(), "si", "left_semi")
    return away.select("si", U.base_host(U.host("site")).alias("input"), U.base_host(U.host("final_url")).alias("landing"))


def _is_own(registered: str, host: str) -> Column:
    """A domain is the site's own if it is one of them, has their first label, or a label before it is theirs (a mistyped suffix)."""
    before = F.expr(f"slice(split({host}, '[.]'), 1, greatest(size(split({host}, '[.]')) - size(split({registered}, '[.]')), 0))")
    found = F.array_contains("own", F.col(registered)) | F.array_contains("labels", U.first_label(registered)) | F.arrays_overlap("labels", before)
    return F.coalesce(found, F.lit(False))


KINDS = ("person", "department", "input", "business", "mailbox", "domain")


def assign_rows(sites: DataFrame, emails: DataFrame, words: N.Words | None = None, known: DataFrame | None = None, rules: DataFrame | None = None, crowd_limit: int = 3, titled_limit: int = 3, free_limit: int = 2) -> DataFrame:
    """sites (si, site, final_url, business, input_name) and emails (si, ei, email, name, source, name_from, link, page_title)
    to output rows (si, ei, name, email, website, link, kind), one per address, in order of (si, ei).

    An address is credited to the site that owns it. Its name: the person's; else the organisation's, with the mailbox where the
    local part says more, or a department's page title. The organisation is the site's own for its own domain and for free mail
    of its contact pages (of `free_limit` addresses at most elsewhere); for another company's address the listed site of its domain, else its name in
    `known` (domain, business: what any list has found), else its domain in words. Inside a section of a bigger site the input's name
    counts; outside, the whole domain's. On a host that `crowd_limit` sites share, a site names only what has a word in common with it.
    """
    held = words or N.Words()
    spark = sites.sparkSession
    rules = D.rules(spark) if rules is None else rules
    known = spark.createDataFrame([], "domain string, business string") if known is None else known.select("domain", "business")
    ctx = site_context(sites, rules)
    in_words = domain_name(held)
    hostlike = F.col("business").rlike(r"^[A-Za-z0-9_.-]+\.[A-Za-z]{2,}$")
    ctx = stored(ctx.withColumn("business", F.when(hostlike, in_words("domain")).otherwise(F.col("business"))), "contexts")
    e = emails.withColumn("host", E.domain_of(F.col("email"))).withColumn("link_host", U.base_host(U.host("link")))
    e = registered(e, {"reg": "host", "link_reg": "link_host"}, rules).join(ctx, "si")
    free = sorted(held.free)
    e = e.withColumn("owner", _is_own("reg", "host")).withColumn("free", F.col("host").isin(*free) | F.col("reg").isin(*free))
    e = stored(e, "credit")
    counts = e.groupBy("si").agg(F.count_if(F.col("host").isin(*free)).alias("n_free"))
    titled = e.filter("page_title IS NOT NULL").groupBy("si", "link").agg(F.count("*").alias("n_titled"))
    out = owner_credit(e).drop("tier").join(counts, "si").join(titled, ["si", "link"], "left")
    named = F.coalesce(F.when(F.col("input_name").isNotNull(), F.struct(F.lit("input").alias("kind"), F.col("input_name").alias("text"))), F.struct(F.lit("business").alias("kind"), F.col("business").alias("text")))
    listed = first_by(ctx.filter("root").select(F.explode("own").alias("reg"), "si", named.alias("listed")), ["reg"], ["si"]).select("reg", "listed")
    out = out.join(listed, "reg", "left")
    for key in ("reg", "link_reg"):
        out = out.join(known.select(F.col("domain").alias(key), F.col("business").alias(f"{key}_known")), key, "left")
    local = F.split_part(F.col("email"), F.lit("@"), F.lit(1))
    out = out.withColumn("l", local_kind(held)(local, F.col("host")))
    for key in ("reg", "link_reg", "domain"):
        out = out.withColumn(f"{key}_words", in_words(key))

    def text(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    def whole(key: str) -> Column:
        """A whole domain's name."""
        return F.when(F.col(f"{key}_known").isNotNull(), text("business", F.col(f"{key}_known"))).otherwise(text("domain", F.col(f"{key}_words")))

    in_section = F.coalesce(U.in_section("link", "section"), F.lit(False))
    link_own = F.coalesce(_is_own("link_reg", "link_host"), F.lit(False)) | in_section

    def site(key: str) -> Column:
        by_input = F.col("input_name").isNotNull() & (F.col("section").isNull() | in_section | ~link_own)
        own = F.when(F.coalesce("business", F.lit("")) != "", text("business", F.col("business"))).otherwise(text("domain", F.col("domain_words")))
        return F.when(by_input, text("input", F.col("input_name"))).when(F.col("section").isNotNull() & ~in_section, whole(key)).otherwise(own)

    def long_words(c: Column) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(held.roles)))

    strange = (F.col("crowd") >= crowd_limit) & ~F.arrays_overlap(long_words(F.col("input_name")), long_words(local))
    by_free = link_own & (F.coalesce(U.is_contact_page("link"), F.lit(False)) | (F.col("n_free") <= free_limit))
    org = (
        F.when(F.col("owner"), F.when(strange, whole("reg")).otherwise(site("reg")))
        .when(F.col("free"), F.when(by_free, site("link_reg")))
        .otherwise(F.coalesce("listed", whole("reg")))
    )
    out = out.withColumn("org", org).withColumn("site_own", F.col("owner") | (F.col("free") & by_free))
    mail, name = F.col("l.text"), F.col("org.text")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    both = F.when(plain(name).contains(plain(mail)) | plain(mail).contains(plain(name)), name).otherwise(F.concat(name, F.lit(" - "), mail))
    title = F.col("site_own") & F.col("page_title").isNotNull() & (F.coalesce("n_titled", F.lit(0)) <= titled_limit)
    told = (
        F.when(F.col("name").isNotNull(), text("person", F.col("name")))
        .when(F.col("l.kind") == "person", text("person", mail))
        .when((F.col("l.kind") == "words") & F.col("org").isNull(), text("mailbox", mail))
        .when(F.col("l.kind").isin("words", "role") & F.col("org").isNotNull(), text("mailbox", both))
        .when(F.col("org").isNull(), text("domain", F.col("host")))
        .when(title, text("department", F.col("page_title")))
        .otherwise(F.col("org"))
    )
    out = out.withColumn("n", told)
    shown = F.when(F.coalesce("n.text", F.lit("")) != "", F.col("n.text")).otherwise(F.col("host"))
    return out.select("si", "ei", E.safe_cell(shown).alias("name"), "email", F.col("site").alias("website"), F.coalesce("link", F.lit("")).alias("link"), F.col("n.kind").alias("kind")).orderBy("si", "ei")


def kind_counts(rows: DataFrame) -> DataFrame:
    """How many rows each rule has named: one row, a column a kind."""
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def first_against_credit(hits: DataFrame) -> DataFrame:
    """Addresses that first-seen order and ownership credit give to different sites: email, first_si, si."""
    first = first_by(hits.select("email", "si", "ei"), ["email"], ["si", "ei"]).select("email", F.col("si").alias("first_si"))
    return owner_credit(hits).join(first, "email").filter("si <> first_si").select("email", "first_si", "si")


def merge_crawls(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results of two runs (site, emails, pages, reused, error) by site: all old addresses and the new ones not among them. Pages and
    error are the new run's if it has fetched a page."""
    o, n = (df.select("site", *[F.col(c).alias(f"{k}_{c}") for c in ("emails", "pages", "reused", "error")]) for k, df in (("o", old), ("n", new)))
    both = o.join(n, "site", "full")
    none = F.array().cast(old.schema["emails"].dataType)
    held = F.transform(F.coalesce("o_emails", none), lambda x: x["email"])
    emails = F.concat(F.coalesce("o_emails", none), F.filter(F.coalesce("n_emails", none), lambda x: ~F.array_contains(held, x["email"])))
    ran = F.coalesce("n_pages", F.lit(0)) > 0
    return both.select("site", emails.alias("emails"), *[F.when(F.col("o_pages").isNull() | ran, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in ("pages", "reused", "error")])
