"""URL policy as Column expressions: parts, canonical forms, keys, sections, priorities, predicates.

Regular expressions avoid look-around, so that the same rules run on engines without it. A URL that does not look like
http(s)://host... gives null parts. Hosts are lower-cased; internationalised hosts are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _any(*kinds: str) -> str:
    return "|".join("|".join(k.split()) for k in kinds)


#: Query parameters that only track: names of campaigns and clicks, of who sent the visitor, and of the visit.
NOISE = f"^({_any('utm_[a-z]+ gclid fbclid msclkid mc_[ce]id', 'ref referrer source', 'session(id)? sid phpsessid', 'print share')})$"
_IMAGES, _PAPERS, _PACKED = "jpe?g png gif svg webp ico bmp tiff?", "pdf docx? xlsx? pptx?", "zip gz rar 7z dmg exe"
_PLAYED, _PARTS = "mp[34] avi mov", "css js json xml woff2? ttf"
ASSETS = rf"(?i)\.({_any(_IMAGES, _PAPERS, _PACKED, _PLAYED, _PARTS)})$"
_SHOP, _ACCOUNT, _MACHINE = "cart checkout basket", "login logout signin signup register account", "wp-admin wp-json feed calendar cdn-cgi"
DENIED = f"(?i)/({_any(_SHOP, _ACCOUNT, _MACHINE)})(/|$)"
_REACH, _WHO, _LEGAL = "contact([-_]?us)? kontakt contacto enquir(y|ies) get-in-touch", "about([-_]?us)? team staff people", "imprint impressum"
CONTACT = f"(?i)(^|/)({_any(_REACH, _WHO, _LEGAL)})([-_./]|$)"
_PLACES, _OFFERS = "office branch location", "service practice our-"
KEYWORD = f"(?i)({_any(_PLACES, _OFFERS, 'team staff people about')})"
_DATED, _SOLD, _SORTED = "blog news posts? events?", "products? shop", "tag category archive page author"
LISTING = f"(?i)^({_any(_DATED, _SOLD, _SORTED)})$"
HOME = r"(?i)^/?((index|default|home)(\.[a-z]+)?)?/?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url) -> Column:
    found = F.lower(F.regexp_extract(_c(url), r"^[hH][tT][tT][pP][sS]?://([^/?#:@]+)", 1))
    return F.when(found != "", found)


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([a-zA-Z]+):", 1))


def path(url) -> Column:
    found = F.regexp_extract(_c(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def base_host(h) -> Column:
    """Lower-cased, without one leading www."""
    return F.regexp_replace(F.lower(_c(h)), r"^www\.", "")


def params(q) -> Column:
    return F.filter(F.split(_c(q), "&"), lambda p: p != "")


def _name(p: Column) -> Column:
    return F.split_part(p, F.lit("="), F.lit(1))


def canonical(url) -> Column:
    """Without fragment, www., double slashes, session ids, index files, last slash, tracking and empty parameters;
    parameters in stable order of their names. The scheme stays; null for what is no web URL."""
    p = F.regexp_replace(path(url), r"(?i);jsessionid=[^/]*", "")
    p = F.regexp_replace(p, "/{2,}", "/")
    p = F.regexp_replace(p, r"(?i)/(index|default)\.(html?|php|aspx?|jsp)$", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))
    kept = F.filter(params(query(url)), lambda x: ~F.lower(_name(x)).rlike(NOISE) & x.contains("=") & ~x.endswith("="))
    numbered = F.transform(kept, lambda x, i: F.struct(_name(x).alias("n"), i.alias("i"), x.alias("x")))
    q = F.array_join(F.transform(F.array_sort(numbered), lambda s: s["x"]), "&")
    return F.concat(scheme(url), F.lit("://"), base_host(host(url)), p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def page_key(url) -> Column:
    """The canonical form without its scheme."""
    return F.regexp_replace(canonical(url), "^[a-z]+://", "")


def site_key(url) -> Column:
    """Of an input: base host, path in lower case without last slashes, and all parameters in order."""
    q = F.array_join(F.array_sort(params(query(url))), "&")
    return F.concat(base_host(host(url)), F.regexp_replace(F.lower(path(url)), "/+$", ""), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def host_of_key(key) -> Column:
    return F.regexp_extract(_c(key), "^[^/?]*", 0)


def same_site(a, b) -> Column:
    return base_host(a) == base_host(b)


def crawlable(url, of_host) -> Column:
    parts = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    return F.coalesce(
        scheme(url).isin("http", "https") & same_site(host(url), of_host) & ~path(url).rlike(ASSETS) & ~path(url).rlike(DENIED) & (F.size(params(query(url))) <= 2) & (F.length(_c(url)) <= 250) & (parts <= 8),
        F.lit(False),
    )


def is_contact_page(url) -> Column:
    return F.coalesce(path(url).rlike(HOME) | path(url).rlike(CONTACT), F.lit(False))


def in_section(url, prefix) -> Column:
    p, s = F.regexp_replace(path(url), "/+$", ""), F.regexp_replace(_c(prefix), "/+$", "")
    return (p == s) | F.startswith(p, F.concat(s, F.lit("/")))


def section_prefix(given, landing) -> Column:
    """The landing path if the input had a path, the host changed, or the path has two segments; null for a home page."""
    p = F.regexp_replace(path(landing), "/+$", "")
    deep = F.size(F.filter(F.split(p, "/"), lambda s: s != "")) >= 2
    had = ~path(given).rlike(HOME)
    moved = ~same_site(host(given), host(landing))
    return F.when((had | moved | deep) & ~path(landing).rlike(HOME), p)


def priority(url, depth, section=None) -> Column:
    """The smaller the sooner: kind of page, depth, parameters, section, and listings on the way."""
    p = F.coalesce(F.try_url_decode(F.regexp_replace(path(url), r"\+", "%2B")), path(url))
    kind = F.when(p.rlike(CONTACT), 0).when(p.rlike(KEYWORD), 5).otherwise(20)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    listed = F.exists(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s.rlike(LISTING))
    out = kind + 3 * _c(depth) + F.when(query(url) != "", 4).otherwise(0) + F.when(listed, 40).otherwise(0)
    if section is not None:
        out = out + F.when(_c(section).isNull(), 0).when(in_section(url, section), -20).otherwise(15)
    return out.cast("int")


def simple_domain(h) -> Column:
    """The last two labels, three if the second last is com, co, org or net."""
    labels = F.split(_c(h), r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    n = F.when(second.isin("com", "co", "org", "net") & (F.size(labels) >= 3), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def first_label(h) -> Column:
    return F.split_part(base_host(h), F.lit("."), F.lit(1))


def related(a, b, name) -> Column:
    """Equal domains, or first labels of four letters that hold one another, or a word of the name (five letters) in b's label."""
    x, y = first_label(a), first_label(b)
    holds = (F.length(x) >= 4) & (F.length(y) >= 4) & (x.contains(y) | y.contains(x))
    named = F.exists(F.split(F.lower(F.coalesce(_c(name), F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 5) & y.contains(w))
    return F.coalesce((base_host(a) == base_host(b)) | holds | named, F.lit(False))


def normalize_input(raw) -> Column:
    """A web address as people write it, to a URL; null if it is none. Quotes and spaces around it go, https is assumed."""
    t = F.regexp_replace(F.regexp_replace(_c(raw), r"^[\s ﻿]+|[\s ﻿]+$", ""), "^[\"']|[\"']$", "")
    t = F.regexp_replace(t, r"^(?i:www)/", "www.")
    t = F.when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    h = host(t)
    ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    good = scheme(t).isin("http", "https") & (ip | h.rlike(r"^([a-z0-9\u0080-￿_]([a-z0-9\u0080-￿_-]*[a-z0-9\u0080-￿])?\.)+[a-z\u0080-￿][a-z0-9\u0080-￿-]+$"))
    rest = F.regexp_extract(t, r"^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    return F.when(good, F.concat(scheme(t), F.lit("://"), h, F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def candidate_starts(url) -> Column:
    """The input, its http form, and either with www. toggled; distinct, in this order."""
    u = _c(url)
    plain = F.regexp_replace(u, "^https://", "http://")

    def toggled(x: Column) -> Column:
        return F.when(x.rlike(r"^https?://www\."), F.regexp_replace(x, r"://www\.", "://")).otherwise(F.regexp_replace(x, "://", "://www."))

    return F.array_distinct(F.array(u, plain, toggled(u), toggled(plain)))


def fail_kind(code) -> Column:
    """Seven kinds of failure from an error code or HTTP status."""
    c = F.upper(F.coalesce(_c(code), F.lit("")))
    return (
        F.when(c.rlike("ENOTFOUND|EAI_AGAIN|DNS"), "dns").when(c.rlike("TIMEOUT|ETIMEDOUT|ABORT"), "timeout").when(c.rlike("CERT|TLS|SSL"), "tls")
        .when(c.rlike("ECONN|EPIPE|SOCKET|EHOST|ENET"), "connection").when(c.rlike("^(HTTP )?(401|403|429|503)$"), "refused").when(c.rlike(r"^(HTTP )?[45]\d\d$"), "status").otherwise("other")
    )


def retry_after_ms(value, now) -> Column:
    """Seconds or an HTTP date from `now`, between 1 and 30 s; 3 s if it is neither."""
    v = _c(value)
    seconds = F.when(v.rlike(r"^\d{1,9}$"), v.try_cast("bigint"))
    date = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds * 1000, F.unix_millis(date) - F.unix_millis(_c(now)))
    return F.when(wait.isNull(), 3000).otherwise(F.least(F.greatest(wait, F.lit(1000)), F.lit(30_000)))


def robots_allows(status, rules, url) -> Column:
    """unavailable: no; no rules: yes; else the longest pattern of rules (allow, pattern) that fits path and query decides, allowing ones
    among equals; * stands for anything, a last $ for the end."""
    q = query(url)
    target = F.concat(path(url), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))

    def fits(pattern: Column) -> Column:
        plain = F.regexp_replace(pattern, r"\$$", "")
        quoted = F.regexp_replace(F.regexp_replace(plain, r"([.+?^${}()|\[\]\\\\])", r"\\$1"), r"\*", ".*")
        return F.when(pattern == "", False).otherwise(F.regexp_like(target, F.concat(F.lit("^"), quoted, F.when(pattern.endswith("$"), "$").otherwise(""))))

    hit = F.filter(F.coalesce(_c(rules), F.array().cast("array<struct<allow: boolean, pattern: string>>")), lambda r: fits(r["pattern"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.when(_c(status) == "unavailable", False).when(_c(status) == "none", True).otherwise(F.coalesce(best["allow"], F.lit(True)))


def robots_allowed(status, disallow, url) -> Column:
    """robots_allows for a list of disallowed patterns only."""
    rules = F.transform(_c(disallow), lambda p: F.struct(F.lit(False).alias("allow"), p.alias("pattern")))
    return robots_allows(status, rules, url)
