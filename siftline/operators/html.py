"""Pages to rows: one parse a page in an Arrow function, everything after it relational.

The tree builder is the standard library's tokenizer with void elements and implied ends of p, li, td and the like; it is
not a full HTML5 tree builder. Null html is an empty page.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import emails as E
from siftline.functions import names as N
from siftline.functions import urls as U

VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HIDDEN = {"script", "style", "noscript", "template"}
SOURCES = ("jsonld", "microdata", "mailto", "cfemail", "data-attr", "text", "raw")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self, hidden: bool = False) -> Iterator[tuple["Node", str]]:
        stack: list = [(self, c) for c in reversed(self.children)]
        while stack:
            holder, c = stack.pop()
            if isinstance(c, str):
                yield holder, c
            elif hidden or c.tag not in HIDDEN:
                stack += [(c, x) for x in reversed(c.children)]

    def text(self) -> str:
        return " ".join(" ".join(t for _, t in self.strings()).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if self.at.tag in ends:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.parent:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str | None) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


def json_objects(root: Node) -> Iterator[dict]:
    """Every object of every JSON-LD block, the last found first within a block; broken blocks are skipped."""
    for n in root.walk():
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                stack = [json.loads("".join(c for c in n.children if isinstance(c, str)))]
            except ValueError:
                continue
            while stack:
                x = stack.pop()
                if isinstance(x, dict):
                    yield x
                    stack += x.values()
                elif isinstance(x, list):
                    stack += x


def _types(x: dict) -> set[str]:
    t = x.get("@type") or []
    return {str(v).rsplit("/", 1)[-1] for v in (t if isinstance(t, list) else [t])}


def _own(scope: Node) -> dict[str, str]:
    """Properties of an item that belong to no item within it."""
    out: dict[str, str] = {}
    for n in scope.walk():
        name = n.attrs.get("itemprop")
        if not name or n is scope:
            continue
        up = n.parent
        while up is not None and "itemscope" not in up.attrs:
            up = up.parent
        if up is scope:
            out.setdefault(name, n.attrs.get("content") or n.attrs.get("href", "").removeprefix("mailto:") or n.text())
    return out


def _nearby(node: Node, email: str, clean) -> str | None:
    """A person's name in a container of this address only, up to three levels up; or right before the address."""
    up = node
    for _ in range(3):
        up = up.parent
        if up is None or up.tag in ("#root", "html", "body"):
            return None
        text = " ".join(t for _, t in up.strings())
        held = {c for raw in E.find_in(text) if (c := clean(raw))} | {c for n in up.walk() if n.tag == "a" and n.attrs.get("href", "").lower().startswith("mailto:") and (c := clean(unquote(n.attrs["href"][7:].split("?")[0])))}
        if len(held) > 1:
            return None
        for n in up.walk():
            if (n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "dt", "th") or re.search(r"(^|[-_ ])name", n.attrs.get("class", ""))) and (name := N.person_name(n.text())):
                return name
        before = re.split(re.escape(email), text, maxsplit=1, flags=re.IGNORECASE)[0]
        words = before.split()[-3:]
        for k in (3, 2):
            if len(words) >= k and (name := N.person_name(" ".join(words[-k:]).rstrip(":-–, "))):
                return name
    return None


def candidates(root: Node, raw: str, junk_domains: bool = True, known_suffix=None) -> list[tuple[str, str | None, str]]:
    """(email, name, source) in the order of SOURCES."""

    def clean(x):
        return E.clean_in(x, junk_domains, known_suffix)

    out: list[tuple[str, str | None, str]] = []

    def add(x, name, source):
        if x and (email := clean(str(x).removeprefix("mailto:"))):
            out.append((email, name, source))

    for x in json_objects(root):
        if "email" in x:
            name = x.get("name") if isinstance(x.get("name"), str) and "Person" in _types(x) else None
            for v in x["email"] if isinstance(x["email"], list) else [x["email"]]:
                add(v, N.person_name(name), "jsonld")
    for n in root.walk():
        if "itemscope" in n.attrs and n.attrs.get("itemtype", "").endswith("/Person"):
            own = _own(n)
            add(own.get("email"), N.person_name(own.get("name")), "microdata")
    for n in root.walk():
        href = n.attrs.get("href", "") if n.tag == "a" else ""
        if href.lower().startswith("mailto:"):
            to = [x for x in re.split("[;,]", unquote(href[7:].split("?")[0])) if x]
            for x in to:
                name = N.person_name(n.text())
                add(x, name or (_nearby(n, clean(x) or x, clean) if len(to) == 1 else None), "mailto")
        elif "/cdn-cgi/l/email-protection#" in href:
            add(E.protected(href.split("#")[1]), N.person_name(n.text()), "cfemail")
    for n in root.walk():
        if n.attrs.get("data-cfemail"):
            email = E.protected(n.attrs["data-cfemail"])
            add(email, _nearby(n, email or "", clean), "cfemail")
    for n in root.walk():
        for k, v in n.attrs.items():
            if k.startswith("data-") and k != "data-cfemail" and "@" in v:
                for x in E.find_in(v):
                    add(x, None, "data-attr")
    holders = list(root.strings())
    text = E.deobfuscate_in(" ".join(t for _, t in holders))
    for x in E.find_in(text) if "@" in text else ():
        email = clean(x)
        holder = next((h for h, t in reversed(holders) if email and email in E.deobfuscate_in(t).lower()), None)
        add(x, _nearby_text(holder, email, clean) if holder else None, "text")
    if "@" in raw:
        for x in E.find_in(raw):
            add(x, None, "raw")
    return out


def _nearby_text(holder: Node, email: str, clean) -> str | None:
    child = Node("#text", {}, holder)
    return _nearby(child, email, clean)


def merge(found: list[tuple[str, str | None, str]], words: N.Words | None = None) -> list[dict]:
    """Per address its first source and its first name, then a name from the local part."""
    out: dict[str, dict] = {}
    for email, name, source in found:
        hit = out.setdefault(email, {"email": email, "name": None, "source": source, "name_from": None})
        if hit["name"] is None and name:
            hit |= {"name": name, "name_from": "page"}
    for hit in out.values():
        if hit["name"] is None and (name := N.name_from_local(*hit["email"].split("@"), words or N.Words())):
            hit |= {"name": name, "name_from": "local"}
    return list(out.values())


def first_text(root: Node, tag: str) -> str | None:
    return next((n.text() for n in root.walk() if n.tag == tag), None)


def page_title(root: Node) -> str | None:
    """The first h1, else the first part of the title; up to 100 characters, not generic."""
    for t in (first_text(root, "h1"), (N.SEPARATOR.split(first_text(root, "title") or "") or [None])[0]):
        if t and len(t) <= 100 and not N.GENERIC_TITLE.match(t):
            return t
    return None


def business(root: Node, host: str) -> str:
    """JSON-LD organisation, og:site_name, application-name, the title's part that fits the host, logo, footer, title, host."""
    for x in json_objects(root):
        if any(t.endswith(("Organization", "Business", "Store", "Clinic")) for t in _types(x)) and (name := N.business_name(x.get("name") if isinstance(x.get("name"), str) else None)):
            return name
    metas = {n.attrs.get("property") or n.attrs.get("name"): n.attrs.get("content") for n in root.walk() if n.tag == "meta"}
    for key in ("og:site_name", "application-name"):
        if name := N.business_name(metas.get(key)):
            return name
    parts = [p for p in N.SEPARATOR.split(first_text(root, "title") or "") if p and not N.GENERIC_TITLE.match(p)]
    key = N.base_key(host)
    for p in parts:
        if len(key) >= 4 and (key in N.fold(p) or (len(N.fold(p)) >= 4 and N.fold(p) in key)) and (name := N.business_name(p)):
            return name
    for n in root.walk():
        if n.tag == "img" and "logo" in (n.attrs.get("class", "") + n.attrs.get("src", "")).lower():
            name = N.business_name(re.sub(r"(?i)\s*logo\s*", " ", n.attrs.get("alt", "")))
            if name and len(name) <= 60:
                return name
    for n in root.walk():
        if n.tag == "footer" and (m := re.search(r"(?:©|\(c\)|copyright)\s*(?:\d{4}\s*)?(?:[-–]\s*\d{4}\s*)?([^.|·]{2,60})", n.text(), re.IGNORECASE)) and (name := N.business_name(m[1])):
            return name
    good = [x for p in parts if (x := N.business_name(p))]
    return min(good, key=len) if good else host


def links(root: Node, url: str) -> list[str]:
    base = next((urljoin(url, n.attrs["href"]) for n in root.walk() if n.tag == "base" and n.attrs.get("href")), url)
    out = []
    for n in root.walk():
        to = n.attrs.get("href") if n.tag in ("a", "area") else n.attrs.get("src") if n.tag in ("frame", "iframe") else None
        if n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"(?i)url\s*=\s*['\"]?([^'\"]+)", n.attrs.get("content", ""))):
            to = m[1]
        if to and not re.match(r"(?i)\s*(mailto|tel|javascript|data|sms|fax|whatsapp):", to):
            try:
                out.append(urljoin(base, to.strip()))
            except ValueError:
                pass
    return list(dict.fromkeys(out))


HIT = "struct<email: string, name: string, source: string, name_from: string>"
FEATURES = f"page_id long, url string, title string, h1 string, page_title string, business string, visible_chars long, links array<string>, hits array<{HIT}>"


def _features(batches: Iterator[pa.RecordBatch], junk_domains: bool) -> Iterator[pa.RecordBatch]:
    hit = pa.struct([(k, pa.string()) for k in ("email", "name", "source", "name_from")])
    kinds = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.list_(pa.string()), pa.list_(hit))
    names = ("page_id", "url", "title", "h1", "page_title", "business", "visible_chars", "links", "hits")
    for batch in batches:
        rows = []
        for page_id, url, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parse(raw)
            host = (re.match(r"(?i)https?://([^/?#:]+)", url or "") or [None, ""])[1].lower()
            rows.append((page_id, url, first_text(root, "title"), first_text(root, "h1"), page_title(root), business(root, host), len(root.text()), links(root, url or ""), merge(candidates(root, raw, junk_domains)) if raw else []))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def page_features(pages: DataFrame, junk_domains: bool = True) -> DataFrame:
    """pages (page_id, url, html) to FEATURES."""
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _features(it, junk_domains), FEATURES)


def hits(features: DataFrame) -> DataFrame:
    """One row per page and address, in order of finding (seq)."""
    return features.select("page_id", F.col("url").alias("link"), "page_title", F.posexplode("hits").alias("seq", "h")).select("page_id", "link", "page_title", "seq", "h.*")


def page_links(features: DataFrame) -> DataFrame:
    """Distinct crawlable links of each page by page key, first wins: page_id, from_key, to_url, to_key."""
    each = features.select("page_id", "url", F.posexplode("links").alias("i", "to_url"))
    each = each.filter(U.crawlable("to_url", U.host("url"))).withColumn("to_key", U.page_key("to_url"))
    first = each.groupBy("page_id", "to_key").agg(F.min_by(F.struct("url", "to_url"), "i").alias("f"))
    return first.select("page_id", U.page_key("f.url").alias("from_key"), F.col("f.to_url").alias("to_url"), "to_key")


# Without a parser, for pages known to be plain -------------------------------------------------------------------------


def tag_text(page: Column, tag: str) -> Column:
    """Text up to the next tag of the first `tag`."""
    return F.regexp_extract(page, f"<{tag}[^>]*>([^<]*)", 1)


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def visible(page: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    t = F.regexp_replace(page, r"(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def js_rendered(page: Column, least: int = 200) -> Column:
    return F.length(visible(page)) < least


def unescape(text: str) -> str:
    return _html.unescape(text)
