"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from siftline import api
from siftline.functions import domains, register, urls
from siftline.operators import filters, frontier, html, lists, reports, rows, store
from siftline.sources import imports, readers, writers
from siftline.streaming import latest

PAGE = """<html><head><title>Home | City Vets</title><meta property="og:site_name" content="City Vets">
<script type="application/ld+json">{"@type":["Person"],"name":"Jane Smith","email":"jane@acme.nz"}</script></head><body>
<a href="mailto:bob@acme.nz?subject=x">Bob Brown</a> <a href="/team">Team</a> <a href="https://acme.nz/team/">T</a> <a href="tel:1">t</a>
<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Vera Young</span><span itemprop="email">vera@acme.nz</span></div>
<div class="card"><h3>Paul Green</h3><p>paul [at] acme.nz</p></div><i data-cfemail="42282d0223212f276c2c38"></i>
<p>info@acme.nz<p>logo@2x.png<script>var x = "raw@acme.nz"</script><footer>&copy; 2024 City Vets.</footer></body></html>"""


def test_page_hits(spark):
    pages = spark.createDataFrame([(1, "https://acme.nz/", PAGE), (2, "https://acme.nz/x", None)], "page_id long, url string, html string")
    f = html.page_features(pages)
    got = {r["email"]: (r["name"], r["source"], r["name_from"]) for r in html.hits(f).collect()}
    assert got["jane@acme.nz"] == ("Jane Smith", "jsonld", "page")
    assert got["vera@acme.nz"][:2] == ("Vera Young", "microdata")
    assert got["bob@acme.nz"][:2] == ("Bob Brown", "mailto")
    assert got["jo@acme.nz"][1] == "cfemail"
    assert got["paul@acme.nz"][:2] == ("Paul Green", "text")
    assert got["info@acme.nz"] == (None, "text", None) and got["raw@acme.nz"][1] == "raw"
    one = f.filter("page_id = 1").first()
    assert one["business"] == "City Vets"
    assert [r["to_key"] for r in html.page_links(f).collect()] == ["acme.nz/team"]


def test_first_named(spark):
    h = spark.createDataFrame([("a", 1, None), ("a", 2, "X"), ("a", 3, "Y"), ("b", 5, None), ("b", 4, None)], "email string, seq int, name string")
    got = {r["email"]: (r["name"], r["seq"], r["position"]) for r in rows.first_named(h, ["email"]).collect()}
    assert got == {"a": ("X", 2, 1), "b": (None, 4, 4)}


def test_store(spark):
    log = spark.createDataFrame([("c", "l", 1, "x", "site", 1), ("c", "l", 2, "x", "site", 2), ("c", "l", 2, "y", "site", 3), ("c", "l", 2, "y", "drop", 4), ("c", "m", 1, "z", "drop", 5), ("c", "m", 1, "z", "site", 6)], "cat string, list string, generation int, site string, type string, seq int")
    assert sorted((r["list"], r["site"]) for r in store.sites_current(log).collect()) == [("l", "x"), ("m", "z")]
    ev = spark.createDataFrame([("c", "l", "list.start", 1), ("c", "l", "list.end", 2), ("c", "m", "list.end", 1), ("c", "m", "list.start", 3)], "cat string, list string, type string, seq int")
    assert [r["list"] for r in store.interrupted(ev).collect()] == ["m"]
    assert {r["list"]: (r["action"], r["generation"]) for r in store.begin_list(log, ev).collect()} == {"l": ("new", 3), "m": ("resume", 1)}
    pages = spark.createDataFrame([("http", "a", 5, 1), ("http", "a", 5, 2), ("http", "a", 4, 3)], "mode string, page_key string, fetched_at int, seq int")
    assert store.pages_current(pages).first()["seq"] == 2


def test_assign(spark):
    sites = spark.createDataFrame([(0, "https://acme.co.nz/", None, "Acme Ltd", None), (1, "https://vets.co.nz/", None, "City Vets", "City Vets Ltd")], "si int, site string, final_url string, business string, input_name string")
    e = [(0, 0, "info@acme.co.nz", None, "text"), (0, 1, "jane.smith@acme.co.nz", None, "text"), (0, 2, "northshop@acme.co.nz", None, "text"), (0, 3, "info@vets.co.nz", None, "text"), (1, 0, "info@vets.co.nz", None, "raw"), (1, 1, "someone99@gmail.com", "=Bad", "text"), (0, 4, "info@cityvet.nz", None, "text")]
    emails = spark.createDataFrame([(si, ei, m, n, s, None, "https://acme.co.nz/contact" if si == 0 else "https://vets.co.nz/", None) for si, ei, m, n, s in e], "si int, ei int, email string, name string, source string, name_from string, link string, page_title string")
    got = {r["email"]: (r["name"], r["website"], r["kind"]) for r in rows.assign_rows(sites, emails).collect()}
    assert got["info@acme.co.nz"] == ("Acme Ltd", "https://acme.co.nz/", "business")
    assert got["jane.smith@acme.co.nz"][0] == "Jane Smith"
    assert got["northshop@acme.co.nz"] == ("Acme Ltd - Northshop", "https://acme.co.nz/", "mailbox")
    assert got["info@vets.co.nz"] == ("City Vets Ltd", "https://vets.co.nz/", "input")  # the owner is credited
    assert got["someone99@gmail.com"][0] == "'=Bad"
    assert got["info@cityvet.nz"] == ("City Vet", "https://acme.co.nz/", "domain")


SITES = "si int, site string, final_url string, business string, input_name string"
HITS = "si int, ei int, email string, name string, source string, name_from string, link string, page_title string"


def assigned(spark, sites, hits, known=()):
    emails = spark.createDataFrame([(si, ei, email, None, "text", None, link, title) for si, ei, email, link, title in hits], HITS)
    known = spark.createDataFrame(list(known), "domain string, business string")
    out = rows.assign_rows(spark.createDataFrame(sites, SITES), emails, known=known)
    return {r["email"]: (r["name"], r["kind"]) for r in out.collect()}, out


def test_assign_sections(spark):
    """A section of a bigger site: its input's name inside, the whole domain's outside, department titles on its pages."""
    site = (0, "https://health.nz/clinic", "https://health.nz/clinic", "Clinic Page", "North Clinic")
    inside, outside = "https://health.nz/clinic/team", "https://health.nz/other"
    hits = [(0, 0, "info@health.nz", inside, None), (0, 1, "mail@health.nz", inside, "Radiology"), (0, 2, "hello@health.nz", outside, None), (0, 3, "info@elsewhere.nz", outside, None), (0, 4, "x9@gmail.com", "https://health.nz/contact", None)]
    got, _ = assigned(spark, [site], hits, [("health.nz", "Health Board"), ("elsewhere.nz", "Elsewhere Ltd")])
    assert got["info@health.nz"] == ("North Clinic", "input")
    assert got["mail@health.nz"] == ("Radiology", "department")
    assert got["hello@health.nz"] == ("Health Board", "business")
    assert got["info@elsewhere.nz"] == ("Elsewhere Ltd", "business")
    without, _ = assigned(spark, [(*site[:4], None)], hits[:3])
    assert without["info@health.nz"] == ("Clinic Page", "business") and without["hello@health.nz"] == ("Health", "domain")


def test_assign_shared_hosts_and_redirects(spark):
    """Three sites on one host name only what has a word in common with them; an unrelated landing domain is not the site's own."""
    sites = [(i, f"https://m{i}.parts.nz/", None, "Parts", f"{n} Motors") for i, n in enumerate(("Alpha", "Bravo", "Carol"))] + [(3, "https://old-name.nz/", "https://newco.nz/", "Newco Ltd", None)]
    hits = [(0, 0, "info@parts.nz", "https://m0.parts.nz/", None), (1, 0, "bravo.sales@parts.nz", "https://m1.parts.nz/", None), (3, 0, "info@newco.nz", "https://newco.nz/", None), (3, 1, "info@old-name.nz", "https://newco.nz/", None), (3, 2, "info@oldname.0rg.nz", "https://newco.nz/", None)]
    got, out = assigned(spark, sites, hits, [("parts.nz", "Parts Market")])
    assert got["info@parts.nz"] == ("Parts Market", "business")
    assert got["bravo.sales@parts.nz"][0].startswith("Bravo Motors")
    assert got["info@newco.nz"][1] == "domain" and got["info@old-name.nz"] == ("Newco Ltd", "business")
    assert rows.kind_counts(out).first()["business"] == 2
    e = spark.createDataFrame([(3, "x")], "si int, email string")
    assert [tuple(r) for r in rows.redirects(spark.createDataFrame(sites, SITES), e, domains.rules(spark)).collect()] == [(3, "old-name.nz", "newco.nz")]


def test_recheck(spark):
    hits = [("s", 0, "Jane.Smith@Acme.NZ.", "Jane Smith", "text", "local", "l", "Contact Us"), ("s", 1, "bob@acme.nz", "Tom Young", "text", "page", "l", "Surgery"), ("s", 2, "bob@acme.nz ", "Bob Young", "mailto", "page", "l", None),
            ("s", 3, "sales@acme.nz", "Dr Vera Hill", "text", "page", "l", None), ("s", 4, "vet@acme.nz", "Dr Vera Hill", "text", "page", "l", None), ("s", 5, "x@example.com", None, "text", None, "l", None), ("s", 6, "q@acme.nz", "Info Sales", "jsonld", "page", "l", None)]
    got = {r["email"]: (r["name"], r["name_from"], r["page_title"]) for r in rows.recheck(spark.createDataFrame(hits, "site string, seq int, email string, name string, source string, name_from string, link string, page_title string")).collect()}
    assert got["jane.smith@acme.nz"] == ("Jane Smith", "local", None)
    assert got["bob@acme.nz"][0] == "Bob" or got["bob@acme.nz"][0] == "Bob Young"
    assert got["sales@acme.nz"][0] is None and got["vet@acme.nz"][0] == "Dr Vera Hill"
    assert "x@example.com" not in got and got["q@acme.nz"][0] is None


def test_build_rows(spark):
    sites = spark.createDataFrame([(0, "https://acme.nz/", "https://acme.nz/", "Home | Acme Ltd", None)], SITES)
    hits = spark.createDataFrame([(0, 0, "INFO@acme.nz", None, "text", None, "https://acme.nz/", None), (0, 1, "info@oldco.nz", None, "text", None, "https://acme.nz/", None)], HITS)
    history = spark.createDataFrame([(1, "https://oldco.nz/", "https://oldco.nz/", "Old Co"), (2, "https://oldco.nz/", "https://oldco.nz/", "oldco.nz"), (3, "https://oldco.nz/x", "https://oldco.nz/x", "A Section")], "seq int, site string, final_url string, business string")
    got = {r["email"]: r["name"] for r in api.build_rows(sites, hits, domains.rules(spark), history).collect()}
    assert got == {"info@acme.nz": "Acme Ltd", "info@oldco.nz": "Old Co"}
    with pytest.raises(ValueError):
        api.Options(retry_failed=True, new_only=True)


def test_demotions(spark):
    h = spark.createDataFrame([("s", "a@x.nz", "Jane Smith", "text", "page"), ("s", "jane@x.nz", "Jane Smith", "text", "page"), ("s", "z@x.nz", "Solo Name", "text", "page")], "site string, email string, name string, source string, name_from string")
    assert {r["email"]: r["name"] for r in rows.demote_shared_names(h).collect()} == {"a@x.nz": None, "jane@x.nz": "Jane Smith", "z@x.nz": "Solo Name"}
    h = spark.createDataFrame([("s", f"branch.{x}@x.nz", "Branch X", "text", "local") for x in "abcde"] + [("s", "jo.z@x.nz", "Jo Z", "text", "local")], "site string, email string, name string, source string, name_from string")
    assert [r["name"] for r in rows.demote_role_prefixes(h).filter("name IS NOT NULL").collect()] == ["Jo Z"]


def test_frontier(spark):
    links = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("t", "a", "z")], "site string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "site string, key string")
    assert {r["key"]: r["depth"] for r in frontier.reach(links, seeds, 5).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert frontier.reach(links, seeds, 1).count() == 2


def test_lists(spark):
    c = spark.createDataFrame([(1, "acme.nz"), (2, "www.acme.nz/"), (3, "??"), (4, "uni.ac.nz"), (5, "x.fr"), (6, "old.nz"), (7, "bad.nz")], "ord int, site string")
    known = spark.createDataFrame([("old.nz",)], "key string")
    blocked = spark.createDataFrame([("bad.nz",)], "domain string")
    got = {r["ord"]: r["class"] for r in lists.classify(c, known, blocked, "nz").collect()}
    assert got == {1: "new", 2: "repeated", 3: "invalid", 4: "blocked", 5: "foreign", 6: "known", 7: "blocked"}
    first, totals = lists.input_list(c.withColumn("input_name", F.lit(" A  B ")))
    assert first.count() == 5 and tuple(totals.first()) == (1, 1)


def test_filters_and_places(spark):
    p = spark.createDataFrame([("Vet A", "https://a.nz", ["Health > Vet"], {"amenity": "veterinary", "website": "https://a.nz;https://b.nz"}), ("Cafe", "", ["Food"], {"amenity": "cafe"})], "name string, website string, labels array<string>, tags map<string,string>")
    assert [r["name"] for r in filters.places_query(p, categories="vet").collect()] == ["Vet A"]
    assert [r[0] for r in p.select(filters.tag_selector(F.col("tags"), [[("amenity", "^vet")]])).collect()] == [True, False]
    assert p.select(filters.place_website(F.col("tags"))).first()[0] == "https://a.nz"
    ip = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("::ffff:127.0.0.1",), ("x",)], "a string")
    assert [r[0] for r in ip.select(filters.public_address(F.col("a"))).collect()] == [True, False, False, False]


def test_reports(spark):
    v = reports.vocabulary(spark.createDataFrame([("a", 1)], "word string, weight int"), spark.createDataFrame([("a", 2), ("b", 1)], "word string, weight int"))
    assert {r["word"]: r["weight"] for r in v.collect()} == {"a": 3, "b": 1}
    sites = spark.createDataFrame([(i, f"https://{h}.nz/") for i, h in enumerate("abcde")], "si int, site string")
    results = [("https://a.nz/", 3, None, None, 9, 4, True, 2, None, None), ("https://b.nz/", 0, "timeout", "slow", 0, 0, False, None, 5, None), ("https://c.nz/", 1, "odd text", None, 2, None, None, None, None, 7), ("https://d.nz/", 0, None, None, 1, 0, False, None, None, None)]
    r = spark.createDataFrame(results, "site string, n_emails int, error string, error_detail string, pages int, reused int, used_browser boolean, rate_limited int, budget_queued int, cap_queued int")
    found = spark.createDataFrame([("person",), ("business",), ("business",)], "kind string")
    assert [x["line"] for x in reports.summary_text(sites, r, found, "l.csv").orderBy("n").collect()] == [
        "l.csv", "Websites: 5 total, 2 with e-mails, 1 without, 1 failed", "E-mails: 3 unique (1 person, 0 department, 0 mailbox, 0 input name, 2 business, 0 domain)", "Crawl: 8 pages fetched, 4 reused, browser on 1 sites",
        "Missing: 1 sites without a result", "Failures: timeout=1 (slow=1)", "Partial: 1 sites kept what was found before an error", "Limited: 2 pages on 1 sites: a.nz (2)", "Out of time: 5 pages on 1 sites: b.nz (5)", "Capped: 7 pages on 1 sites: c.nz (7)", "Top sites: a.nz (3), c.nz (1)",
    ]
    assert sorted((x["list"], x["host"], x["detail"]) for x in reports.site_lists(sites, r).collect()) == [("failed", "b.nz", "timeout: slow"), ("no e-mails", "d.nz", "")]
    plans = spark.createDataFrame([("l", "a", "recrawl"), ("l", "b", "none"), ("l", "c", "none")], "list string, site string, action string")
    assert reports.preview(plans).first()["line"] == "l: 1 to crawl again, 0 to continue, 0 new, 2 left alone"


def test_resume(spark):
    stops = spark.createDataFrame([("s", "time", False, 3, None), ("t", "done", False, 1, None), ("u", "done", False, 1, "no-emails")], "site string, stop string, carried_capped boolean, attempts int, browser string")
    queue = spark.createDataFrame([("s", "https://s/b", 2, 9), ("s", "https://s/a", 1, 3), ("s", "https://s/c", 1, 30)], "site string, url string, depth int, pri int")
    carried = spark.createDataFrame([("s", "https://s/x", 1, 0), ("s", "https://s/y", 1, 1)], "site string, url string, depth int, seq int")
    fresh = spark.createDataFrame([("s", "https://s/x", 4, 0)], "site string, url string, depth int, seq int")
    seen = spark.createDataFrame([("s", "https://s/a"), ("s", "https://s/done")], "site string, key string")
    got = {r["site"]: r for r in frontier.resume_state(stops, queue, frontier.limited_pages(carried, fresh), seen, most=2).collect()}
    one = got["s"]["resume"]
    assert set(got) == {"s", "u"} and got["s"]["total"] == 3
    assert [tuple(x) for x in one["queued"]] == [("https://s/a", 1), ("https://s/b", 2)] and not one["capped"]
    assert [tuple(x) for x in one["limited"]] == [("https://s/x", 4), ("https://s/y", 1)] and one["seen"] == ["https://s/done"]
    old = spark.createDataFrame([("s", 5, 1, 2, 7, "timeout", "no-emails")], "site string, pages int, reused int, rate_limited int, queued int, error string, owed string")
    new = spark.createDataFrame([("s", 3, 0, 1, 0, True, False, True, False)], "site string, pages int, reused int, rate_limited int, queued int, took_queued boolean, took_limited boolean, has_emails boolean, aborted boolean")
    assert tuple(frontier.resume_merge(old, new).first()) == ("s", 8, 1, 3, 0, None, None)
    a = spark.createDataFrame([("s", [("a@x", "A")], 4, 0, "timeout")], "site string, emails array<struct<email: string, name: string>>, pages int, reused int, error string")
    b = spark.createDataFrame([("s", [("a@x", "B"), ("b@x", None)], 0, 0, "x"), ("t", [], 2, 0, None)], a.schema)
    got = {r["site"]: ([x["name"] for x in r["emails"]], r["pages"], r["error"]) for r in rows.merge_crawls(a, b).collect()}
    assert got == {"s": (["A", None], 4, "timeout"), "t": ([], 2, None)}


def test_robots_and_crawl(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow: /x?y="
    rules = readers.robots_rules(spark.createDataFrame([("https://o.nz", 200, body)], "origin string, http_status int, body string"))
    links = spark.createDataFrame([(u,) for u in ("https://o.nz/a", "https://o.nz/a/b/c", "https://o.nz/f.pdf", "https://o.nz/f.pdf?z=1", "https://o.nz/x?y=1", "https://o.nz/")], "url string")
    got = links.crossJoin(rules).select("url", urls.robots_allows(F.col("status"), F.col("rules"), "url").alias("ok")).collect()
    assert [r["ok"] for r in got] == [False, True, False, True, False, True]
    seen = spark.createDataFrame([("s", "o.nz/")], "site string, key string")
    each = links.select(F.lit("s").alias("site"), "url", F.lit("o.nz").alias("host"), urls.page_key("url").alias("key"))
    assert sorted(r["key"] for r in frontier.enqueue(seen, each, 1, 3, rules).collect()) == ["o.nz/a/b/c"]
    assert frontier.enqueue(seen, each, 4, 3, rules).count() == 0
    land = spark.createDataFrame([("s", "https://o.nz/")], "site string, url string")
    more = spark.createDataFrame([("s", "https://o.nz/p"), ("s", "https://o.nz"), ("s", "https://other.nz/")], "site string, loc string")
    assert {r["key"]: r["depth"] for r in frontier.seeds(land, more).collect()} == {"o.nz/": 0, "o.nz/p": 1}
    to = spark.createDataFrame([("s", "https://q.nz/", "https://o.nz/a"), ("t", "https://q.nz/", "https://o.nz/ok")], "site string, from_url string, to_url string")
    assert {r["site"]: r["follow"] for r in frontier.landed(to, rules).collect()} == {"s": False, "t": True}
    pages = spark.createDataFrame([("https://o.nz/b/x", "/b", "o.nz/b", "T"), ("https://o.nz/b", "/b", "o.nz/b", "T"), ("https://o.nz/c", "/b", "o.nz/b", "T")], "url string, section string, landing_key string, title string")
    assert [r["page_title"] for r in frontier.ingested(pages).collect()] == ["T", None, None]
    loads = spark.createDataFrame([("s", "a", False, False), ("s", "a", True, False), ("s", "b", True, True)], "site string, key string, ok boolean, reused boolean")
    assert tuple(frontier.counters(loads).first()) == ("s", 3, 2, 1)
    modes = spark.createDataFrame([("s", "http", True), ("t", "http", False), ("u", "http", False)], "site string, mode string, js_rendered boolean")
    assert {r["site"]: r["reason"] for r in frontier.choose_mode(modes, spark.createDataFrame([("u",)], "site string")).collect()} == {"s": "js-rendered", "t": "no-emails"}


def test_sitemap_from_roots(spark):
    import gzip

    index = b"<sitemapindex><sitemap><loc>https://s/products.xml</loc></sitemap><sitemap><loc>https://s/a.xml</loc></sitemap></sitemapindex>"
    files = [("https://s/sitemap.xml", index), ("https://s/products.xml", b"<urlset><url><loc>https://s/p&#49;</loc></url></urlset>"), ("https://s/a.xml", gzip.compress(b"<urlset><url><loc> https://s/x?a=1&amp;b=&#x32; </loc></url><url><loc><![CDATA[https://s/y]]></loc></url></urlset>")), ("https://s/unlinked.xml", b"<urlset><url><loc>https://s/no</loc></url></urlset>"), ("https://s/bad.xml", b"\x1f\x8bxx")]
    f = spark.createDataFrame(files, "url string, content binary")
    roots = spark.createDataFrame([("s", "https://s/bad.xml", 0), ("s", "https://s/missing.xml", 1), ("s", "https://s/sitemap.xml", 2)], "site string, url string, ord int")
    assert [r["loc"] for r in readers.sitemap(f, roots).orderBy("n").collect()] == ["https://s/x?a=1&b=2", "https://s/y", "https://s/p1"]
    assert [r["loc"] for r in readers.sitemap(f, roots, most_urls=2).orderBy("n").collect()] == ["https://s/x?a=1&b=2", "https://s/y"]
    assert readers.sitemap(f, roots, most_files=2).count() == 0


def test_csv_list(spark, tmp_path):
    def cells(text: bytes):
        (tmp_path / "l.csv").write_bytes(text)
        return [r["cells"] for r in readers.csv_list(spark, str(tmp_path / "l.csv")).orderBy("ord").collect()]

    assert cells(b'name,phone,website\nAcme,,acme.co.nz\n\n"Two, ""B""\nlines", 1 ,b.nz\n,,\n') == [["name", "phone", "website"], ["Acme", "", "acme.co.nz"], ['Two, "B"\nlines', "1", "b.nz"], ["", "", ""]]
    assert cells(",".join(map(str, range(50))).encode()) == [[str(i) for i in range(50)]]
    assert cells("\ufeffx,\"\"\r\na'b \"c\",d".encode()) == [["x", ""], ["a'b \"c\"", "d"]]
    assert cells(b"\xfe\xff" + "n\tw\nÅ\ta.nz".encode("utf-16-be")) == [["n", "w"], ["Å", "a.nz"]]
    rows_ = lists.listed(readers.csv_list(spark, str(tmp_path / "l.csv")).unionAll(spark.createDataFrame([], "ord long, cells array<string>")))
    assert [r["site"] for r in rows_.collect()] == ["a.nz"] or rows_.count() == 2


def test_files_and_imports(spark, tmp_path):
    for x in ("in/a.csv", "in/g/b.csv", "in/.h/c.csv", "in/g/.d.csv", "in/g/deep/e.csv", "out/g/a.csv", "out/unique/u.csv"):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_text("name,email\nA,a@x.nz\nB,\n")
    tail = lambda paths: [p.split(f"{tmp_path.name}/")[1] for p in paths]
    assert tail(readers.input_files(spark, str(tmp_path / "in"))) == ["in/a.csv", "in/g/b.csv"]
    assert {k: tail(v) for k, v in readers.output_files(spark, str(tmp_path / "out")).items()} == {"g": ["out/g/a.csv"]}
    assert writers.next_list(spark, str(tmp_path / "in"), "g", "b") .endswith("/g/b-2.csv")
    assert lists.unique_label(["au.x", "au-y"]) == "au" and lists.unique_label(["au.x", "nz.y"]) == "all"
    (tmp_path / "pages.log").write_text('{"k":"a/","m":"http","at":5}{"k":"b/","m":"http","at":6}\n{"page_key":"c/","mode":"http","fetched_at":7}\n{"k":"d')
    sources = spark.createDataFrame([("p", "pages", str(tmp_path / "pages.log")), ("r", "rows", str(tmp_path / "in/a.csv"))], "source string, kind string, path string")
    at = [str(tmp_path / x) for x in ("ledger", "store")]
    assert imports.take_in(spark, sources, *at) == {"p": 3, "r": 1} and imports.take_in(spark, sources, *at) == {}
    assert sorted((r["page_key"], r["fetched_at"]) for r in spark.read.parquet(f"{at[1]}/pages").collect()) == [("a/", 5), ("b/", 6), ("c/", 7)]
    (tmp_path / "x.log").write_text("\n".join('{"time":%d,"msg":"%s","file":"%s","site":"s"}' % r for r in ((1, "Time limit hit", "l.csv"), (3, "time budget gone", "l.csv"), (9, "fine", "l.csv"), (2, "out of time", "m.csv"))))
    limits = imports.time_limits(spark, str(tmp_path / "x.log"))
    assert sorted((r["file"], r["time"]) for r in limits.collect()) == [("l.csv", 3), ("m.csv", 2)]
    held = spark.createDataFrame([("c", "l", "s", None), ("c", "m", "s", None), ("c", "l", "t", None)], "cat string, list string, site string, budget_queued int")
    names = spark.createDataFrame([("c", "l"), ("c", "m"), ("d", "m")], "cat string, list string")
    assert [tuple(r) for r in imports.mark_budget(limits, held, names).collect()] == [("c", "l", "s", 0)]
    skip = spark.createDataFrame([(True, False), (True, True), (False, False)], "has_output boolean, interrupted boolean")
    assert [r[0] for r in skip.select(lists.skip_reason(False, False, False, False)).collect()] == ["finished", None, None]
    assert [r[0] for r in skip.select(lists.skip_reason(False, False, True, False)).collect()] == [None, None, "no-output-to-retry"]


def test_filtered_csv_and_manifest(spark, tmp_path):
    found = spark.createDataFrame([(0, 0, "A", "a@x.co.nz", "w", "l"), (0, 1, "B", "b@y.com", "w", "l")], "si int, ei int, name string, email string, website string, link string")
    path = writers.filtered_csv(found, str(tmp_path), "g", "b", filters.SuffixFilter(include=("nz",)), str(tmp_path / "log"), "r1")
    assert path.endswith("/g/filtered/b.only-nz.csv") and readers.output_rows(spark, path).count() == 1
    assert '"dropped":1' in spark.read.parquet(str(tmp_path / "log")).first()["payload"]
    assert {r["suffix"]: r["n"] for r in filters.filter_rows(found, filters.SuffixFilter(include=("com",)), domains.rules(spark))[1].collect()} == {"co.nz": 1}
    writers.manifest(spark, str(tmp_path / "m"), 2, {"a": 1})
    assert spark.read.json(str(tmp_path / "m")).first()["schema"] == 2


def test_registered_functions(spark):
    assert "page_hits" in register.register(spark)
    r = spark.sql("SELECT find_emails('write a@x.nz') AS f, clean_email('A@X.NZ.') AS c, local_name('jane.smith', 'x.nz').text AS l, name_from_domain('cityvets.nz') AS d").first()
    assert (list(r["f"]), r["c"], r["l"], r["d"]) == (["a@x.nz"], "a@x.nz", "Jane Smith", "City Vets")
    assert spark.sql("SELECT email, source FROM page_hits('https://x.nz/', '<a href=\"mailto:bob@x.nz\">Bob</a>')").first()["email"] == "bob@x.nz"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\twebsite\nÅ\ta.nz\n".encode("utf-16-le").join([b"\xff\xfe", b""]))
    assert [r["cells"] for r in readers.csv_list(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()] == [["name", "website"], ["Å", "a.nz"]]
    (tmp_path / "l.jsonl").write_text('{"k":1,"body":"x"}\n{"k":2\n{"k":3}\n{"k"')
    assert sorted(r["k"] for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()) == [1, 3]
    rob = spark.createDataFrame([("o", 200, "User-agent: *\nDisallow: /x\nCrawl-delay: 2\nSitemap: https://o/s.xml"), ("p", 503, ""), ("q", 404, "")], "origin string, http_status int, body string")
    got = {r["origin"]: (r["status"], r["disallow"], r["crawl_delay"]) for r in readers.robots_rules(rob).collect()}
    assert got["o"] == ("rules", ["/x"], 2.0) and got["p"][0] == "unavailable" and got["q"][0] == "none"
    out = spark.createDataFrame([(1, 0, "B", "b@x.nz", "w", "l"), (0, 0, "A", "a@x.nz", "w", "l")], "si int, ei int, name string, email string, website string, link string")
    writers.rows_csv(out, str(tmp_path / "out"))
    assert sorted(r["email"] for r in readers.output_rows(spark, str(tmp_path / "out")).collect()) == ["a@x.nz", "b@x.nz"]


def test_streaming(spark, tmp_path):
    schema, at = "k int, t int, v string", [str(tmp_path / x) for x in ("in", "out", "cp")]
    put = lambda rows_: spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(at[0])
    run = lambda: {r["k"]: r["v"] for r in latest.run_available(spark, at[0], schema, ["k"], ["t"], at[1], at[2], parts=3, gone="v = 'gone'").collect()}
    put([(1, 5, "new"), (2, 1, "a")])
    assert run() == {1: "new", 2: "a"}
    put([(1, 3, "late"), (2, 2, "b")])
    assert run() == {1: "new", 2: "b"}
    assert run() == {1: "new", 2: "b"}  # nothing new
    put([(2, 9, "gone"), (3, 1, "c")])
    assert run() == {1: "new", 3: "c"}
    put([(2, 8, "late"), (3, 2, "gone")])
    assert run() == {1: "new"}
    put([(2, 10, "back")])
    assert run() == {1: "new", 2: "back"}
    (tmp_path / "out/part-0/v99").mkdir(parents=True)  # what a writer that died has left
    assert run() == {1: "new", 2: "back"}
