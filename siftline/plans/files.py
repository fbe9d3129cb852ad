"""More of the catalogue: logs and lists as files, stored state, rules on single values, word lists; each with its own DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import emails as E
from siftline.functions import urls as U
from siftline.operators import filters, frontier, lists, reports, rows, store
from siftline.plans.queries import _BASE, _KEY, _PATH, QUERIES, SQL, query, t
from siftline.sources import readers, writers
from siftline.sources.shared import new_path

__all__ = ["QUERIES", "SQL"]

# Files ------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def json_log(spark, d):
    """Two columns of a log of JSON lines in which every tenth line is cut off."""
    path = new_path(spark, "log")
    line = F.to_json(F.struct("event_id", "event_type", "value", "props"))
    t(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.substr(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string")


@query("SELECT n_name || ': ' || n_nationkey || ' sites, ' || n_regionkey || ' e-mails' AS head, n_nationkey AS sites, n_regionkey AS emails FROM nation")
def log_blocks(spark, d):
    path = new_path(spark, "blocks")
    head = F.format_string("%s: %d sites, %d e-mails", "n_name", "n_nationkey", "n_regionkey")
    t(spark, d, "nation").select(F.concat(head, F.lit("\n  second line\n")).alias("value")).coalesce(1).write.text(path)
    return readers.text_log(spark, path).select("head", "sites", "emails")


@query("SELECT s_name AS name, 's' || s_suppkey || '@mail.test' AS email, 'https://s' || s_suppkey || '.test/' AS website, '' AS link FROM supplier WHERE s_suppkey % 3 <> 0")
def rows_round_trip(spark, d):
    """Output rows written as one ordered file and read again; rows without an address go, a missing link is empty."""
    path = new_path(spark, "rows")
    k = F.col("s_suppkey")
    found = t(spark, d, "supplier").select(k.alias("si"), F.lit(0).alias("ei"), F.col("s_name").alias("name"), F.when(k % 3 != 0, F.concat(F.lit("s"), k, F.lit("@mail.test"))).otherwise(" ").alias("email"), F.concat(F.lit("https://s"), k, F.lit(".test/")).alias("website"), F.lit(None).cast("string").alias("link"))
    writers.rows_csv(found, path)
    return readers.output_rows(spark, path).drop("file")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def places_by_country(spark, d):
    path = new_path(spark, "places")
    writers.places(t(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("n"), "c_nationkey").alias("country")), path)
    return readers.places(spark, path, "n3").select("c_custkey", "c_name")


@query("SELECT DISTINCT trim(lower(unnest(string_split(p_name, ' ')))) AS word FROM part")
def word_list(spark, d):
    path = new_path(spark, "words")
    t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.concat(F.lit(" "), F.upper("w"), F.lit("\t")).alias("value")).write.text(path)
    return readers.words(spark, path)


@query("SELECT doc_id, text FROM documents")
def decoded_pages(spark, d):
    """Texts stored in one of two encodings, named by a header or not at all."""
    utf16 = F.col("doc_id") % 2 == 0
    stored = t(spark, d, "documents").select("doc_id", F.when(utf16, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8")).alias("content"), F.when(utf16, "utf-16le").when(F.col("doc_id") % 3 == 0, "no-such-set").alias("charset"))
    return stored.select("doc_id", readers.decode_page(F.col("content"), F.col("charset")).alias("text"))


@query("SELECT n_nationkey AS ord, 'www.n' || n_nationkey || '.test' AS site, n_name AS input_name FROM nation")
def listed_sites(spark, d):
    """A list file whose columns are found by their heads: an odd one for the website, one for the name."""
    path = new_path(spark, "sites")
    k = F.col("n_nationkey")
    n = t(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("Business Name"), F.concat(F.lit("www.n"), k, F.lit(".test")).alias("Web address"))
    n.orderBy("id").coalesce(1).write.option("header", True).csv(path)
    return lists.listed(readers.csv_list(spark, f"{path}/*.csv")).select((F.col("ord") - 1).cast("int").alias("ord"), "site", "input_name")


# Stored state -----------------------------------------------------------------------------------------------------------

_VERSIONS = f"SELECT {_KEY} AS page_key, page_id AS fetched_at FROM pages"


def _versions(spark, d):
    k = F.col("page_id")
    return t(spark, d, "pages").select(F.lit("http").alias("mode"), U.page_key("url").alias("page_key"), k.alias("fetched_at"), k.alias("seq"), "url")


@query(f"SELECT page_key, greatest(max(fetched_at), max(CASE WHEN fetched_at % 5 = 0 THEN fetched_at + 1000 END)) AS fetched_at FROM ({_VERSIONS}) GROUP BY page_key")
def touched_pages(spark, d):
    v = _versions(spark, d)
    touches = v.filter("fetched_at % 5 = 0").select("mode", "page_key", (F.col("fetched_at") + 1000).alias("validated_at"))
    return store.touched(v, touches).select("page_key", "fetched_at")


@query(f"""WITH v AS ({_VERSIONS}), h AS (SELECT page_key, max(fetched_at) AS at FROM v WHERE fetched_at % 2 = 0 GROUP BY page_key)
SELECT v.page_key, v.fetched_at + v.fetched_at % 3 - 1 AS fetched_at FROM v LEFT JOIN h USING (page_key) WHERE h.at IS NULL OR h.at < v.fetched_at + v.fetched_at % 3 - 1""")
def put_newer_pages(spark, d):
    v = _versions(spark, d)
    new = v.withColumn("fetched_at", F.col("fetched_at") + F.col("fetched_at") % 3 - 1)
    return store.put_if_newer(v.filter("fetched_at % 2 = 0"), new).select("page_key", "fetched_at")


@query(f"SELECT page_key, max(fetched_at) AS fetched_at FROM ({_VERSIONS}) WHERE fetched_at % 6 <> 0 GROUP BY page_key")
def compacted_pages(spark, d):
    """A compaction of rows of two versions: some name their key as older rows do, damaged ones have none."""
    v, old = _versions(spark, d), F.col("fetched_at") % 2 == 0
    log = v.withColumn("k", F.when(old & (F.col("fetched_at") % 6 != 0), F.col("page_key"))).withColumn("page_key", F.when(~old, F.col("page_key")))
    return store.compact(store.upgrade(log, {"k": "page_key"})).select("page_key", "fetched_at")


@query("""WITH e AS (SELECT user_id % 9 AS list, event_id AS seq, event_type AS type, day(ts) AS generation FROM events),
c AS (SELECT list, arg_max(type, seq) = 'signup' AS cut FROM e WHERE type IN ('signup', 'purchase') GROUP BY list), g AS (SELECT list, max(generation) AS generation FROM e GROUP BY list)
SELECT list, CASE WHEN cut THEN 'resume' ELSE 'new' END AS action, (generation + CASE WHEN cut THEN 0 ELSE 1 END)::INT AS generation FROM g JOIN c USING (list)""")
def begun_lists(spark, d):
    kind = F.when(F.col("event_type") == "signup", "list.start").when(F.col("event_type") == "purchase", "list.end")
    e = t(spark, d, "events").select(F.lit("c").alias("cat"), (F.col("user_id") % 9).alias("list"), F.col("event_id").alias("seq"), kind.alias("type"), F.dayofmonth("ts").alias("generation"))
    return store.begin_list(e, e).select("list", "action", "generation")


@query("""WITH e AS (SELECT user_id AS site, event_id % 20 AS url, event_id AS seq, (event_id % 4)::INT AS depth, event_type = 'view' AS fresh FROM events)
SELECT site, url, arg_max(depth, (fresh, seq)) AS depth, min((fresh, seq)).seq AS first_seq FROM e GROUP BY site, url""".replace("min((fresh, seq)).seq", "arg_min(seq, (fresh, seq))"))
def limited_pages(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("site"), (F.col("event_id") % 20).alias("url"), (F.col("event_id") % 4).cast("int").alias("depth"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("fresh"))
    out = frontier.limited_pages(e.filter("NOT fresh").drop("fresh"), e.filter("fresh").drop("fresh"))
    return out.select("site", "url", "depth", F.col("at.seq").alias("first_seq"))


@query(f"SELECT DISTINCT {_BASE} AS site, {_KEY} AS key FROM pages WHERE {_KEY} NOT IN (SELECT {_KEY} FROM pages WHERE page_id % 3 = 0)")
def leftover_pages(spark, d):
    p = t(spark, d, "pages").select("page_id", U.base_host(U.host("url")).alias("site"), U.page_key("url").alias("key"))
    return frontier.leftover(p.select("site", "key").distinct(), p.filter("page_id % 3 = 0").select("site", "key"))


@query("SELECT user_id AS site, count(*) AS attempts, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_id % 50 END) AS pages, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 50 END) AS reused FROM events GROUP BY user_id")
def crawl_counters(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("site"), (F.col("event_id") % 50).alias("key"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("reused"))
    return frontier.counters(e)


@query("""WITH r AS (SELECT user_id AS site, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events WHERE event_id % 2 = 0 GROUP BY user_id), p AS (SELECT user_id AS site, count(*) AS m FROM events WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT r.site, n + m AS pages, CASE WHEN r.site % 3 = 0 THEN 0 ELSE e END + r.site % 2 AS rate_limited, CASE WHEN r.site % 5 = 0 THEN NULL WHEN r.site % 7 = 0 THEN 'timeout' END AS error FROM r JOIN p ON r.site = p.site""")
def resumed_results(spark, d):
    """Earlier results and the passes that went on with them: a timeout is cleared unless the pass was cut off too."""
    e, site = t(spark, d, "events"), F.col("user_id").alias("site")
    s = F.col("site")
    old = e.filter("event_id % 2 = 0").groupBy(site).agg(F.count("*").alias("pages"), F.count_if(F.col("event_type") == "error").alias("rate_limited"))
    old = old.withColumns({"reused": F.lit(0), "queued": F.lit(4), "error": F.when(s % 5 == 0, "timeout"), "owed": F.lit(None).cast("string")})
    new = e.filter("event_id % 2 = 1").groupBy(site).agg(F.count("*").alias("pages"))
    new = new.withColumns({"reused": F.lit(0), "rate_limited": s % 2, "queued": F.lit(0), "took_queued": F.lit(True), "took_limited": s % 3 == 0, "has_emails": F.lit(False), "aborted": (s % 7 == 0) & (s % 5 != 0)})
    return frontier.resume_merge(old, new).select("site", "pages", "rate_limited", "error")


# Rules on single values -------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, regexp_replace({_PATH}, '/+$', '') = '/en' OR starts_with({_PATH}, '/en/') AS inside, regexp_extract({_KEY}, '^[^/?]*') AS host FROM pages")
def section_flag(spark, d):
    return t(spark, d, "pages").select("page_id", U.in_section("url", F.lit("/en/")).alias("inside"), U.host_of_key(U.page_key("url")).alias("host"))


_CODES = ["ENOTFOUND", "ETIMEDOUT", "CERT_HAS_EXPIRED", "ECONNRESET", "403", "HTTP 500", "odd", None]
_FAILS = ["dns", "timeout", "tls", "connection", "refused", "status", "other", "other"]


@query(f"SELECT event_id, [{', '.join(repr(x) for x in _FAILS)}][event_id % 8 + 1] AS kind FROM events")
def fail_kinds(spark, d):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 8 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", U.fail_kind(code).alias("kind"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3000 WHEN 1 THEN least(greatest(event_id * 1000, 1000), 30000) WHEN 2 THEN 9000 ELSE 1000 END::BIGINT AS wait FROM events")
def retry_waits(spark, d):
    """Seconds, a date nine seconds on, a date that is past, or neither."""
    k = F.col("event_id")
    value = F.when(k % 4 == 0, "soon").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "Mon, 01 Jan 2024 00:00:09 GMT").otherwise("Sun, 31 Dec 2023 00:00:00 GMT")
    return t(spark, d, "events").select("event_id", U.retry_after_ms(value, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).cast("long").alias("wait"))


@query("SELECT s_suppkey, 's' || s_suppkey || '@mail.test' AS email FROM supplier")
def protected_addresses(spark, d):
    """Addresses written as hexadecimal bytes under a key, and read again."""
    key = F.col("s_suppkey") % 255 + 1
    plain = F.concat(F.lit("s"), "s_suppkey", F.lit("@mail.test"))
    code = F.array_join(F.transform(F.split(plain, ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c).bitwiseXOR(key.cast("int"))), 2, "0"))), "")
    read = F.pandas_udf(lambda x: x.map(E.protected), "string")
    return t(spark, d, "supplier").select("s_suppkey", read(F.concat(F.lower(F.lpad(F.hex(key), 2, "0")), code)).alias("email"))


_IPS = ["8.8.8.8", "10.1.2.3", "192.168.0.9", "172.20.1.1", "127.0.0.1", "::1", "2001:4860:4860::8888", "::ffff:10.0.0.1", "not one", "224.0.0.5"]
_PUBLIC = [True, False, False, False, False, False, True, False, False, False]


@query(f"SELECT event_id, {_PUBLIC}[event_id % 10 + 1] AS public FROM events")
def public_addresses(spark, d):
    ip = F.element_at(F.array(*map(F.lit, _IPS)), (F.col("event_id") % 10 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", filters.public_address(ip).alias("public"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)brand#1') AND p_size::VARCHAR LIKE '1%' OR regexp_matches(p_type, '(?i)tin$')")
def tagged_places(spark, d):
    p = t(spark, d, "part").withColumn("tags", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")))
    return p.filter(filters.tag_selector(F.col("tags"), [[("brand", "brand#1"), ("size", "^1")], [("type", "tin$")]])).select("p_partkey")


_ENDS = ["nz", "co.nz", "fr", "io", "govt.nz", "com", "gov"]
_CLASSES = ["new", "new", "foreign", "new", "blocked", "new", "blocked"]


@query(f"SELECT s_suppkey AS ord, [{', '.join(repr(x) for x in _CLASSES)}][s_suppkey % 7 + 1] AS class FROM supplier")
def foreign_sites(spark, d):
    """Sites under several endings as candidates for a list of one country."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    sites = t(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("www.s"), "s_suppkey", F.lit("."), end).alias("site"))
    none = spark.createDataFrame([], "key string"), spark.createDataFrame([], "domain string")
    return lists.classify(sites, *none, country="nz").select("ord", "class")


# Names and words --------------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT user_id AS site, 'n' || (event_id % 4) AS name, 'n' || (event_id % 3) || '.' || event_id || '@x.test' AS email, event_id FROM events WHERE event_id % 5 < 2)
SELECT site, email, CASE WHEN count(*) OVER (PARTITION BY site, name) >= 2 AND NOT contains(email, name || '.') AND event_id % 7 <> 0 THEN NULL ELSE name END AS name FROM h""")
def demoted_names(spark, d):
    """Page names that several addresses of a site carry: kept where the address has them, or structured data said so."""
    k = F.col("event_id")
    h = t(spark, d, "events").filter(k % 5 < 2).select(F.col("user_id").alias("site"), F.concat(F.lit("n"), k % 4).alias("name"), F.concat(F.lit("n"), k % 3, F.lit("."), k, F.lit("@x.test")).alias("email"), F.when(k % 7 == 0, "jsonld").otherwise("text").alias("source"), F.lit("page").alias("name_from"))
    return rows.demote_shared_names(h).select("site", "email", "name")


@query("""WITH h AS (SELECT user_id AS site, 'p' || (event_id % 3) AS f, (event_id % 11)::VARCHAR AS r, event_id % 2 = 0 AS own, event_id FROM events), n AS (SELECT site, f, count(DISTINCT r) FILTER (own) AS k FROM h GROUP BY site, f)
SELECT event_id, CASE WHEN own AND k >= 5 THEN NULL ELSE 'N' END AS name FROM h JOIN n USING (site, f)""")
def demoted_roles(spark, d):
    """First parts of local parts with five rests or more at a site name branches: names from them go."""
    k = F.col("event_id")
    h = t(spark, d, "events").select("event_id", F.col("user_id").alias("site"), F.concat(F.lit("p"), k % 3, F.lit("."), k % 11, F.lit("@x.test")).alias("email"), F.lit("N").alias("name"), F.when(k % 2 == 0, "local").otherwise("page").alias("name_from"))
    return rows.demote_role_prefixes(h).select("event_id", "name")


@query("SELECT p_brand AS name, count(DISTINCT p_size) AS years, max(p_retailprice) AS percent FROM part GROUP BY p_brand ORDER BY years DESC, percent DESC, name LIMIT 10")
def popular_names(spark, d):
    return reports.popular_names(t(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("percent")), 10)


_TOKENS = "SELECT unnest(regexp_split_to_array(lower({0}), '[^a-z]+')) AS word FROM part"


@query(f"SELECT word, sum(n)::BIGINT AS weight FROM (SELECT word, count(*) AS n FROM ({_TOKENS.format('p_name')}) GROUP BY 1 UNION ALL SELECT word, count(*) FROM ({_TOKENS.format('p_type')}) GROUP BY 1) WHERE word <> '' GROUP BY word")
def vocabulary_weights(spark, d):
    p = t(spark, d, "part")
    return reports.vocabulary(*[reports.token_frequency(p, c).select(F.col("token").alias("word"), F.col("n").alias("weight")) for c in ("p_name", "p_type")])


@query("SELECT p_brand AS first, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_name)))[1:3], '|') AS examples FROM part WHERE p_brand NOT LIKE '%1' GROUP BY p_brand")
def unknown_firsts(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("first"), F.col("p_name").alias("email"))
    given = p.filter("first LIKE '%1'").select(F.col("first").alias("word")).distinct()
    return reports.unknown_firsts(p, given).select("first", "n", F.array_join("examples", "|").alias("examples"))


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {k}" for e, k in zip(("click", "view", "signup", "purchase", "error", "none"), rows.KINDS, strict=True)) + " FROM events")
def kind_counter(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in zip(("click", "view", "signup", "purchase", "error"), rows.KINDS, strict=False) for x in pair]), F.col("event_type"))
    return rows.kind_counts(t(spark, d, "events").select(kind.alias("kind")))


@query("""WITH h AS (SELECT doc_id % 211 AS email, source AS si, doc_id AS ei, CASE WHEN doc_id % 5 = 0 THEN 'raw' ELSE 'text' END AS source, doc_id % 7 = 0 AS owner FROM documents),
c AS (SELECT email, arg_min(si, (CASE WHEN owner THEN 0 WHEN source <> 'raw' THEN 1 ELSE 2 END, si, ei)) AS si, min(si) AS first_si FROM h GROUP BY email) SELECT email, first_si, si FROM c WHERE si <> first_si""")
def first_against_credit(spark, d):
    h = t(spark, d, "documents").select((F.col("doc_id") % 211).alias("email"), F.col("source").alias("si"), F.col("doc_id").alias("ei"), F.when(F.col("doc_id") % 5 == 0, "raw").otherwise("text").alias("source"), (F.col("doc_id") % 7 == 0).alias("owner"))
    return rows.first_against_credit(h)
