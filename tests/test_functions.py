"""Rules on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import domains as D
from siftline.functions import emails as E
from siftline.functions import names as N
from siftline.functions import urls as U
from siftline.operators.filters import SuffixFilter, keep, parse_suffixes
from siftline.operators.lists import find_columns


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], "a string" if not isinstance(rows[0], tuple) else "a string, b string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*[c.alias(k) for k, c in columns.items()]).collect()]


def test_canonical(spark):
    got = values(spark, ["HTTP://www.Acme.nz//a/index.html?utm_source=x&b=2&a=1&e=#top", "https://acme.nz/", "https://acme.nz/a/;jsessionid=9?b=2&b=1", "mailto:x", None], x=U.canonical("a"))
    assert got == ["http://acme.nz/a?a=1&b=2", "https://acme.nz/", "https://acme.nz/a?b=2&b=1", None, None]
    assert values(spark, ["http://acme.nz/a/", "https://www.acme.nz/a"], x=U.page_key("a")) == ["acme.nz/a"] * 2


def test_page_key_is_stable(spark):
    urls = ["https://www.a.test//x//y/?b=1&a=2&utm_medium=q", "http://a.test/default.asp", "https://a.test/p;jsessionid=1/q?x=&y=1"]
    once = values(spark, urls, x=U.canonical("a"))
    assert values(spark, once, x=U.canonical("a")) == once


def test_normalize_input(spark):
    got = values(spark, [' "www.acme.nz" ', "acme.nz/team", "http://10.0.0.1/x", "ftp://acme.nz", "acme", "a..nz"], x=U.normalize_input("a"))
    assert got == ["https://www.acme.nz/", "https://acme.nz/team", "http://10.0.0.1/x", None, None, None]


def test_crawlable_and_priority(spark):
    urls = ["https://acme.nz/team", "https://acme.nz/a.pdf", "https://acme.nz/cart", "https://acme.nz/?a=1&b=2&c=3", "https://other.nz/", "https://acme.nz/1/2/3/4/5/6/7/8/9"]
    assert values(spark, urls, x=U.crawlable("a", F.lit("www.acme.nz"))) == [True, False, False, False, False, False]
    assert values(spark, ["https://a.nz/contact-us", "https://a.nz/our-people", "https://a.nz/blog/x", "https://a.nz/x?y=1"], x=U.priority("a", F.lit(1))) == [3, 8, 63, 27]


def test_section(spark):
    rows = [("https://a.nz/branch/x", "https://a.nz/branch/x/"), ("https://a.nz/", "https://a.nz/"), ("https://a.nz/", "https://b.nz/y")]
    assert values(spark, rows, x=U.section_prefix("a", "b")) == ["/branch/x", None, "/y"]
    assert values(spark, [("https://a.nz/b/c", "/b"), ("https://a.nz/bc", "/b")], x=U.in_section("a", "b")) == [True, False]


def test_clean_email(spark):
    raw = ["Info@Acme.NZ.", "logo@2x.png", "u003einfo@acme.nz", "a..b@acme.nz", "x@mail.example.com", "0123456789abcdef01234567@acme.nz", None]
    assert values(spark, raw, x=E.clean(F.col("a"))) == ["info@acme.nz", None, "info@acme.nz", None, None, None, None]
    assert values(spark, ["x@mail.example.com"], x=E.clean(F.col("a"), junk_domains=False)) == ["x@mail.example.com"]


def test_deobfuscate(spark):
    text = ["mail jo [at] acme (dot) co (dot) nz now", "jo at acme dot co dot nz", "look at this dot"]
    assert values(spark, text, x=E.deobfuscate(F.col("a"))) == ["mail jo@acme.co.nz now", "jo@acme.co.nz", "look at this dot"]


def test_find_in_bounds():
    assert E.find_in("write info@acme.nzPhone or a@b.test") == ["info@acme.nz", "a@b.test"]
    assert E.find_in("x" * 70 + "@acme.nz") == []
    assert E.protected("42282d0223212f276c2c38") == "jo@acme.nz"
    import time

    began = time.time()
    E.find_in("a" * 1_000_000)
    assert time.time() - began < 1.5


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_clean_in_is_idempotent(text):
    once = E.clean_in(text + "@acme.nz")
    assert once is None or E.clean_in(once) == once


def test_domains(spark):
    hosts = spark.createDataFrame([("mail.acme.co.nz",), ("a.b.ck",), ("www.ck",), ("x.y.unlisted",), ("co.nz",)], "host string")
    got = {r[0]: tuple(r)[1:] for r in D.dimension(hosts, D.rules(spark)).collect()}
    assert got["mail.acme.co.nz"] == ("co.nz", "acme.co.nz", True)
    assert got["a.b.ck"] == ("b.ck", "a.b.ck", True) and got["www.ck"] == ("ck", "www.ck", True)
    assert got["x.y.unlisted"] == ("unlisted", "y.unlisted", False) and got["co.nz"] == ("co.nz", None, True)


@pytest.mark.parametrize("text,want", [("Dr Jane Smith,", "Dr Jane Smith"), ("Jane Smith", "Jane Smith"), ("Jane", None), ("Contact Us", None), ("Jane 2 Smith", None), ("Dr Jane", "Dr Jane"), ("jane smith", None)])
def test_person_name(spark, text, want):
    assert N.person_name(text) == want
    assert values(spark, [text], x=N.person_name_column(F.col("a"))) == [want]


def test_local_names():
    w = N.Words()
    assert N.local_name("info", "acme.nz", w)[0] == "generic"
    assert N.local_name("accounts", "acme.nz", w) == ("role", "Accounts")
    assert N.local_name("jane.smith", "acme.nz", w) == ("person", "Jane Smith")
    assert N.local_name("debcopeland88", "acme.nz", w) == ("person", "Deb Copeland")
    assert N.local_name("northbranch", "acme.nz", w)[0] == "words"
    assert N.matches_email("Dr Jane Smith", "jsmith@acme.nz") and not N.matches_email("Jane Smith", "bob@acme.nz")


def test_words():
    w = N.Words()
    assert N.split_words("cityvets", w) == ["city", "vets"]
    assert N.split_words("cityzz", w) is None
    assert N.name_from_domain("www.cityvets.co.nz") == "City Vets" and N.name_from_domain("abc4x4.nz") == "ABC 4x4"
    assert [N.ordinal(n) for n in (1, 2, 3, 11, 21)] == ["1st", "2nd", "3rd", "11th", "21st"]
    assert N.business_name("Welcome to City Vets | Home") == "City Vets" and N.business_name("https://x") is None
    assert N.format_duration(3700) == "1 h 1 m 40 s"


def test_suffixes(spark):
    assert parse_suffixes(" .Nz, co.uk,") == ["nz", "co.uk"]
    with pytest.raises(ValueError):
        parse_suffixes("a b")
    f = SuffixFilter(("nz",), ("gov.nz",))
    assert values(spark, ["a@b.nz", "a@x.gov.nz", "a@b.com", "a@nz.", "a@b.xnz"], x=keep(F.col("a"), f)) == [True, False, False, True, False]


def test_find_columns():
    assert find_columns([["name", "website"], ["A", "a.nz"]]) == (1, 0, True)
    assert find_columns([["Business Name", "Web address"], ["A", "a.nz"]]) == (1, 0, True)
    assert find_columns([["A", "a.nz"], ["B", "b.nz"]]) == (1, None, False)


def test_small_columns(spark):
    assert values(spark, ["=1+1", "ok", "-x"], x=E.safe_cell(F.col("a"))) == ["'=1+1", "ok", "'-x"]
    assert values(spark, ["ENOTFOUND", "ETIMEDOUT", "HTTP 403", "500", "zzz"], x=U.fail_kind("a")) == ["dns", "timeout", "refused", "status", "other"]
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    assert values(spark, ["5", "0", "900", "x", "Thu, 01 Jan 2026 00:00:10 GMT"], x=U.retry_after_ms("a", now)) == [5000, 1000, 30000, 3000, 10000]
