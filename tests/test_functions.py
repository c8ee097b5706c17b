import hashlib
import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from signpost.functions import text as X
from signpost.functions import urls as U
from signpost.plans.guidance import agency_for_url


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).collect()[0].x


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", build(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_clean_text_matches_every_space_character(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    values = ["\t\tone  two\r\n\x0bthree", "four", "", " \n "] + [f"{s}a{s}{s}b{s}" for s in spaces] + ["a​b", "a﻿b"]
    assert column(spark, values, X.clean_text) == [re.sub(r"\s+", " ", v).strip() for v in values]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_casefold_matches_full_folding(spark):
    # Letters newer than the JVM's Unicode tables are left out.
    letters = [chr(i) for i in range(1, 0xA7C0) if not 0xD800 <= i <= 0xDFFF and i != 0x1C89]
    letters += [chr(i) for i in range(0xFB00, 0x10500)]
    got = column(spark, letters, X.casefold)
    assert {c: g for c, g in zip(letters, got) if g != c.casefold()} == {}
    words = ["STRASSE", "Straße", "ﬁnance", "ΣΊΣΥΦΟΣ", "Émigré", "İstanbul", "plain"]
    assert column(spark, words, X.casefold) == [w.casefold() for w in words]


def test_digest_counts_null_as_empty(spark):
    df = spark.createDataFrame([("a", None, "é"), ("", "b", "c")], "a string, b string, c string")
    got = [r.x for r in df.select(X.digest("a", "b", "c").alias("x")).collect()]
    want = [hashlib.sha256("\x1f".join(v).encode()).hexdigest() for v in (("a", "", "é"), ("", "b", "c"))]
    assert got == want
    assert [r.x for r in df.select(X.short_id("a", "b", "c").alias("x")).collect()] == [w[:20] for w in want]
    payload = bytes(range(256))
    got = spark.createDataFrame([(payload,)], "p binary").select(X.payload_hash("p").alias("x")).collect()[0].x
    assert got == hashlib.sha256(payload.hex().encode()).hexdigest()


BASES = ["https://www.example.ca/a/b/c.html?q=1#f", "https://example.ca", "http://Example.ca/a/", "https://u@h.ca:80/x"]
HREFS = ["", "#top", "?z=2", "/root/x/", "rel", "rel/y?a=b#c", "../up", "../../up/./z/", "..", ".", "./", "//other.org/p", "https://abs.org/q/#r",
         "mailto:a@b.c", "tel:+1", "javascript:void(0)", "/a/../b", "é/ü", "a b", "../../../../deep"]


@pytest.mark.parametrize("base", BASES)
def test_url_resolution_matches_the_standard_library(spark, base):
    got = column(spark, HREFS, lambda h: U.resolve_url(F.lit(base), h))
    assert dict(zip(HREFS, got)) == {h: urljoin(base, h) for h in HREFS}
    got = column(spark, HREFS, lambda h: U.canonical_url(F.lit(base), h))
    assert dict(zip(HREFS, got)) == {h: urljoin(base, h).split("#", 1)[0].rstrip("/") for h in HREFS}


def test_host_keeps_user_and_port(spark):
    urls = [*BASES, "mailto:a@b", "", "//x.org/p", "/path", "https://WWW.Quebec.ca/en", "https://www.www.a.ca?x"]
    assert column(spark, urls, U.url_host) == [urlparse(u).netloc.lower().removeprefix("www.") for u in urls]


def test_agency_lookup_defaults_to_host(spark):
    urls = ["https://www.quebec.ca/en", "https://www150.statcan.gc.ca/x", "https://elsewhere.org/y"]
    assert column(spark, urls, agency_for_url) == ["Gouvernement du Québec", "Statistics Canada", "elsewhere.org"]


def test_url_validity(spark):
    urls = ["https://a.ca", "http://a.ca/x?y", "", "ftp://a.ca", "a.ca", "https://", "https://a b.ca", None]
    assert column(spark, urls, U.is_http_url) == [True, True, False, False, False, False, False, False]


def test_small_string_rules(spark):
    assert column(spark, ["mailto:a", "a"], lambda v: X.remove_prefix(v, "mailto:")) == ["a", "a"]
    assert column(spark, ["a::", ":a"], lambda v: X.strip_trailing(v, ":")) == ["a", ":a"]
    assert column(spark, ["éa" * 400], lambda v: X.truncate(v, 600)) == [("éa" * 400)[:600]]
    assert column(spark, ["text/html; charset=x", "", None], X.media_type) == ["text/html", "", ""]
    assert column(spark, ["a", "", None], lambda v: X.or_else(v, F.lit("z"))) == ["a", "z", "z"]
    assert one(spark, X.non_html_summary(F.lit(""), F.lit(1234567))) == (
        "Downloaded non-HTML content with type unknown and 1,234,567 bytes.")
    assert one(spark, X.looks_like_html(F.lit("application/x"), F.lit("\n\t<p>"))) is True
    assert one(spark, X.looks_like_html(F.lit(None).cast("string"), F.lit("x"))) is False
    assert one(spark, X.join_or(F.array(F.lit("a"), F.lit("b")), F.lit("z"))) == "a | b"
    assert one(spark, X.join_or(F.lit(None).cast("array<string>"), F.lit("z"))) == "z"
    assert one(spark, X.iso_instant(F.to_timestamp(F.lit("2026-06-12 18:01:59.9")))) == "2026-06-12T18:01:59+00:00"
    assert one(spark, X.contains_any(F.lit("book now"), ["apply", "book"])) is True


def test_windows_1252_round_trip(spark):
    raw = bytes(b for b in range(0x20, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    assert one(spark, X.fix_windows_1252(F.lit(raw.decode("latin-1")))) == raw.decode("cp1252")


def test_let_binds_once(spark):
    seen = spark.range(1).select(X.let(F.rand(random.randint(1, 9)), lambda r: F.struct(r.alias("a"), r.alias("b"))).alias("x")).collect()[0].x
    assert seen.a == seen.b
