import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.analyzer import query_terms, tokens


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_normal_form_ignores_case_and_white_space(spark):
    assert one(spark, tx.normalize, "  the DEFAULT role\nis\u00a0admin. ") == "the default role is admin."
    assert one(spark, tx.content_hash, "A  b") == one(spark, tx.content_hash, " a B ")
    assert one(spark, tx.content_hash, None) is None


def test_line_hashes_skip_short_and_repeated_lines(spark):
    text = "| role | permission |\n| --- | --- |\n| admin of the tenant | everything |\n| viewer of the tenant | reading |\n| admin of the tenant | everything |\n---"
    assert len(one(spark, tx.line_hashes, text)) == 3


@pytest.mark.parametrize("path,kind", [("/a/rbac.doc", "doc"), ("schema.SQL", "sql"), ("diagram.drawio.png", "png"), ("readme", "(no extension)"), ("jira://AB-1", "jira"), ("confluence://12", "confluence")])
def test_kind(spark, path, kind):
    assert one(spark, tx.kind, path) == kind


@pytest.mark.parametrize("title,slug", [("Feature analysis: MSP tenant switching", "feature-analysis-msp-tenant-switching"), ("!!!", ""), ("--A--", "a")])
def test_slug(spark, title, slug):
    assert one(spark, tx.slug, title) == slug


def test_reply_prefix_and_mentions(spark):
    assert one(spark, tx.without_reply_prefix, "Re: FW: AW[2]: Bundle pricing") == "Bundle pricing"
    assert one(spark, tx.mentions, "see AEXP-19, aexp-19 and B2-7") == ["AEXP-19", "B2-7"]
    assert one(spark, tx.key_project, "AEXP-19") == "AEXP"
    assert one(spark, tx.key_project, "nothing") is None


def test_paths_and_ids(spark):
    assert one(spark, tx.normalize_path, "C:\\Docs\\A.md") == "c:/docs/a.md"
    assert one(spark, tx.normalize_path, "jira://AB-1") == "jira://AB-1"
    ids = spark.createDataFrame([("p", 1, "q", 2), ("q", 2, "p", 1)], "a string, i int, b string, j int").select(tx.pair_id("a", "i", "b", "j").alias("r")).collect()
    assert ids[0].r == ids[1].r and len(ids[0].r) == 16


def test_excerpt_and_cells(spark):
    assert one(spark, tx.excerpt, "x" * 240) == "x" * 240
    assert one(spark, tx.excerpt, "a\nb" + "x" * 300).startswith("a b") and len(one(spark, tx.excerpt, "x" * 300)) == 241
    assert one(spark, lambda c: tx.escape_cell(c, backslash=True), "a|b\\c\r\nd") == "a\\|b\\\\c d"
    assert one(spark, tx.escape_headings, "# x\ny") == "\\# x\ny"


@pytest.mark.parametrize(
    "value,want",
    [("2026-07-15T12:33:20.256+0400", dt.datetime(2026, 7, 15, 8, 33, 20, 256000)), ("2026-07-15T12:33:20Z", dt.datetime(2026, 7, 15, 12, 33, 20)), ("garbage", None), (None, None)],
)
def test_api_timestamp(spark, value, want):
    assert one(spark, lambda c: tx.api_timestamp(c).cast("string"), value) == (None if want is None else want.isoformat(sep=" ").rstrip("0") if want.microsecond else want.isoformat(sep=" "))


@pytest.mark.parametrize("value,want", [("D:20260702134500+02'00'", "2026-07-02 11:45:00"), ("D:20260702", "2026-07-02 00:00:00"), ("D:2026", None), ("x", None)])
def test_pdf_timestamp(spark, value, want):
    assert one(spark, lambda c: tx.pdf_timestamp(c).cast("string"), value) == want


def test_natural_key_orders_numbers(spark):
    d = spark.createDataFrame([("Item 10",), ("item 9",), ("Item 09a",)], "v string")
    assert [r.v for r in d.orderBy(tx.natural_key("v")).collect()] == ["item 9", "Item 09a", "Item 10"]


@pytest.mark.parametrize("word,want", [("getUserAccessKeys", {"getuseraccesskeys", "get", "user", "access", "keys"}), ("/Bundle", {"/bundle", "bundle"}), ("v2api", {"v2api", "v", "2", "api"}), ("plain", {"plain"})])
def test_analyzer(spark, word, want):
    assert set(one(spark, tokens, word)) == want == set(query_terms(word))


def test_analyzer_of_nothing(spark):
    assert one(spark, tokens, None) == [] and one(spark, tokens, "  ") == []


def test_identifiers(spark):
    assert one(spark, tx.identifier, '"public".[Users]') == "public.Users"
    assert one(spark, tx.table_key, "public.Accounts") == "accounts"
    assert one(spark, tx.site_url, "Example.org/wiki/x") == "https://example.org"
    assert one(spark, tx.page_ids, "a /pages/12/x /pages/12 /pages/7") == ["12", "7"]


def test_breadcrumb_roundtrip(spark):
    d = spark.createDataFrame([("A > B", "text"), ("A", ""), ("", "only")], "h string, t string")
    got = d.select(tx.strip_breadcrumb(tx.with_breadcrumb("h", "t"), "h").alias("t"), F.col("t").alias("want")).collect()
    assert all(r.t == r.want for r in got)


def test_honest_titles(spark):
    rows = [(" Field guide ", "Field guide"), ("v1.4 of the guide", "v1.4 of the guide"), ("page.htm", None), ("scan_7.pdf", None), ("d:\\out\\x", None), ("a/b", None), ("GGuuiiddee ttoo", None), ("Committee wood", "Committee wood"), ("  ", None), (None, None), ("x.toolong", "x.toolong")]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string")
    assert [r.t for r in d.select("i", tx.honest_title("t").alias("t")).orderBy("i").collect()] == [b for _, b in rows]
