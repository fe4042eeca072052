"""Merges, verdicts, frontier and streams on small tables."""

import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.operators import crawl, merge, verify
from gleaner.pages import parse_pages
from gleaner.sources import tables
from gleaner.streaming import frontier

COMPANY = "domain string, name string, industry string, extra_metadata map<string,string>, seq long"


def test_company_upsert(spark):
    old = spark.createDataFrame([("a.com", "Old", "X", {"k": "1", "m": "1"})], "domain string, name string, industry string, extra_metadata map<string,string>")
    batch = spark.createDataFrame([("a.com", None, "Y", {"k": "2"}, 1), ("a.com", "New", None, None, 2), ("clutch.co", "C", None, None, 3)], COMPANY)
    kept, rejected = merge.upsert_companies(old, batch)
    row = kept.collect()[0]
    assert (row.name, row.industry, row.extra_metadata) == ("New", "Y", {"k": "2", "m": "1"})
    assert [r.domain for r in rejected.collect()] == ["clutch.co"]


def test_company_upsert_is_associative(spark):
    one = spark.createDataFrame([("a.com", "A", None, {"k": "1"}, 1)], COMPANY)
    two = spark.createDataFrame([("a.com", None, "I", {"k": "2"}, 2)], COMPANY)
    at_once, _ = merge.upsert_companies(None, one.unionByName(two))
    first, _ = merge.upsert_companies(None, one)
    in_turn, _ = merge.upsert_companies(first.drop("id"), two)
    assert at_once.collect() == in_turn.select(*at_once.columns).collect()


def test_lead_upsert(spark):
    schema = "work_email string, title string, company_id string, email_status string, phones array<struct<number:string,type:string>>, seq long"
    old = spark.createDataFrame([("x@a.com", "CEO", "1", "verified", [("+1 415 555 0101", "mobile")])], schema.rsplit(",", 1)[0])
    many = [(f"415 555 01{n:02d}", "office") for n in range(1, 9)]
    batch = spark.createDataFrame([("x@a.com", "", "2", None, [("4155550101", "office"), ("123", "office")], 1), ("y@a.com", None, "3", "invalid", many, 2)], schema)
    rows = {r.work_email: r for r in merge.upsert_leads(old, batch).collect()}
    assert (rows["x@a.com"].title, rows["x@a.com"].company_id, rows["x@a.com"].email_status) == ("CEO", "2", None)
    assert [p.number for p in rows["x@a.com"].phones] == ["+1 415 555 0101", "4155550101"]
    assert len(rows["y@a.com"].phones) == 5


def test_technologies_and_cascade(spark):
    old = spark.createDataFrame([("1", "React", "Framework")], "company_id string, tech_name string, category string")
    batch = spark.createDataFrame([("1", "React", "Other", 1), ("1", "Wix", None, 2)], "company_id string, tech_name string, category string, seq long")
    rows = merge.insert_technologies(old, batch)
    assert sorted(map(tuple, rows.collect())) == [("1", "React", "Framework"), ("1", "Wix", "Detected Stack")]
    companies = spark.createDataFrame([("1", "a.com"), ("2", "b.com")], "id string, domain string")
    kept, tech = merge.delete_companies(companies, companies.filter("id = '1'"), rows)
    assert kept.count() == 1 and tech.count() == 0
    assert merge.emptied(rows)[0].count() == 0


def test_verdicts(spark):
    emails = spark.createDataFrame([(e,) for e in ("real@a.com", "all@a.com", "no@a.com", "later@a.com", "down@a.com", "x@mailinator.com", "bad", "q@nomx.com", "skip@a.com", "real@a.com", "")], "email string")
    mx = spark.createDataFrame([("a.com", ["mx.a.com"], None), ("mailinator.com", ["m"], None), ("nomx.com", [], None)], "domain string, mx_records array<string>, lookup_error string")
    probe = spark.createDataFrame([("real@a.com", 1, 250, 550, None), ("all@a.com", 1, 250, 250, None), ("no@a.com", 1, 550, None, None), ("later@a.com", 1, 450, None, None), ("down@a.com", 1, None, None, "refused"), ("down@a.com", 2, None, None, "refused"), ("down@a.com", 3, 250, 550, None)], "email string, mx_rank int, rcpt_code int, catch_all_probe_code int, error string")
    cache = spark.createDataFrame([], "domain string, is_catch_all boolean")
    got = {r.email: r.status for r in verify.verify(emails, mx, probe, cache).collect()}
    assert got == {"real@a.com": "verified", "all@a.com": "catch_all", "no@a.com": "invalid", "later@a.com": "unverified", "down@a.com": "unverified", "x@mailinator.com": "disposable", "bad": "invalid", "q@nomx.com": "invalid", "skip@a.com": "unverified"}


def test_inferred_people_do_not_share_an_address(spark):
    persons = spark.createDataFrame([("p", 0, "Ann", "Lee", ["ann.lee@a.com", "al@a.com"]), ("p", 1, "Al", "Lee", ["al@a.com", "ann.lee@a.com"]), ("p", 2, "Al", "Lee", ["al@a.com"])], "page string, pos int, first_name string, last_name string, candidate_emails array<string>")
    verdicts = spark.createDataFrame([("ann.lee@a.com", "verified"), ("al@a.com", "catch_all")], "email string, status string")
    known = spark.createDataFrame([], "email string")
    assert sorted((r.pos, r.work_email) for r in verify.infer_people(persons, verdicts, known).collect()) == [(0, "ann.lee@a.com"), (1, "al@a.com")]


def test_crawl_two_hops(spark):
    pages = spark.createDataFrame([("https://goodfirms.co/software/x", '<a href="/company/acme">Acme</a>'), ("https://goodfirms.co/company/acme", '<h1>Acme</h1><a href="https://acme.com">Visit Website</a>'), ("https://acme.com/", '<a href="/about">About</a><a href="/blog">B</a>')], "url string, html string")
    parsed = parse_pages(pages)
    got = {(r.url, r.depth, r.round) for r in crawl.crawl(spark.createDataFrame([("https://goodfirms.co/software/x", 1)], "url string, depth int"), parsed, 5).collect()}
    assert got == {("https://goodfirms.co/software/x", 1, 0), ("https://goodfirms.co/company/acme", 0, 1), ("https://acme.com/", 1, 2), ("https://acme.com/about", 0, 3)}


def test_sources(spark, tmp_path):
    assert tables.json_config(tmp_path / "none.json") == {}
    (tmp_path / "t.json").write_text('{"A": ["x"], "B": {"category": "CMS", "patterns": ["y"]}}')
    assert tables.signatures(tables.json_config(tmp_path / "t.json")) == {"A": ("Detected Stack", ["x"]), "B": ("CMS", ["y"])}
    spark.conf.set("spark.gleaner.blocked", "a, b,")
    assert tables.setting_list(spark, "blocked", []) == ["a", "b"] and tables.setting_list(spark, "other", ["z"]) == ["z"]
    log = spark.createDataFrame([("u", datetime(2024, 1, 1))], "url string, scraped_at timestamp")
    tables.append_log(log, str(tmp_path / "log"))
    tables.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert tables.snapshot(log, str(tmp_path / "s")).count() == 1


def _finish(query):
    """Waits for rows in the sink; a stream with timeouts never runs out of batches."""
    end = time.time() + 60
    while time.time() < end and query.isActive and not (query.lastProgress and SparkSession.active().table(query.name).count()):
        time.sleep(0.3)
    query.stop()
    assert query.exception() is None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s", "https://A.com/x/", datetime(2024, 1, 1, 0, 0)), ("s", "https://a.com/x", datetime(2024, 1, 1, 1, 0)), ("t", "https://a.com/x", datetime(2024, 1, 1, 1, 0))], "session_id string, url string, found_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    _finish(frontier.claimed(stream).writeStream.format("memory").queryName("claimed").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert spark.table("claimed").count() == 2
    log = spark.createDataFrame([("https://a.com/x", 200, datetime(2023, 12, 30))], "url string, status_code int, scraped_at timestamp")
    _finish(frontier.due_stream(stream, log).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert [r.url for r in spark.table("due").collect()] == ["https://A.com/x/"]
    fetched = spark.createDataFrame([("a.com", "tier1", 200, datetime(2024, 1, 1)), ("a.com", "tier2", 200, datetime(2024, 1, 2)), ("a.com", "tier3", 403, datetime(2024, 1, 3))], "domain string, engine_used string, status_code int, scraped_at timestamp")
    fetched.write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(fetched.schema).parquet(str(tmp_path / "f"))
    _finish(frontier.preferred_engines(stream).writeStream.outputMode("update").format("memory").queryName("engines").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert [(r.domain, r.engine) for r in spark.table("engines").collect()] == [("a.com", "tier2")]
    _finish(frontier.host_rates(stream).writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c4")).start())
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 3
