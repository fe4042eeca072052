"""Sinks, settings, observations with a time to live, and the printed report."""

from datetime import datetime

from pyspark.sql import functions as F

from gleaner.operators import crawl, verify
from gleaner.plans import report
from gleaner.sources import tables
from gleaner.streaming import frontier


def at(text):
    return datetime.fromisoformat(text)


def test_current_mx(spark):
    rows = [
        ("A.example ", ["mx1.a.example.", "mx2.a.example"], None, "2024-03-01 10:00:00"), ("a.example", ["old"], None, "2024-03-01 09:00:00"), ("a.example", None, "timeout", "2024-03-01 11:00:00"),
        ("b.example", [], None, "2024-03-01 10:00:00"), ("c.example", ["mx"], None, "2024-02-28 10:00:00"), ("d.example", None, "timeout", "2024-03-01 10:00:00"),
    ]
    seen = spark.createDataFrame([(d, m, e, at(t)) for d, m, e, t in rows], "domain string, mx_records array<string>, lookup_error string, observed_at timestamp")
    got = {r.domain: r.mx_records for r in verify.current_mx(seen, F.lit("2024-03-01 12:00:00").cast("timestamp")).collect()}
    assert got == {"a.example": ["mx1.a.example", "mx2.a.example"], "b.example": []}


def test_resting_domains(spark):
    rows = [("x@a.example", 1, "refused", "11:30"), ("x@a.example", 2, "timeout", "11:31"), ("x@b.example", 1, "refused", "11:30"), ("x@b.example", 2, None, "11:31"), ("x@c.example", 1, "refused", "10:30")]
    probes = spark.createDataFrame([(e, n, err, at(f"2024-03-01 {t}:00")) for e, n, err, t in rows], "email string, mx_rank int, error string, observed_at timestamp")
    assert [r.domain for r in verify.resting(probes, F.lit("2024-03-01 12:00:00").cast("timestamp")).collect()] == ["a.example"]


def test_printed_report(spark):
    rows = [("own_domain_pct", 81.5, "PASS"), ("free_mail_pct", None, "N/A")]
    metrics = spark.createDataFrame(rows, "metric string, value double, verdict string")
    text, code = report.formatted(metrics)
    assert code == 0 and text.splitlines()[0].split() == ["own_domain_pct", "81.50", "PASS"] and text.endswith("PASS")
    assert report.formatted(metrics.union(spark.createDataFrame([("x", 1.0, "FAIL")], metrics.schema)))[1] == 1


def test_settings_and_lookups(spark, tmp_path):
    spark.conf.set("spark.gleaner.directory_domains", "a.example, b.example,")
    spark.conf.set("spark.gleaner.cooldown_days", "3")
    try:
        s = tables.Settings.of(spark)
    finally:
        spark.conf.unset("spark.gleaner.directory_domains")
        spark.conf.unset("spark.gleaner.cooldown_days")
    assert (s.directory_domains, s.cooldown_days, s.rate_seconds) == (("a.example", "b.example"), 3, 3.0) and tables.Settings.of(spark).cooldown_days == 7
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert [r.v for r in tables.find_one(rows, k=1).collect()] == ["a"] and tables.find_one(rows, k=9).count() == 0
    pages = spark.createDataFrame([("https://a.example/x y", "<p>", at("2024-03-01 10:00:00")), ("https://a.example/", None, at("2024-03-01 10:00:00"))], "url string, html string, fetched_at timestamp")
    tables.dump_pages(pages, str(tmp_path / "dump"))
    got = spark.read.parquet(str(tmp_path / "dump")).collect()
    assert len(got) == 1 and got[0].file.startswith("a_example_x_y_") and got[0].html == "<p>" and str(got[0].day) == "2024-03-01"


def test_last_success_is_kept(spark):
    log = spark.createDataFrame([("u", 200, at("2024-03-01 10:00:00")), ("u", 500, at("2024-03-02 10:00:00")), ("v", 200, at("2024-02-01 10:00:00"))], "url string, status_code int, scraped_at timestamp")
    more = spark.createDataFrame([("v", 200, at("2024-03-03 10:00:00"))], log.schema)
    assert {r.url: str(r.last_ok) for r in frontier.last_success(more, frontier.last_success(log)).collect()} == {"u": "2024-03-01 10:00:00", "v": "2024-03-03 10:00:00"}


def test_depth_rules_and_rates(spark):
    rows = spark.createDataFrame([("a.example", 0, True), ("http://b.example", 0, False), ("c.example", 2, True)], "u string, d int, r boolean")
    assert [tuple(x) for x in rows.select(crawl.with_scheme(F.col("u")), crawl.start_depth(F.col("d"), F.col("r"))).collect()] == [("https://a.example", 1), ("http://b.example", 0), ("https://c.example", 2)]
    log = spark.createDataFrame([(str(i), f"u{i}", "d", at(t)) for i, t in enumerate(["2024-03-01 10:59:59", "2024-03-01 11:00:01", "2024-03-01 11:30:00", "2024-03-01 13:00:00", "2024-03-01 13:00:02"])], "id string, url string, domain string, scraped_at timestamp")
    assert {r.id: r.gap for r in crawl.rate_violations(log, 3.0).collect()} == {"1": 2.0, "4": 2.0}


def test_relations_of_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(i, f"d{i}.example") for i in range(20)], "id int, domain string")
    tables.replace_relation(rows, url, "companies", driver=driver)
    tables.replace_relation(rows.filter("id < 15"), url, "companies", driver=driver)
    got = tables.relation(spark, url, "companies", key="id", bounds=(0, 15), partitions=3, driver=driver)
    assert got.rdd.getNumPartitions() == 3 and sorted(r.DOMAIN if hasattr(r, "DOMAIN") else r.domain for r in got.collect()) == sorted(f"d{i}.example" for i in range(15))
    assert "PushedFilters: [" in (plan := got.filter("id > 12")._jdf.queryExecution().executedPlan().toString()) and "GreaterThan" in plan
    tables.replace_relation(rows, str(tmp_path), "companies")
    assert tables.relation(spark, str(tmp_path), "companies").count() == 20


def test_phones_found_by_form():
    """What the rules find of each kind of number; figures are in the README."""
    from gleaner.functions import people as P

    forms = {
        "international": ["+44 20 7946 0018", "+49 30 9018 2000", "+47 55 20 30 40", "+420 601 123 456", "+33 1 42 68 53 00", "+91 98765 43210", "+61 2 9374 4000", "+351 21 123 4567"],
        "north american": ["(212) 555-0142", "212-555-0142", "212.555.0142", "+1 212 555 0142", "1 212 555 0142", "2125550142"],
        "national": ["020 7946 0018", "030 9018 2000", "01 42 68 53 00", "098765 43210", "601 123 456", "(02) 9374 4000"],
    }
    found = {kind: sum(P.phones_in(f"Call {n} today") != [] for n in numbers) for kind, numbers in forms.items()}
    assert found == {"international": 8, "north american": 6, "national": 0}
