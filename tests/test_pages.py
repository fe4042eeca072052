"""Page extraction: the sample pages, and small cases of single rules."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from gleaner import expected, samples
from gleaner.functions import emails as E
from gleaner.functions import people as P
from gleaner.functions import urls as U
from gleaner.pages import Page, parse_page

RECORDS = [parse_page(html, url) for url, html in samples.PAGES]


def test_companies():
    fields = ["domain", "name", "website_url", "industry", "company_size", "hq_phone", "linkedin_url", "twitter_url"]
    assert [(r["url"], r["page_type"], r["soft_404"], r["target_website"], *((r["company"] or {}).get(f) for f in fields)) for r in RECORDS] == expected.COMPANIES


def test_leads():
    fields = ["work_email", "first_name", "last_name", "title", "seniority", "department"]
    got = [(r["url"], *(x[f] for f in fields), ", ".join(f"{p['number']} {p['type']}" for p in x["phones"]), x["linkedin_url"]) for r in RECORDS for x in r["leads"]]
    assert got == expected.LEADS


def test_persons_and_links():
    fields = ["first_name", "last_name", "title", "seniority", "department", "linkedin_url"]
    assert [(r["url"], n, *(x[f] for f in fields), ", ".join(x["candidate_emails"])) for r in RECORDS for n, x in enumerate(r["persons"])] == expected.PERSONS
    assert [(r["url"], kind, n, u) for r in RECORDS for kind in ("profile", "pagination", "internal") for n, u in enumerate(r[f"{kind}_links"])] == expected.LINKS


def test_a_mention_belongs_to_the_closest_card_of_its_own():
    page = Page("<section>lead: ops@brine.example.com <ul><li>yard@brine.example.com<p>dock@brine.example.com</p></li><li>gate@brine.example.com, crew@brine.example.com</li></ul></section>", "https://brine.example.com")
    cards = {email: (card.tag, len(page.emails_of(card))) for email, card in page.contacts().items()}
    # The first stands in no card with up to three e-mails, so it gets what is around its element.
    assert cards == {"ops@brine.example.com": ("", 5), "yard@brine.example.com": ("li", 2), "dock@brine.example.com": ("p", 1), "gate@brine.example.com": ("li", 2), "crew@brine.example.com": ("li", 2)}


def test_of_two_mentions_the_one_in_the_smaller_card_counts():
    page = Page("<article>A long story about our yard, told at length. yard@brine.example.com</article><p><a href='mailto:yard@brine.example.com'>yard</a></p>", "https://brine.example.com")
    assert [(e, card.tag) for e, card in page.contacts().items()] == [("yard@brine.example.com", "p")]


def test_technologies_need_structure():
    page = Page("<p>built with webflow.com and django</p><a href='https://js.stripe.com'>x</a><div class='sqs-block'></div><script>window.Intercom('boot', {intercomSettings: 1})</script>", "https://a.example")
    assert page.technologies() == {"Squarespace": "CMS", "Intercom": "Support"}


def test_labelled_values():
    assert Page("<dl><dt>Team size</dt><dd>11 to 50</dd></dl>", "https://a.example").labelled(["team size"]) == "11 to 50"
    assert Page("<p>Industry: Shipbuilding</p>", "https://a.example").labelled(["industry"]) == "Industry: Shipbuilding"
    assert Page("<p>Nothing here</p>", "https://a.example").labelled(["industry"]) is None


def test_names():
    assert [P.smart_case(x) for x in ("JEAN MCGEE", "ada quill", "Ian McKay", "van Dyk", "")] == ["Jean McGee", "Ada Quill", "Ian McKay", "van Dyk", ""]
    assert [P.split_name(x) for x in (None, "  ", "Ada", "Ada  van  Quill")] == [(None, None), (None, None), ("Ada", None), ("Ada", "van Quill")]
    assert P.person_name("Prof. Ada Quill") == ("Ada", "Quill") and P.person_name("Our Fleet") is None and P.person_name("Ada Quill CEO") is None
    assert [E.name_from_email(f"{x}@a.example") for x in ("ada.quill", "ADA_van-quill9", "sales", "oscar", "zzyx", "adamason", "ada+x", "a1.b2", "kimmarlow")] == [("Ada", "Quill"), ("Ada", "Van Quill"), (None, None), ("Oscar", None), (None, None), (None, None), (None, None), (None, None), ("Kim", "Marlow")]


def test_scalars():
    assert U.canonical_url("HTTP://Www.Brine.example:80/Yard/?b=2&gclid=7&a=1#dock") == "http://brine.example/Yard?b=2&a=1"
    assert [U.page_type(u) for u in ("https://upcity.com/firm/brine", "https://upcity.com/search", "https://brine.example/firm/x")] == [U.PROFILE, U.LISTING, U.SITE]
    assert [P.company_size(x) for x in ("staff: 12", "serving 40 ports", "1200 employees", "200+", "9-3 people", "20 to 30")] == ["12", None, "1200", "200+", None, "20-30"]
    assert E.clean_email("<Dock@Brine.example.com>,") == "dock@brine.example.com" and E.clean_email("x@co.uk") is None and E.clean_email("ops@brine.com.call") == "ops@brine.com"
    assert E.decode_protected(samples.protected("ops@brine.example")) == "ops@brine.example" and E.decode_protected("zz") is None and E.decode_protected("") is None
    assert P.phones_in("1111111111, 5125550100 or +47 55 20 30 40, order 00470011223344") == ["5125550100", "+47 55 20 30 40"]
    assert U.registered_domain("x.dock.brine.co.uk") == "brine.co.uk" and U.registered_domain("co.uk") == ""
    for u in ("https://A.example/x/?b=1&utm_x=2", "http://www.x.example:80/?q=a b", "x.example"):
        assert U.canonical_url(U.canonical_url(u)) == U.canonical_url(u)


def test_links_resolve_as_in_browsers(spark):
    bases = ["https://a.example/x/y.html?q=1", "http://a.example", "https://a.example/x/"]
    hrefs = ["team.html", "../up", "../../z/./w?k=1#f", "/root/../a", "//b.example/c", "https://c.example/", "?p=2", "./", "..", "mailto:a@b.example", "d/e/../f"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", U.resolved(F.col("b"), F.col("h")).alias("u")).collect()
    for r in rows:
        want = urljoin(r.b, r.h)
        assert r.u == want or (r.b == "http://a.example" and U.canonical_url(r.u) == U.canonical_url(want)), (r.b, r.h, r.u, want)
