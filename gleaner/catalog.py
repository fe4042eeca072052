"""The registered queries and their equivalents in DuckDB's SQL.

The shipped tables stand in for the engine's relations.  The stand-ins are written in the SQL that
both engines read, so a query and its equivalent start from the same rows; everything after that is
DataFrame code on one side and SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner import expected, samples
from gleaner.checkpoints import cut_lineage
from gleaner.functions import emails as E
from gleaner.functions import people as P
from gleaner.functions import urls as U
from gleaner.functions import web as H
from gleaner.operators import crawl, merge, task, verify
from gleaner.pages import parse_pages
from gleaner.plans import report
from gleaner.sources.tables import as_json_lines, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOGS = """SELECT CAST(event_id AS STRING) AS id, 'https://h' || CAST(user_id % 50 AS STRING) || '.example.com/p' || CAST(user_id AS STRING) AS url, 'h' || CAST(user_id % 50 AS STRING) || '.example.com' AS domain,
 CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 90 THEN 200 WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 95 THEN 403 WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 98 THEN 404 END AS status_code,
 event_type AS engine_used, ts AS scraped_at FROM {events}"""
COMPANIES = """SELECT CAST(n_nationkey AS STRING) AS id, CASE WHEN n_nationkey = 3 THEN 'clutch.co' ELSE lower(replace(n_name, '_', '-')) || '.com' END AS domain, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'Software' END AS industry FROM {nation}"""
LEADS = """SELECT CAST(c_custkey AS STRING) AS id, CAST(c_nationkey AS STRING) AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'Ann' WHEN c_custkey % 3 = 1 THEN 'Bob' END AS first_name, CASE WHEN c_custkey % 4 > 0 THEN 'Lee' END AS last_name,
 CASE WHEN c_custkey % 5 = 0 THEN 'VP of Sales' WHEN c_custkey % 5 = 1 THEN 'Chief Executive Officer' WHEN c_custkey % 5 = 2 THEN 'Data Engineer' WHEN c_custkey % 5 = 3 THEN 'Managing Director' END AS title,
 CASE WHEN c_custkey % 13 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '@gmail.com' WHEN c_custkey % 17 = 0 THEN 'bad address ' || CAST(c_custkey AS STRING) WHEN c_custkey % 7 = 0 THEN 'c' || CAST(c_custkey AS STRING) || '@nation-' || CAST(c_custkey % 25 AS STRING) || '.com' ELSE 'c' || CAST(c_custkey AS STRING) || '@nation-' || CAST(c_nationkey AS STRING) || '.com' END AS work_email,
 lower(c_mktsegment) AS email_status, c_custkey % 2 = 0 AS email_verified, c_custkey % 3 > 0 AS mx_valid, CAST(c_custkey % 3 AS INT) AS n_phones, CASE WHEN c_custkey % 4 < 3 THEN 'https://www.linkedin.com/in/c' || CAST(c_custkey % 40 AS STRING) END AS linkedin_url FROM {customer}"""
_NAMES = {n: n for n in ("events", "nation", "customer")}
WITH = f"WITH logs AS ({LOGS.format(**_NAMES)}), companies AS ({COMPANIES.format(**_NAMES)}), leads AS ({LEADS.format(**_NAMES)}) "


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(LOGS, events=read(spark, d, "events"))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(COMPANIES, nation=read(spark, d, "nation"))


def _leads(spark: SparkSession, d: str) -> DataFrame:
    phone = F.struct(F.concat(F.lit("+1 415 555 "), F.lpad(F.col("id"), 4, "0")).alias("number"), F.lit("office").alias("type"))
    rows = spark.sql(LEADS, customer=read(spark, d, "customer"))
    return rows.withColumn("phones", F.array_repeat(phone, F.col("n_phones"))).drop("n_phones")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages")


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(samples.PAGES, "url string, html string")


def _values(columns: str, rows: list[tuple]) -> str:
    """Rows as SQL."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# ---------------------------------------------------------------- URLs

_HOST = r"regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\.', '')"
_PATH = r"regexp_extract(regexp_replace({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '^([^?#]*)', 1)"
HOST, PATH = _HOST.format(u="url"), _PATH.format(u="url")
_KEPT = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(?:" + "|".join(K.IGNORED_PARAMS) + ")'))"
_QUERY = f"CASE WHEN regexp_matches(lower({PATH}), '{'|'.join(U.PROFILE_PATHS)}') THEN '' ELSE array_to_string(list_transform({_KEPT}, lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END), '&') END"
CANONICAL = f"CASE WHEN {HOST} = '' THEN '' ELSE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {HOST} || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END || CASE WHEN ({_QUERY}) = '' THEN '' ELSE '?' || ({_QUERY}) END END"


@query(f"SELECT page_id, {HOST} AS domain FROM pages")
def f1_domain(spark, d):
    return _pages(spark, d).select("page_id", U.domain(F.col("url")).alias("domain"))


@query(f"SELECT DISTINCT {HOST} AS host, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS registered FROM pages")  # all suffixes here have one label
def f2_registered_domain(spark, d):
    hosts = _pages(spark, d).select(U.domain(F.col("url")).alias("host")).distinct()
    return hosts.select("host", U.registered_domain_udf(F.col("host")).alias("registered"))


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def f3_canonical(spark, d):
    return _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def f3_canonical_exact(spark, d):
    return _pages(spark, d).select("page_id", U.canonical_url_udf(F.col("url")).alias("canonical"))


_DIRECTORY = {"example.org": {"profile_paths": ["/es/"]}}


@query(f"SELECT page_id, CASE WHEN {HOST} = 'example.org' OR {HOST} LIKE '%.example.org' THEN CASE WHEN contains(lower({PATH}), '/es/') THEN 'directory_profile' ELSE 'directory_listing' END ELSE 'company_site' END AS page_type FROM pages")
def f4_classify(spark, d):
    return _pages(spark, d).select("page_id", U.classify(F.col("url"), _DIRECTORY).alias("page_type"))


def _without_dots(p: str) -> str:
    fold = f"list_reduce(string_split(substr({p}, 2), '/'), lambda made, x: CASE WHEN x = '.' THEN made WHEN x = '..' THEN regexp_replace(made, '/[^/]*$', '') ELSE made || '/' || x END, '')"
    return f"CASE WHEN contains({p}, '/.') THEN coalesce(nullif({fold} || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END, ''), '/') ELSE {p} END"


def _resolved(base: str, href: str) -> str:
    origin, plain, path = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)", f"regexp_extract({href}, '^([^?#]*)', 1)", _PATH.format(u=base)
    joined = f"(coalesce(nullif(regexp_extract({path}, '^(.*/)', 1), ''), '/') || {plain})"
    tail = f"substr({href}, length({plain}) + 1)"
    return (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} LIKE '//%' THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {href}"
        f" WHEN {href} LIKE '/%' THEN {origin} || {_without_dots(plain)} || {tail} WHEN {plain} = '' THEN {origin} || {path} || {href} ELSE {origin} || {_without_dots(joined)} || {tail} END"
    )


HREFS = """regexp_extract_all(html, '<a\\s[^>]*?href=["\'\']([^"\'\']*)["\'\']', 1)"""


@query(f"SELECT page_id, {_resolved('url', 'href')} AS link FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages)")
def f5_resolve(spark, d):
    return _pages(spark, d).select("page_id", "url", F.explode(U.hrefs(F.col("html"))).alias("href")).select("page_id", U.resolved(F.col("url"), F.col("href")).alias("link"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '[?&]ref=') THEN 'https://www.example.org/' ELSE 'https://clutch.co/r?a=1' END AS target FROM pages")
def f6_unwrap_redirect(spark, d):
    u = F.when(F.col("url").rlike("[?&]ref="), "https://clutch.co/r?a=1&url=https%3A%2F%2Fwww.example.org%2F").otherwise("https://clutch.co/r?a=1")
    return _pages(spark, d).select("page_id", U.redirect_target(u).alias("target"))


@query(f"SELECT page_id, {HOST} <> '' AND {HOST} <> 'example.org' AND NOT ends_with({HOST}, '.example.org') AS is_external, regexp_matches({HOST}, '(^|\\.)({'|'.join(x.replace('.', chr(92) + '.') for x in K.SOCIAL_DOMAINS)})$') AS is_social, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || '/' AS root FROM pages")
def f7_f8_f9_link_tests(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.external(u, F.lit("example.org")).alias("is_external"), U.social(u).alias("is_social"), U.root(u).alias("root"))


_BLOCKED = f"(regexp_matches({PATH}, '(?i)/(?:{'|'.join(p.replace('.', chr(92) + '.').replace('-', '-') for p in K.BLOCKED_PATHS)})') OR lower(regexp_extract({PATH}, '(\\.[^./]*)$', 1)) IN {_in(K.BLOCKED_EXTENSIONS)})"


@query(f"SELECT page_id, {_BLOCKED} AS blocked FROM pages")
def f10_f11_blocked(spark, d):
    return _pages(spark, d).select("page_id", U.blocked(U.path(F.col("url"))).alias("blocked"))


# ---------------------------------------------------------------- pages


def internal_links(pages: DataFrame, most: int = 10) -> DataFrame:
    """H5, H6, H9 without a DOM: (page_id, link, n) with the best links of each page within its host first."""
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(U.hrefs(F.col("html")))).alias("href"))
    rows = rows.filter(U.followable(F.col("href"))).select("page_id", "url", U.resolved(F.col("url"), F.col("href")).alias("full"))
    place = U.path(F.col("full"))
    rows = rows.filter((U.domain(F.col("full")) == U.domain(F.col("url"))) & ~place.isin("", "/") & ~U.blocked(place))
    rows = rows.select("page_id", U.canonical(F.col("full")).alias("link")).distinct()
    plain = ~F.lower("link").rlike("|".join(K.PRIORITY_KEYWORDS))
    ranked = rows.withColumn("plain", plain).withColumn("n", F.expr("row_number() over (partition by page_id order by plain, link)"))
    return ranked.filter(F.col("n") <= most).select("page_id", "link", F.col("n").cast("int").alias("n"))


_LINKS = f"""WITH h AS (SELECT page_id, url AS page, unnest(list_distinct(list_filter({HREFS}, lambda h: h <> '' AND NOT regexp_matches(h, '^(#|javascript:|mailto:|tel:)')))) AS href FROM pages),
a AS (SELECT page_id, page, {_resolved('page', 'href')} AS url FROM h),
l AS (SELECT DISTINCT page_id, {CANONICAL} AS link FROM a WHERE {HOST} = {_HOST.format(u='page')} AND {PATH} NOT IN ('', '/') AND NOT {_BLOCKED}),
r AS (SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY regexp_matches(lower(link), '{'|'.join(K.PRIORITY_KEYWORDS)}') DESC, link) AS INT) AS n FROM l) """


@query(_LINKS + "SELECT * FROM r WHERE n <= 10")
def h9_internal_links(spark, d):
    return internal_links(_pages(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pages, distinct canonical pages and links of every host, and how often a page was fetched."""
    pages = _pages(spark, d)
    links = internal_links(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    rows = pages.select("page_id", U.domain(F.col("url")).alias("domain"), U.canonical(F.col("url")).alias("canonical")).join(links, "page_id", "left")
    out = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("canonical").alias("urls"), F.coalesce(F.sum("links"), F.lit(0).cast("long")).alias("links"))
    return out.withColumn("recrawl_ratio", F.round(F.col("pages") / F.col("urls"), 6))


@query(_LINKS + f", k AS (SELECT page_id, count(*) AS links FROM r WHERE n <= 10 GROUP BY page_id), p AS (SELECT page_id, {HOST} AS domain, {CANONICAL} AS canonical FROM pages) SELECT domain, count(*) AS pages, count(DISTINCT canonical) AS urls, CAST(coalesce(sum(links), 0) AS BIGINT) AS links, round(count(*) / count(DISTINCT canonical), 6) AS recrawl_ratio FROM p LEFT JOIN k USING (page_id) GROUP BY domain")
def flagship_hosts(spark, d):
    return flagship(spark, d)


_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(f"SELECT page_id, {_TITLE} AS title, coalesce(regexp_matches({_TITLE}, '(?i)\\b404\\b|page not found'), false) AS strong FROM pages")
def h16_titles(spark, d):
    t = H.title(F.col("html"))
    return _pages(spark, d).select("page_id", t.alias("title"), t.rlike(K.SOFT_404_STRONG).alias("strong"))


_TEXT = "html"
for _tag in ("script", "style", "template", "noscript"):
    _TEXT = f"regexp_replace({_TEXT}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_TEXT = f"trim(regexp_replace(regexp_replace({_TEXT}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_PHRASES = " OR ".join("contains(lower(body), '" + p.replace("'", "''") + "')" for p in K.SOFT_404_PHRASES)
_WEAK, _STRONG = (p.replace("'", "''") for p in (K.SOFT_404_WEAK, K.SOFT_404_STRONG))


@query(
    f"""SELECT page_id, coalesce(html, '') <> '' AND (regexp_matches(title, '{_STRONG}') OR (regexp_matches(html, 'id=["'']?__NEXT_DATA__') AND regexp_matches(html, '"page"\\s*:\\s*"/404')) OR regexp_matches(html, 'id=["'']?__next_error__')
 OR (length(body) < {K.THIN_PAGE} AND (regexp_matches(title, '{_WEAK}') OR {_PHRASES}))) AS soft_404 FROM (SELECT page_id, html, {_TITLE} AS title, {_TEXT} AS body FROM pages)"""
)
def h16_soft_404(spark, d):
    return _pages(spark, d).select("page_id", H.soft_404(H.title(F.col("html")), H.visible_text(F.col("html")), F.col("html")).alias("soft_404"))


_SIGNS = " OR ".join(f"contains(html, '{s}')" for s in K.BLOCK_SIGNATURES)
_WARY = " OR ".join(f"contains(lower({_TITLE}), '{w}')" for w in K.BLOCK_TITLES)


@query(f"SELECT page_id, page_id % 10 = 3 OR {_SIGNS} OR (({_WARY}) AND len(regexp_extract_all(html, '(?i)<a[\\s>]')) < 3) AS tier1, (contains(html, 'Just a moment...') AND contains(html, 'Cloudflare')) OR contains(html, 'Attention Required! | Cloudflare') OR contains(html, 'cf-browser-verification') OR (contains(html, '403 Forbidden') AND contains(lower(html), 'cloudflare')) AS tier2 FROM pages")
def h17_h18_blocked(spark, d):
    status = F.when(F.col("page_id") % 10 == 3, 403).otherwise(200)
    return _pages(spark, d).select("page_id", H.blocked_http(status, F.col("html")).alias("tier1"), H.blocked_browser(F.col("html")).alias("tier2"))


@query()
def x1_parse_pages(spark, d):
    return parse_pages(_pages(spark, d)).select("url", "page_type", "company.domain", "company.name", "company.website_url", F.size("leads").alias("leads"), F.size("persons").alias("persons"), F.size("internal_links").alias("links"), "soft_404")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || '_' || CASE WHEN trim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN 'index' ELSE substr(trim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), 1, 30) END, '[^A-Za-z0-9_-]', '_', 'g') || '_' || substr(md5(url), 1, 6) || '.html' AS file, substr(sha256(url), 1, 16) AS child_key FROM pages")
def s8_s12_names(spark, d):
    return _pages(spark, d).select("page_id", H.dump_name(F.col("url")).alias("file"), H.child_key(F.col("url")).alias("child_key"))


@query("SELECT 'region' AS relation, '{\"r_regionkey\":\"' || r_regionkey || '\",\"r_name\":\"' || r_name || '\"}' AS row FROM region")
def s13_json_lines(spark, d):
    return as_json_lines(read(spark, d, "region").select("r_regionkey", "r_name"), "region")


@query("WITH f AS (SELECT url, status_code, engine_used, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS tier, id FROM (SELECT url, status_code, engine_used, CAST(id AS BIGINT) AS id FROM (" + LOGS.format(**_NAMES) + ") t) t), u AS (SELECT url, tier, min(id) AS id FROM f GROUP BY url, tier), g AS (SELECT f.* FROM f JOIN u USING (url, tier, id)) SELECT url, tier, status_code FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN tier = 1 AND status_code = 200 THEN 0 WHEN tier = 2 THEN 1 ELSE 2 END, tier) AS n FROM g) WHERE n = 1")
def s3_choose_fetch(spark, d):
    f = _logs(spark, d).select("url", "status_code", "engine_used", F.col("id").cast("long").alias("id")).withColumn("tier", F.when(F.col("id") % 2 == 0, 1).otherwise(2))
    one = f.groupBy("url", "tier").agg(F.min_by("status_code", "id").alias("s0"), F.min("id").alias("id")).join(f.select("id", "status_code"), "id").withColumn("is_blocked", F.lit(False)).select("url", "tier", "status_code", "is_blocked")
    return crawl.choose_fetch(one).select("url", "tier", "status_code")


# ---------------------------------------------------------------- e-mail, people, phones

_DOC_EMAILS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{K.EMAIL}')) AS email FROM documents"


@query(_DOC_EMAILS)
def e1_document_emails(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(E.find_all(F.col("text"))).alias("email"))


@query(f"SELECT doc_id, lower(email) AS email FROM ({_DOC_EMAILS})")  # nothing ran into these addresses
def e2_clean_emails(spark, d):
    return e1_document_emails(spark, d).select("doc_id", E.clean_email_udf(F.col("email")).alias("email"))


@query(WITH + f"SELECT id, work_email NOT IN {_in(K.PLACEHOLDER_EMAILS)} AND lower(split_part(work_email, '@', -1)) NOT IN {_in(K.FREE_PROVIDERS)} AND split_part(work_email, '@', 1) NOT IN {_in(K.PLACEHOLDER_LOCALS)} AS business, regexp_matches(trim(work_email), '^{K.EMAIL}$') AS valid, lower(split_part(trim(work_email), '@', -1)) IN {_in(K.DISPOSABLE_DOMAINS)} AS disposable FROM leads")
def e3_e10_e11_email_tests(spark, d):
    e = F.col("work_email")
    return _leads(spark, d).select("id", E.business(e).alias("business"), E.valid_syntax(e).alias("valid"), E.disposable(e).alias("disposable"))


@query(WITH + "SELECT id, CASE WHEN contains(work_email, '@') THEN replace(replace(work_email, '@', '@'), '.', '.') ELSE work_email END AS email FROM leads")
def e4_deobfuscate(spark, d):
    spelled = F.regexp_replace(F.regexp_replace("work_email", "@", " [at] "), r"\.", " (dot) ")
    return _leads(spark, d).select("id", E.deobfuscate(spelled).alias("email"))


@query(WITH + "SELECT id, work_email AS email FROM leads")
def e5_decode_protected(spark, d):
    key = 0x1B
    code = F.concat(F.lit(f"{key:02x}"), F.array_join(F.transform(F.split("work_email", ""), lambda c: F.lpad(F.lower(F.hex(F.ascii(c).bitwiseXOR(F.lit(key)))), 2, "0")), ""))
    return _leads(spark, d).select("id", E.decode_hex(code).alias("email"))


_PARTS = "list_filter(string_split_regex(regexp_replace(split_part(split_part(email, '@', 1), '+', 1), '[0-9]+$', ''), '[._-]+'), lambda w: regexp_matches(w, '^\\pL+$'))"
_CAP = "upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"


@query(
    f"""WITH p AS (SELECT doc_id, email, {_PARTS} AS ws FROM ({_DOC_EMAILS})), c AS (SELECT *, lower(ws[1]) AS w, list_filter(range(3, len(ws[1]) - 2), lambda k: substr(lower(ws[1]), k, 1) = substr(lower(ws[1]), k + 1, 1))[1] AS cut FROM p)
SELECT doc_id, email, CASE WHEN len(ws) = 0 OR w IN {_in(K.ROLE_LOCALS)} THEN NULL WHEN len(ws) > 1 THEN {_CAP.format(w='ws[1]')} WHEN cut IS NOT NULL AND regexp_matches(w, '^[a-z]+$') THEN {_CAP.format(w='substr(w, 1, cut)')} WHEN w IN {_in(K.FIRST_NAMES)} THEN {_CAP.format(w='w')} END AS first_name,
 CASE WHEN len(ws) = 0 OR w IN {_in(K.ROLE_LOCALS)} THEN NULL WHEN len(ws) > 1 THEN array_to_string(list_transform(ws[2:], lambda x: {_CAP.format(w='x')}), ' ') WHEN cut IS NOT NULL AND regexp_matches(w, '^[a-z]+$') THEN {_CAP.format(w='substr(w, cut + 1)')} END AS last_name FROM c"""
)
def e8_names_from_emails(spark, d):
    e = F.col("email")
    return e1_document_emails(spark, d).select("doc_id", "email", E.first_name(e).alias("first_name"), E.last_name(e).alias("last_name"))


@query(WITH + "SELECT leads.id, CASE WHEN first_name IS NULL OR last_name IS NULL THEN '' ELSE lower(first_name) || '.' || lower(last_name) || '@' || domain || ',' || lower(first_name) || lower(last_name) || '@' || domain || ',' || substr(lower(first_name), 1, 1) || lower(last_name) || '@' || domain || ',' || lower(first_name) || '@' || domain END AS candidates FROM leads JOIN companies ON company_id = companies.id")
def e9_candidates(spark, d):
    c = _companies(spark, d).select(F.col("id").alias("company_id"), "domain")
    return _leads(spark, d).join(c, "company_id").select("id", F.array_join(E.candidate_list(F.col("first_name"), F.col("last_name"), F.col("domain")), ",").alias("candidates"))


_SENIOR = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{s}'" for s, p in K.SENIORITY) + " WHEN title <> '' THEN 'individual_contributor' END"
_DEPARTMENT = "CASE " + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{x}'" for w, x in K.DEPARTMENTS) + " END"


@query(WITH + f"SELECT id, {_SENIOR} AS seniority, {_DEPARTMENT} AS department FROM leads")
def n4_n5_seniority_department(spark, d):
    return _leads(spark, d).select("id", P.seniority_of(F.col("title")).alias("seniority"), P.department_of(F.col("title")).alias("department"))


@query("SELECT p_partkey, p_size || CASE WHEN p_partkey % 3 = 0 THEN '+' WHEN p_partkey % 3 = 1 THEN '-' || (p_size + 40) ELSE '' END AS company_size FROM part")
def n1_company_sizes(spark, d):
    size = F.concat(F.lit("Team size: "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "+ employees").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), (F.col("p_size") + 40).cast("string"))).otherwise(" people"))
    return read(spark, d, "part").select("p_partkey", P.size_of(size).alias("company_size"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '; ' || p_brand ELSE p_type END AS industry FROM part")
def n2_industries(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_type"), F.lit("-20%| "), F.col("p_brand"), F.lit(" 5.5%;"), F.col("p_type"))).otherwise(F.concat(F.lit("Industry: "), F.col("p_type")))
    return read(spark, d, "part").select("p_partkey", P.industry_of(raw).alias("industry"))


@query("SELECT p_partkey, nullif(substr(trim(p_name), 1, 8), '') AS name FROM part")
def n9_caps(spark, d):
    return read(spark, d, "part").select("p_partkey", P.capped(F.col("p_name"), 8).alias("name"))


@query("SELECT c_custkey, '415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone FROM customer")
def t1_tidy_phones(spark, d):
    raw = F.concat(F.lit(" .415   555 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" -,"))
    return read(spark, d, "customer").select("c_custkey", P.tidy(raw).alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '415 555 0001,415 555 0002' ELSE '415 555 0001,+1 415 555 0003,415 555 0002' END AS phones FROM customer")
def t4_merge_phones(spark, d):
    phones = lambda *n: F.array(*(F.struct(F.lit(x).alias("number"), F.lit("office").alias("type")) for x in n))
    old = F.when(F.col("c_custkey") % 2 == 0, phones("415 555 0001", "123")).otherwise(phones("415 555 0001", "+1 415 555 0003"))
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.transform(P.merged_phones(old, phones("(415) 555-0001", "415 555 0002")), lambda p: p["number"]), ",").alias("phones"))


# ---------------------------------------------------------------- merges

_LAST = "SELECT domain, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(industry, seq) FILTER (industry IS NOT NULL) AS industry FROM b GROUP BY domain"


def _company_batch(spark, d):
    host = U.domain(F.col("url"))
    return _pages(spark, d).select(F.regexp_replace(host, r"^(m|blog)\.", "").alias("domain"), F.when(F.col("page_id") % 3 > 0, H.title(F.col("html"))).alias("name"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("i"), (F.col("page_id") % 7).cast("string"))).alias("industry"), F.col("page_id").alias("seq"), F.create_map(F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string")), F.col("page_id").cast("string")).alias("extra_metadata"))


_COMPANY_ROWS = f"SELECT regexp_replace({HOST}, '^(m|blog)\\.', '') AS domain, CASE WHEN page_id % 3 > 0 THEN {_TITLE} END AS name, CASE WHEN page_id % 5 = 0 THEN 'i' || (page_id % 7) END AS industry, page_id FROM pages"


@query(
    f"""WITH p AS ({_COMPANY_ROWS}),
 o AS (SELECT domain, 'id-' || domain AS id, 'old ' || domain AS name, CASE WHEN max(page_id) % 2 = 0 THEN 'old' END AS industry, '2020' AS created FROM p WHERE page_id % 4 < 2 GROUP BY domain),
 b AS (SELECT domain, name, industry, NULL AS id, NULL AS created, page_id AS seq FROM p WHERE page_id % 4 >= 2 UNION ALL SELECT domain, name, industry, id, created, -1 FROM o),
 m AS (SELECT domain, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM (SELECT domain, k, arg_max(v, s) AS v FROM (SELECT domain, 'k' || (page_id % 3) AS k, CAST(page_id AS VARCHAR) AS v, page_id AS s FROM p WHERE page_id % 4 >= 2 UNION ALL SELECT domain, unnest(['k0', 'old']), 'was', -1 FROM o) GROUP BY domain, k) GROUP BY domain)
SELECT domain, coalesce(max(id), sha256(domain)) AS id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(industry, seq) FILTER (industry IS NOT NULL) AS industry, max(created) AS created, any_value(metadata) AS metadata FROM b JOIN m USING (domain) GROUP BY domain"""
)
def u1_upsert_companies(spark, d):
    rows, k = _company_batch(spark, d), F.col("seq")
    old = rows.filter(k % 4 < 2).groupBy("domain").agg(F.max("seq").alias("m"))
    old = old.select("domain", F.concat(F.lit("id-"), "domain").alias("id"), F.concat(F.lit("old "), "domain").alias("name"), F.when(F.col("m") % 2 == 0, "old").alias("industry"), F.lit("2020").alias("created"), F.create_map(F.lit("k0"), F.lit("was"), F.lit("old"), F.lit("was")).alias("extra_metadata"))
    kept, _ = merge.upsert_companies(old, rows.filter(k % 4 >= 2))
    text = F.array_join(F.transform(F.map_entries("extra_metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return kept.select("domain", "id", "name", "industry", "created", text.alias("metadata"))


_TECHS = "SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderpriority AS tech_name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS category, o_orderkey FROM orders"


@query(f"WITH t AS ({_TECHS}), o AS (SELECT company_id, tech_name, 'Old' AS category FROM t WHERE o_orderkey % 5 = 0 GROUP BY ALL) SELECT * FROM o UNION ALL SELECT company_id, tech_name, coalesce(arg_min_null(category, o_orderkey), 'Detected Stack') FROM t ANTI JOIN o USING (company_id, tech_name) WHERE o_orderkey % 5 > 0 GROUP BY 1, 2")
def u2_insert_technologies(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderpriority").alias("tech_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category"), F.col("o_orderkey").alias("seq"))
    old = rows.filter("seq % 5 = 0").select("company_id", "tech_name", F.lit("Old").alias("category")).distinct()
    return merge.insert_technologies(old, rows.filter("seq % 5 > 0"))


@query(
    """WITH n AS (SELECT 'c' || (o_custkey % 500) || '@x.com' AS work_email, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, CAST(o_custkey AS VARCHAR) AS company_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS email_status, NULL AS note, lpad(CAST(o_orderkey % 4 AS VARCHAR), 10, '5') AS phone, o_orderkey AS seq FROM orders),
 o AS (SELECT 'c' || c_custkey || '@x.com' AS work_email, CASE WHEN c_custkey % 2 = 0 THEN 'Old' ELSE '' END AS title, 'c0' AS company_id, 'old' AS email_status, 'kept' AS note, '5555555559' AS phone, -1 AS seq FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 600),
 b AS (SELECT * FROM n UNION ALL SELECT * FROM o),
 p AS (SELECT work_email, phone, min(seq) AS s FROM b GROUP BY ALL),
 f AS (SELECT work_email, string_agg(phone, ',' ORDER BY s, phone) AS phones FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY work_email ORDER BY s, phone) <= 5) GROUP BY work_email)
SELECT work_email, coalesce(arg_max(title, seq) FILTER (title <> ''), arg_min(title, seq)) AS title, arg_max(company_id, seq) AS company_id, arg_max_null(email_status, seq) AS email_status, max(note) AS note, any_value(phones) AS phones FROM b JOIN f USING (work_email) GROUP BY work_email"""
)
def u3_upsert_leads(spark, d):
    o = read(spark, d, "orders")
    phone = lambda number: F.array(F.struct(number.alias("number"), F.lit("office").alias("type"))).alias("phones")
    rows = o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 500).cast("string"), F.lit("@x.com")).alias("work_email"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_custkey").cast("string").alias("company_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("email_status"), phone(F.lpad((F.col("o_orderkey") % 4).cast("string"), 10, "5")), F.col("o_orderkey").alias("seq"),
    )
    k = F.col("c_custkey")
    old = read(spark, d, "customer").filter((k % 3 == 0) & (k < 600)).select(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.com")).alias("work_email"), F.when(k % 2 == 0, "Old").otherwise("").alias("title"), F.lit("c0").alias("company_id"), F.lit("old").alias("email_status"), F.lit("kept").alias("note"), phone(F.lit("5555555559")))
    out = merge.upsert_leads(old, rows)
    return out.select("work_email", "title", "company_id", "email_status", "note", F.array_join(F.transform("phones", lambda p: p["number"]), ",").alias("phones"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1")
def u4_purge_duplicates(spark, d):
    return merge.purge_duplicates(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query(WITH + "SELECT leads.id, company_id FROM leads WHERE company_id IN (SELECT id FROM companies WHERE CAST(id AS INT) % 2 = 0)")
def u5_cascade_delete(spark, d):
    c = _companies(spark, d)
    return merge.delete_companies(c, c.filter("cast(id as int) % 2 = 1"), _leads(spark, d))[1].select("id", "company_id")


# ---------------------------------------------------------------- verdicts

_MX = "CASE WHEN CAST(split_part(split_part(domain, '-', 2), '.', 1) AS INT) % 6 = 0 THEN [] ELSE ['mx.' || domain] END"


def _verdict_inputs(spark, d):
    domains = _companies(spark, d).select(F.col("domain"), F.col("id").cast("int").alias("n"))
    mx = domains.select("domain", F.when(F.col("n") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("mx."), "domain"))).alias("mx_records"), F.lit(None).cast("string").alias("lookup_error"))
    k = F.col("id").cast("int")
    probe = _leads(spark, d).filter(k % 11 > 0).select(F.col("work_email").alias("email"), F.lit(1).alias("mx_rank"), F.when(k % 4 == 0, 550).when(k % 4 == 1, 450).otherwise(250).alias("rcpt_code"), F.when(k % 8 > 4, 550).when(k % 8 > 2, 250).otherwise(451).alias("catch_all_probe_code"), F.when(k % 10 == 9, "timeout").alias("error"))
    cache = domains.filter("n % 9 = 2").select("domain", (F.col("n") % 2 == 0).alias("is_catch_all"))
    return _leads(spark, d).select(F.col("work_email").alias("email")), mx, probe, cache


_STATUS = f"""CASE WHEN NOT regexp_matches(email, '^{K.EMAIL}$') THEN 'invalid' WHEN n IS NULL OR n % 6 = 0 THEN 'invalid' WHEN k % 11 = 0 OR k % 10 = 9 THEN 'unverified'
 WHEN k % 4 = 0 THEN 'invalid' WHEN k % 4 = 1 THEN 'unverified' WHEN n % 9 = 2 THEN CASE WHEN n % 2 = 0 THEN 'catch_all' ELSE 'verified' END WHEN k % 8 > 4 THEN 'verified' WHEN k % 8 > 2 THEN 'catch_all' ELSE 'unverified' END"""
_ASKED = "FROM (SELECT leads.id, work_email AS email, CAST(leads.id AS INT) AS k, CAST(c.id AS INT) AS n FROM leads LEFT JOIN companies c ON c.domain = lower(split_part(work_email, '@', -1)))"


@query(WITH + f"SELECT email, {_STATUS} AS status {_ASKED}")
def e12_e13_e14_verdicts(spark, d):
    return verify.verify(*_verdict_inputs(spark, d)).select("email", "status")


@query(
    WITH
    + f"""SELECT id, status AS email_status, status = 'verified' AS email_verified, mx AS mx_valid, CASE WHEN mx AND k % 11 > 0 AND regexp_matches(email, '^{K.EMAIL}$') THEN '2024-02-01 00:00:00' END AS email_verified_at, 'direct' AS source_platform
 FROM (SELECT *, {_STATUS} AS status, coalesce(n % 6 <> 0, FALSE) AS mx {_ASKED})"""
)
def e15_apply_verdicts(spark, d):
    leads = _leads(spark, d)
    return verify.apply_verdicts(leads, verify.verify(*_verdict_inputs(spark, d)), F.lit("2024-02-01").cast("timestamp"), "direct").select("id", "email_status", "email_verified", "mx_valid", F.col("email_verified_at").cast("string").alias("email_verified_at"), "source_platform")


@query()
def e16_infer_people(spark, d):
    c = _companies(spark, d).select(F.col("id").alias("company_id"), "domain")
    leads = _leads(spark, d).join(c, "company_id")
    people = leads.select("company_id", "id", "first_name", "last_name", E.candidate_list(F.col("first_name"), F.col("last_name"), F.col("domain")).alias("candidate_emails")).withColumn("pos", F.expr("cast(row_number() over (partition by company_id order by cast(id as int)) - 1 as int)"))
    people = people.withColumn("page", F.col("company_id"))
    verdicts = people.select(F.explode("candidate_emails").alias("email")).distinct().withColumn("status", F.when(F.crc32(F.col("email").cast("binary")) % 3 == 0, "verified").otherwise("invalid"))
    return verify.infer_people(people, verdicts, leads.select(F.col("work_email").alias("email")))


@query(WITH + "SELECT id, CASE WHEN CAST(id AS INT) % 10 = 0 THEN 'disposable' WHEN email_verified AND mx_valid THEN 'verified' WHEN NOT mx_valid THEN 'invalid' ELSE 'unverified' END AS status FROM leads")
def e17_legacy_status(spark, d):
    return _leads(spark, d).select("id", verify.legacy_status(F.col("id").cast("int") % 10 == 0, F.col("email_verified"), F.col("mx_valid")).alias("status"))


# ---------------------------------------------------------------- frontier

_NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")


_LATER = "TIMESTAMP '2024-02-06 00:00:00'"


@query(WITH + f"SELECT DISTINCT url FROM logs WHERE url NOT IN (SELECT url FROM logs WHERE status_code = 200 AND scraped_at >= {_LATER} - INTERVAL 7 DAY)")
def r1_cooldown(spark, d):
    logs = _logs(spark, d)
    return crawl.due(logs.select("url").distinct(), logs, F.expr("TIMESTAMP_NTZ '2024-02-06 00:00:00'"))


@query(WITH + "SELECT DISTINCT url FROM logs WHERE url NOT IN (SELECT url FROM logs WHERE status_code = 403)")
def r2_claim(spark, d):
    logs = _logs(spark, d)
    return crawl.claim(logs.select("url"), logs.filter("status_code = 403").select("url").distinct())


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'skipped' WHEN page_id % 10 IN (1, 2) THEN 'failed' WHEN page_id % 10 = 3 THEN 'retry' WHEN page_id % 10 = 4 THEN 'failed' WHEN page_id % 10 = 6 THEN 'incomplete' ELSE 'success' END AS outcome, CASE page_id % 10 WHEN 0 THEN 'cooldown' WHEN 1 THEN 'not_found' WHEN 2 THEN 'soft_404' WHEN 3 THEN 'blocked' WHEN 4 THEN 'blocked' WHEN 5 THEN 'listing' WHEN 6 THEN 'no_company' END AS reason FROM pages")
def o2_outcomes(spark, d):
    k = F.col("page_id") % 10
    out = crawl.outcome(k == 0, F.when(k == 1, 404).otherwise(200), k == 2, k.isin(3, 4), F.when(k == 5, U.LISTING).otherwise(U.SITE), k != 6, F.when(k == 4, 2).otherwise(0))
    return _pages(spark, d).select("page_id", out.alias("o")).select("page_id", "o.outcome", "o.reason")


_ROUND = "SELECT l.link AS url, max(f.depth) - 1 AS depth FROM {f} f JOIN l ON l.url = f.url WHERE f.depth > 0 AND l.link NOT IN (SELECT url FROM {seen}) GROUP BY l.link"


@query(
    _LINKS.replace("FROM pages)", "FROM first)", 1).replace("WITH h AS", f"WITH first AS (SELECT arg_min(page_id, page_id) AS page_id, {CANONICAL} AS url, arg_min(html, page_id) AS html FROM pages GROUP BY {CANONICAL}), h AS", 1).replace("l AS (SELECT DISTINCT", "g AS (SELECT DISTINCT", 1).replace("FROM l)", "FROM g)", 1)
    + f""", l AS (SELECT first.url, r.link FROM r JOIN first USING (page_id) WHERE n <= 15),
 s AS (SELECT min(url) AS url, 2 AS depth FROM first GROUP BY {HOST}), a1 AS ({_ROUND.format(f='s', seen='s')}), s1 AS (SELECT * FROM s UNION ALL SELECT * FROM a1), a2 AS ({_ROUND.format(f='a1', seen='s1')})
SELECT url, CAST(depth AS INT) AS depth, CAST(0 AS INT) AS round FROM s UNION ALL SELECT url, CAST(depth AS INT), 1 FROM a1 UNION ALL SELECT url, CAST(depth AS INT), 2 FROM a2"""
)
def o3_o4_o5_crawl(spark, d):
    """From the first address of every host; of pages with one address the first counts."""
    pages = _pages(spark, d).withColumn("url", U.canonical_url_udf(F.col("url"))).groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    parsed = cut_lineage(parse_pages(pages))
    seeds = parsed.groupBy(U.domain(F.col("url"))).agg(F.min("url").alias("url")).select("url", F.lit(2).alias("depth"))
    return crawl.crawl(seeds, parsed, 2)


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'import' WHEN page_id % 3 = 1 THEN 'direct' ELSE 'clutch.co' END AS platform FROM pages")
def o7_platform(spark, d):
    k = F.col("page_id") % 3
    u = F.when(k == 2, "https://www.clutch.co/profile/x").otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", crawl.platform(F.when(k == 0, "import"), u).alias("platform"))


@query(WITH + "SELECT id, domain, gap FROM (SELECT *, (epoch_us(scraped_at) - epoch_us(lag(scraped_at) OVER (PARTITION BY domain ORDER BY scraped_at, url))) / 1000000.0 AS gap FROM logs) WHERE gap < 600")
def o8_rate_violations(spark, d):
    return crawl.rate_violations(_logs(spark, d), 600).select("id", "domain", "gap")


@query(WITH + f"SELECT domain, arg_max(engine_used, (scraped_at, engine_used)) AS engine FROM logs WHERE status_code = 200 AND scraped_at >= {_NOW} - INTERVAL 7 DAY GROUP BY domain")
def o9_engine_preference(spark, d):
    return crawl.engine_preference(_logs(spark, d), _now())


@query(WITH + "SELECT id, CASE WHEN CAST(id AS INT) % 4 < 2 THEN scraped_at + to_seconds(120 * (CAST(id AS INT) % 4 + 1)) END AS next_attempt_at FROM logs WHERE status_code = 403")
def o10_next_attempt(spark, d):
    return _logs(spark, d).filter("status_code = 403").select("id", crawl.next_attempt(F.col("scraped_at"), F.col("id").cast("int") % 4).alias("next_attempt_at"))


# ---------------------------------------------------------------- reports

_SHARE = "SELECT count(*) AS n, count(*) FILTER (host = domain) AS own, count(*) FILTER (NOT regexp_matches(work_email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS bad, count(*) FILTER (host IN " + _in(K.FREE_PROVIDERS) + ") AS free, count(*) FILTER (n_phones > 0) AS phone, count(*) FILTER (linkedin_url ILIKE '%linkedin.com/in/%') AS linkedin, count(*) FILTER (title <> '') AS title FROM (SELECT leads.*, domain, lower(split_part(work_email, '@', -1)) AS host FROM leads LEFT JOIN companies ON company_id = companies.id)"
_ROW = "SELECT '{m}' AS metric, round({v}, 4) AS value, CASE WHEN {p} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {t}"
_METRICS = " UNION ALL ".join(
    _ROW.format(m=m, v=v, p=p, t=t)
    for m, v, p, t in [
        ("own_domain_pct", "100.0 * own / n", "100.0 * own / n > 80", "s"), ("malformed_emails", "CAST(bad AS DOUBLE)", "bad = 0", "s"), ("free_mail_pct", "100.0 * free / n", "100.0 * free / n < 5", "s"), ("phones_pct", "100.0 * phone / n", "100.0 * phone / n > 50", "s"),
        ("personal_linkedin_pct", "100.0 * linkedin / n", "100.0 * linkedin / n > 80", "s"), ("directory_companies", "CAST(dirs AS DOUBLE)", "dirs = 0", "c"), ("title_pct", "100.0 * title / n", "100.0 * title / n > 60", "s"), ("recrawl_ratio", "logs / urls", "logs / urls <= 1.1", "g"), ("success_pct", "100.0 * ok / known", "100.0 * ok / known >= 95", "g"),
    ]
)
_QUALITY = WITH + f", s AS ({_SHARE}), c AS (SELECT count(*) FILTER (domain IN {_in(list(K.DIRECTORIES))}) AS dirs FROM companies), g AS (SELECT CAST(count(*) AS DOUBLE) AS logs, count(DISTINCT url) AS urls, count(status_code) AS known, count(*) FILTER (status_code BETWEEN 200 AND 399) AS ok FROM logs) "


@query(_QUALITY + _METRICS)
def a2_a13_quality(spark, d):
    return report.quality(_leads(spark, d), _companies(spark, d), _logs(spark, d))


@query(_QUALITY + f"SELECT CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ({_METRICS})")
def a13_overall(spark, d):
    return report.overall(a2_a13_quality(spark, d))


@query(WITH + "SELECT 'leads' AS relation, count(*) AS n FROM leads UNION ALL SELECT 'companies', count(*) FROM companies UNION ALL SELECT 'logs', count(*) FROM logs")
def a1_a26_counts(spark, d):
    return report.counts(leads=_leads(spark, d), companies=_companies(spark, d), logs=_logs(spark, d))


@query(WITH + "SELECT email_status, count(*) AS n FROM leads GROUP BY 1")
def a11_status_distribution(spark, d):
    return report.distribution(_leads(spark, d), "email_status")


@query(WITH + f"SELECT seniority, count(*) AS n FROM (SELECT {_SENIOR} AS seniority FROM leads) WHERE seniority IS NOT NULL GROUP BY 1")
def a12_seniority_distribution(spark, d):
    return report.distribution(_leads(spark, d).withColumn("seniority", P.seniority_of(F.col("title"))), "seniority")


@query(WITH + f"SELECT count(*) FILTER (regexp_matches(work_email, '{report.SUSPICIOUS}')) AS suspicious, count(*) FILTER (lower(split_part(work_email, '@', -1)) IN {_in(report.AUDIT_PROVIDERS)}) AS free_mail, count(*) FILTER (n_phones > 0) AS with_phones, count(linkedin_url) AS with_linkedin, count(*) FILTER (email_verified) AS verified, count(*) FILTER (mx_valid) AS mx_valid FROM leads")
def a14_a16_a18_a21_audit(spark, d):
    return report.audit(_leads(spark, d))


@query(WITH + "SELECT work_email, domain FROM leads JOIN companies ON company_id = companies.id AND NOT ends_with(lower(split_part(work_email, '@', -1)), domain) ORDER BY 1, 2 LIMIT 15")
def a15_mismatches(spark, d):
    return report.mismatches(_leads(spark, d), _companies(spark, d))


@query(f"SELECT host, count(*) AS n FROM (SELECT lower(split_part(email, '@', -1)) AS host FROM ({_DOC_EMAILS})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def a17_email_hosts(spark, d):
    return report.top(e1_document_emails(spark, d), E.host_of(F.col("email")), "host", 15)


@query(WITH + "SELECT linkedin_url, count(*) AS n FROM leads WHERE linkedin_url IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a19_linkedin(spark, d):
    return report.top(_leads(spark, d), F.col("linkedin_url"), "linkedin_url", 10)


@query(WITH + "SELECT first_name, count(*) AS n FROM leads WHERE first_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def a20_first_names(spark, d):
    return report.top(_leads(spark, d), F.col("first_name"), "first_name", 15)


@query(WITH + "SELECT id, domain, name, industry FROM companies")
def a22_companies(spark, d):
    return _companies(spark, d).select("id", "domain", "name", "industry")


@query(WITH + "SELECT engine_used, count(*) AS n FROM logs GROUP BY 1")
def a23_engines(spark, d):
    return report.distribution(_logs(spark, d), "engine_used")


@query(WITH + "SELECT count(*) FILTER (status_code <> 200) AS failed FROM logs")
def a24_failures(spark, d):
    return report.failures(_logs(spark, d))


@query(WITH + "SELECT url, count(*) AS n FROM logs GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a25_rescraped(spark, d):
    return report.rescraped(_logs(spark, d))


@query(WITH + "SELECT id, url, scraped_at FROM logs ORDER BY scraped_at DESC, id DESC LIMIT 10")
def a26_a28_latest(spark, d):
    return report.latest(_logs(spark, d).select("id", "url", "scraped_at"), "scraped_at", "id", 10)


@query(WITH + "SELECT id, coalesce(nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), 'N/A') AS name, work_email FROM leads")
def a27_names(spark, d):
    return report.lead_list(_leads(spark, d))


@query(WITH + "SELECT leads.id, domain FROM leads JOIN companies ON company_id = companies.id")
def r3_leads_companies(spark, d):
    return _leads(spark, d).join(_companies(spark, d).select(F.col("id").alias("company_id"), "domain"), "company_id").select("id", "domain")


# ---------------------------------------------------------------- sample pages

_COMPANY = ["domain", "name", "website_url", "industry", "company_size", "hq_phone", "linkedin_url", "twitter_url"]


def _parsed(spark):
    return parse_pages(_samples(spark))


def _phones(column):
    return F.array_join(F.transform(column, lambda p: F.concat(p["number"], F.lit(" "), p["type"])), ", ")


@query(_values("url, page_type, soft_404, target_website, " + ", ".join(_COMPANY), expected.COMPANIES))
def x1_x3_x4_sample_companies(spark, d):
    """X1, X3, X4 with H10, H11, H16, J1-J4, J6, L2, L3, N1, N2, T5."""
    return _parsed(spark).select("url", "page_type", "soft_404", "target_website", *(F.col(f"company.{c}").alias(c) for c in _COMPANY))


@query(_values("url, work_email, first_name, last_name, title, seniority, department, phones, linkedin_url", expected.LEADS))
def x5_sample_leads(spark, d):
    """X5 with E1-E8, H12, H13, L1, N3-N5, T2, T3."""
    rows = _parsed(spark).select("url", F.explode("leads").alias("l")).select("url", "l.*")
    return rows.withColumn("phones", _phones(F.col("phones")))


@query(_values("url, n, first_name, last_name, title, seniority, department, linkedin_url, candidates", expected.PERSONS))
def x6_sample_persons(spark, d):
    """X6 with E9, N6-N8."""
    rows = _parsed(spark).select("url", F.posexplode("persons").alias("n", "p")).select("url", "n", "p.*")
    return rows.withColumn("candidates", F.array_join("candidate_emails", ", ")).drop("candidate_emails")


@query(_values("url, kind, n, link", expected.LINKS))
def h7_h8_h9_sample_links(spark, d):
    def named(kind: str):
        return F.transform(f"{kind}_links", lambda u, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), u.alias("link")))

    return _parsed(spark).select("url", F.explode(F.concat(*map(named, ("profile", "pagination", "internal")))).alias("l")).select("url", "l.*")


@query(_values("url, kind, name, value", expected.FACTS))
def h14_h15_j5_sample_facts(spark, d):
    def named(kind: str, column: str):
        return F.transform(F.map_entries(f"company.{column}"), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("value")))

    return _parsed(spark).select("url", F.explode(F.concat(named("metadata", "extra_metadata"), named("technology", "tech_category_map"))).alias("f")).select("url", "f.*")


def _task(spark):
    """O1 over the sample pages: one address was fetched well lately, one is gone, one blocked, one comes twice."""
    n = len(samples.PAGES)
    rows = [(k, u, h, 200, False, "http", 0, 1, None) for k, (u, h) in enumerate(samples.PAGES)]
    rows[7] = (7, rows[7][1], None, 404, False, "http", 0, 1, None)
    rows[8] = (8, rows[8][1], None, 403, True, "browser", 1, 1, None)
    rows.append((n, rows[4][1] + "?utm_source=again", "<p>again</p>", 200, False, "http", 0, 1, None))
    fetches = spark.createDataFrame(rows, "seq long, url string, html string, status_code int, is_blocked boolean, engine_used string, retries int, depth int, given_platform string")
    now = F.lit("2024-03-01").cast("timestamp")
    log = spark.createDataFrame([(rows[9][1], 200, "2024-02-27"), (rows[5][1], 200, "2024-01-01"), (rows[5][1], 500, "2024-02-29")], "url string, status_code int, at string").select("url", "status_code", F.col("at").cast("timestamp").alias("scraped_at"))
    hosts = ["kestrel-freight.example.com", "larkspur.example.com", "terntide.example.com"]
    mx = spark.createDataFrame([(h, ["mx." + h], None) for h in hosts], "domain string, mx_records array<string>, lookup_error string")
    codes = [("ivo.marek@larkspur.example.com", 250, 550), ("press@larkspur.example.com", 550, None), ("sales@larkspur.example.com", 250, 250), ("ruth.mcallister@terntide.example.com", 550, None), ("ruthmcallister@terntide.example.com", 250, 550), ("jo.lind@terntide.example.com", 450, None)]
    probes = spark.createDataFrame([(e, 1, a, b, None) for e, a, b in codes], "email string, mx_rank int, rcpt_code int, catch_all_probe_code int, error string")
    cache = spark.createDataFrame([("kestrel-freight.example.com", True)], "domain string, is_catch_all boolean")
    old = spark.createDataFrame([("company-7", "larkspur.example.com", "Larkspur", "Berlin")], "id string, domain string, name string, industry string")
    leads = spark.createDataFrame([("ivo.marek@larkspur.example.com", "Ivo", "Intern", "company-0")], "work_email string, first_name string, title string, company_id string")
    return task.run_task(fetches, log, now, mx, probes, cache, old, leads)


@query(_values("seq, outcome, reason, next_attempt_at", expected.OUTCOMES))
def o1_sample_task_outcomes(spark, d):
    return _task(spark)["outcomes"].select(F.col("seq").cast("int").alias("seq"), "outcome", "reason", F.col("next_attempt_at").cast("string").alias("next_attempt_at"))


@query(_values("work_email, company_domain, first_name, last_name, title, email_status, email_verified, mx_valid, verified_at, source_platform", expected.TASK_LEADS))
def o1_sample_task_leads(spark, d):
    """R10 too: leads by their company's id, of which one is from the old snapshot."""
    made = _task(spark)
    rows = made["leads"].join(made["companies"].select(F.col("id").alias("company_id"), F.col("domain").alias("company_domain")), "company_id", "left")
    return rows.select("work_email", "company_domain", "first_name", "last_name", "title", "email_status", "email_verified", "mx_valid", F.col("email_verified_at").cast("date").cast("string").alias("verified_at"), "source_platform")


@query(_values("url, depth", expected.FRONTIER))
def o1_sample_task_frontier(spark, d):
    return _task(spark)["frontier"]
