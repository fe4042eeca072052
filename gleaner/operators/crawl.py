"""Frontier operators over tables of fetched pages and of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls as U

COOLDOWN_DAYS, MOST_LINKS = 7, 15
#: Microseconds.
HOUR = 3_600_000_000


def due(urls: DataFrame, log: DataFrame, now: Column, days: int = COOLDOWN_DAYS) -> DataFrame:
    """URLs without a successful fetch in the last ``days`` days; a range condition and an anti join."""
    recent = log.filter((F.col("status_code") == 200) & (F.col("scraped_at") >= now - F.make_interval(days=F.lit(days)))).select("url").distinct()
    return urls.join(recent, "url", "left_anti")


def claim(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """R2: URLs, each once, that the session hasn't seen."""
    return urls.dropDuplicates(["url"]).join(visited.select("url"), "url", "left_anti")


def choose_fetch(fetches: DataFrame) -> DataFrame:
    """S3: the first tier's fetch of a URL if it was 200 and not blocked, else the second tier's."""
    good = (F.col("tier") == 1) & (F.col("status_code") == 200) & ~F.col("is_blocked")
    rank = F.when(good, 0).when(F.col("tier") == 2, 1).otherwise(2)
    rest = [c for c in fetches.columns if c != "url"]
    return fetches.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct(rank, F.col("tier"))).alias("f")).select("url", "f.*")


def outcome(recent: Column, status: Column, soft_404: Column, blocked: Column, kind: Column, has_company: Column, retries: Column) -> Column:
    """O2: what a page's task came to, as (outcome, reason)."""
    made = lambda a, b=None: F.struct(F.lit(a).alias("outcome"), F.lit(b).cast("string").alias("reason"))
    return (
        F.when(recent, made("skipped", "cooldown")).when(status == 404, made("failed", "not_found")).when(soft_404, made("failed", "soft_404"))
        .when(blocked & (retries < 2), made("retry", "blocked")).when(blocked, made("failed", "blocked"))
        .when(kind == U.LISTING, made("success", "listing")).when(~has_company, made("incomplete", "no_company")).otherwise(made("success"))
    )


def next_attempt(at: Column, retries: Column) -> Column:
    """A blocked page comes again after two minutes, then four; then no more."""
    return F.when(retries < 2, at + F.make_interval(secs=(120 * (retries + 1)).cast("decimal(18,6)")))


def platform(given: Column, url: Column) -> Column:
    """O7."""
    return F.coalesce(given, F.when(U.classify(url) != U.SITE, U.domain(url)).otherwise("direct"))


def start_depth(depth: Column, recursive: Column) -> Column:
    """A recursive task that gives no depth starts with one."""
    return F.when(recursive & (depth == 0), 1).otherwise(depth)


def with_scheme(url: Column) -> Column:
    """An address without a scheme is a secure one."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))


def engine_preference(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The engine of each domain's last success in ``days`` days."""
    ok = log.filter((F.col("status_code") == 200) & (F.col("scraped_at") >= now - F.make_interval(days=F.lit(days))))
    return ok.groupBy("domain").agg(F.max_by("engine_used", F.struct("scraped_at", "engine_used")).alias("engine"))


def rate_violations(log: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Fetches of a domain that came too soon after the one before.

    A domain may have any share of the log, so its fetches are dealt out by hour.  The last fetch of every hour
    (one row) goes to the domain's next hour with fetches too.
    """
    at = F.unix_micros(F.col("scraped_at").cast("timestamp"))
    rows = log.withColumns({"_at": at, "_hour": F.floor(at / HOUR).cast("long")})
    last = rows.groupBy("domain", "_hour").agg(F.max("_at").alias("_at"))
    before = last.withColumn("_before", F.expr("lag(_at) over (partition by domain order by _hour)")).select(F.col("domain").alias("_domain"), F.col("_hour").alias("_of"), "_before")
    rows = rows.withColumn("_lag", F.expr("lag(_at) over (partition by domain, _hour order by _at, url)"))
    rows = rows.join(before, rows["domain"].eqNullSafe(before["_domain"]) & (rows["_hour"] == before["_of"]))
    gap = (F.col("_at") - F.coalesce("_lag", "_before")) / 1e6
    return rows.withColumn("gap", gap).filter(F.col("gap") < seconds).drop("_at", "_hour", "_domain", "_of", "_before", "_lag")


def children(parsed: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(url, depth) of what a round of pages leads to.  ``parsed`` has a page's depth beside its record."""
    of_listing = F.concat(F.slice("profile_links", 1, most), F.col("pagination_links"))
    onward = F.when(F.col("page_type") == U.LISTING, F.transform(of_listing, lambda u: F.struct(u.alias("url"), F.lit(0).alias("depth"))))
    onward = onward.when(F.col("page_type") == U.PROFILE, F.filter(F.array(F.struct(F.col("target_website").alias("url"), F.greatest("depth", F.lit(1)).alias("depth"))), lambda x: x["url"].isNotNull()))
    onward = onward.when(F.col("depth") > 0, F.transform("internal_links", lambda u: F.struct(u.alias("url"), (F.col("depth") - 1).alias("depth"))))
    return parsed.select(F.explode(onward).alias("c")).select("c.url", "c.depth")


def crawl(seeds: DataFrame, parsed: DataFrame, rounds: int) -> DataFrame:
    """(url, depth, round) reached from ``seeds`` (url, depth) over parsed pages, each page once, in at most ``rounds`` rounds.

    ``parsed``: records of ``parse_pages`` with ``url`` canonical.  A round is a join with the pages at hand
    and an anti join with what was seen; lineage is cut after each.
    """
    from gleaner.checkpoints import cut_lineage

    best = lambda df: df.groupBy("url").agg(F.max("depth").alias("depth"))
    frontier = cut_lineage(best(seeds).withColumn("round", F.lit(0)))
    seen = frontier
    for n in range(1, rounds + 1):
        pages = frontier.select("url", "depth").join(parsed, "url")
        frontier = cut_lineage(best(children(pages)).join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
