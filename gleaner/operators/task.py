"""The whole task as one plan: fetched pages and observations in, snapshots, log and frontier out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.checkpoints import cut_lineage
from gleaner.functions import urls as U
from gleaner.operators import crawl, merge, verify
from gleaner.pages import parse_pages


def run_task(fetches: DataFrame, log: DataFrame, now: Column, mx: DataFrame, probes: DataFrame, catch_all: DataFrame, companies: DataFrame | None = None, leads: DataFrame | None = None, technologies: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcomes, log, companies, leads, technologies and frontier after ``fetches``.

    fetches(seq, url, html, status_code, is_blocked, engine_used, retries, depth, given_platform): the fetch that
    was chosen for each address; ``seq`` orders them.  ``log`` and the snapshots are those from before; a
    snapshot of None is empty.  Pages that were fetched well lately are skipped, as are repeats of an address.
    Parsed pages are checkpointed once, as everything after starts from them.
    """
    rows = fetches.withColumn("url", U.canonical_url_udf(F.col("url")))
    rows = rows.groupBy("url").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "url")), "seq").alias("f")).select("url", "f.*")
    fresh = crawl.due(rows, log, now)
    parsed = parse_pages(fresh.filter((F.coalesce(F.col("status_code"), F.lit(200)) != 404) & ~F.col("is_blocked")))
    pages = cut_lineage(rows.join(fresh.select("url", F.lit(True).alias("due")), "url", "left").join(parsed, "url", "left"))
    told = crawl.outcome(F.col("due").isNull(), F.col("status_code"), F.coalesce("soft_404", F.lit(False)), F.col("is_blocked"), F.col("page_type"), F.col("company").isNotNull(), F.col("retries"))
    pages = pages.withColumn("o", told).withColumn("domain", U.domain(F.col("url"))).withColumn("platform", crawl.platform(F.col("given_platform"), F.col("url")))
    outcomes = pages.select("seq", "url", "o.outcome", "o.reason", F.when(F.col("o.outcome") == "retry", crawl.next_attempt(now, F.col("retries"))).alias("next_attempt_at"))
    new_log = pages.filter("o.outcome <> 'skipped'").select("url", "domain", "status_code", "engine_used", F.when(F.col("o.outcome") != "success", F.col("o.reason")).alias("error_message"), now.alias("scraped_at"))

    good = pages.filter((F.col("o.outcome") == "success") & F.col("company").isNotNull())
    batch = good.select("seq", "company.*").drop("tech_category_map")
    companies, rejected = merge.upsert_companies(companies, batch)
    companies = cut_lineage(companies)
    ids = companies.select(F.col("domain").alias("company_domain"), F.col("id").alias("company_id"))
    found = good.select("seq", "page_type", "platform", F.col("company.domain").alias("company_domain"), "company.tech_category_map", "leads", "persons").join(ids, "company_domain")
    techs = found.select("company_id", "seq", F.explode("tech_category_map").alias("tech_name", "category"))
    technologies = merge.insert_technologies(technologies, techs)

    people = found.select(F.col("seq").cast("string").alias("page"), "company_id", "platform", F.posexplode("persons").alias("pos", "p")).select("page", "company_id", "platform", "pos", "p.*")
    direct = found.select("seq", "company_id", "platform", F.posexplode("leads").alias("n", "l")).select("seq", "n", "company_id", "platform", "l.*")
    asked = direct.select(F.col("work_email").alias("email")).union(people.filter(F.col("pos") < verify.MOST_PERSONS).select(F.explode(F.slice("candidate_emails", 1, verify.MOST_CANDIDATES)))).distinct()
    verdicts = cut_lineage(verify.verify(asked, mx, probes, catch_all))
    # The names of people in whom no e-mail was found on the page, by the first candidate that can be delivered.
    chosen = verify.infer_people(people, verdicts, direct.select(F.col("work_email").alias("email")))
    inferred = chosen.select("page", "pos", "work_email").join(people, ["page", "pos"]).withColumn("n", F.col("pos") + 1_000_000)
    inferred = inferred.select(F.col("page").cast("long").alias("seq"), "n", "company_id", "platform", "first_name", "last_name", "title", "seniority", "department", "work_email", F.array().cast("array<struct<number:string,type:string>>").alias("phones"), "linkedin_url")
    both = direct.select(inferred.columns).unionByName(inferred)
    v = verdicts.select(F.col("email").alias("work_email"), F.col("status").alias("email_status"), F.col("has_mx_records").alias("mx_valid"), F.col("is_disposable").alias("disposable_flag"), "smtp_checked")
    both = both.join(v, "work_email", "left").withColumns({"email_status": F.coalesce("email_status", F.lit(verify.UNVERIFIED)), "mx_valid": F.coalesce("mx_valid", F.lit(False)), "disposable_flag": F.coalesce("disposable_flag", F.lit(False)), "email_verified_at": F.when(F.col("smtp_checked"), now)})
    both = both.withColumn("email_verified", F.col("email_status") == verify.VERIFIED).withColumnRenamed("platform", "source_platform")
    # Pages and their leads in one order.
    both = both.withColumn("seq", F.col("seq") * 2_000_000 + F.col("n")).drop("n", "smtp_checked")
    leads = merge.upsert_leads(leads, both)

    onward = good.unionByName(pages.filter(F.col("o.reason") == "listing"))
    frontier = crawl.children(onward).groupBy("url").agg(F.max("depth").alias("depth")).join(rows.select("url"), "url", "left_anti")
    return {"outcomes": outcomes, "log": new_log, "companies": companies, "rejected": rejected, "technologies": technologies, "leads": leads, "frontier": frontier}
