"""Data-quality reports as DataFrames.

Relations: leads(id, company_id, first_name, last_name, title, seniority, work_email, email_status,
email_verified, mx_valid, phones, linkedin_url), companies(id, domain, name, ...), logs(url, domain,
status_code, engine_used, scraped_at).  Ties of top-k reports go by the grouping key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.emails import host_of
from gleaner.functions.people import display_name

WELL_FORMED = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# Providers of the audit, and what its suspicious addresses look like.
AUDIT_PROVIDERS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com", "mail.com"]
SUSPICIOUS = r"(@.*@|\.\.|\s|\.(png|jpg|gif|css|js)$)"


def _metric(name: str, value: Column, denominator: Column, passes: Column) -> Column:
    """N/A without anything to count."""
    return F.struct(F.lit(name).alias("metric"), F.when(denominator > 0, F.round(value, 4)).alias("value"), F.when(denominator == 0, "N/A").when(passes, "PASS").otherwise("FAIL").alias("verdict"))


def quality(leads: DataFrame, companies: DataFrame, logs: DataFrame) -> DataFrame:
    """(metric, value, verdict), from one pass over each relation."""
    rows = leads.join(companies.select(F.col("id").alias("company_id"), "domain"), "company_id", "left")
    n = F.count(F.lit(1)).cast("double")
    yes = lambda c: F.count_if(c).cast("double")
    lead = rows.agg(
        n.alias("n"), yes(host_of(F.col("work_email")) == F.col("domain")).alias("own"), yes(~F.col("work_email").rlike(WELL_FORMED)).alias("bad"), yes(host_of(F.col("work_email")).isin(K.FREE_PROVIDERS)).alias("free"),
        yes(F.coalesce(F.array_size("phones"), F.lit(0)) > 0).alias("phone"), yes(F.col("linkedin_url").ilike("%linkedin.com/in/%")).alias("linkedin"), yes(F.coalesce(F.col("title"), F.lit("")) != "").alias("title"),
    )
    company = companies.agg(n.alias("companies"), yes(F.col("domain").isin(list(K.DIRECTORIES))).alias("directories"))
    log = logs.agg(n.alias("logs"), F.countDistinct("url").cast("double").alias("urls"), yes(F.col("status_code").isNotNull()).alias("known"), yes(F.col("status_code").between(200, 399)).alias("ok"))
    one = lead.join(company).join(log)  # one row each
    c = F.col
    share = lambda x, of="n": F.when(c(of) > 0, 100 * c(x) / c(of))
    recrawl = F.when(c("urls") > 0, c("logs") / c("urls"))
    metrics = F.array(
        _metric("own_domain_pct", share("own"), c("n"), share("own") > 80), _metric("malformed_emails", c("bad"), c("n"), c("bad") == 0), _metric("free_mail_pct", share("free"), c("n"), share("free") < 5),
        _metric("phones_pct", share("phone"), c("n"), share("phone") > 50), _metric("personal_linkedin_pct", share("linkedin"), c("n"), share("linkedin") > 80), _metric("directory_companies", c("directories"), c("companies"), c("directories") == 0),
        _metric("title_pct", share("title"), c("n"), share("title") > 60), _metric("recrawl_ratio", recrawl, c("urls"), recrawl <= 1.1), _metric("success_pct", share("ok", "known"), c("known"), share("ok", "known") >= 95),
    )
    return one.select(F.explode(metrics).alias("m")).select("m.*")


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.when(F.count_if(F.col("verdict") == "FAIL") > 0, "FAIL").otherwise("PASS").alias("verdict"))


def formatted(metrics: DataFrame) -> tuple[str, int]:
    """The metrics as a table of text, and the exit code: 1 if one fails.  There are as many rows as metrics."""
    rows = metrics.collect()
    width = max([len(r.metric) for r in rows], default=0)
    lines = [f"{r.metric.ljust(width)}  {'-' if r.value is None else f'{r.value:.2f}':>10}  {r.verdict}" for r in rows]
    code = int(any(r.verdict == "FAIL" for r in rows))
    return "\n".join([*lines, f"{'overall'.ljust(width)}  {'':>10}  {'FAIL' if code else 'PASS'}"]), code


def main(folder: str) -> int:
    """Prints the report over the relations leads, companies and logs in ``folder``."""
    from pyspark.sql import SparkSession

    from gleaner.sources.tables import read

    spark = SparkSession.builder.getOrCreate()
    text, code = formatted(quality(*(read(spark, folder, name) for name in ("leads", "companies", "logs"))))
    print(text)
    return code


def counts(**tables: DataFrame) -> DataFrame:
    """A1, A26."""
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, t in tables.items()))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """A11, A12, A23."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def top(rows: DataFrame, key: Column, name: str, most: int) -> DataFrame:
    """The commonest values."""
    return rows.select(key.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(most)


def mismatches(leads: DataFrame, companies: DataFrame, most: int = 15) -> DataFrame:
    """Leads whose e-mail host doesn't end in their company's domain."""
    c = companies.select(F.col("id").alias("cid"), "domain")
    host = host_of(F.col("work_email"))
    return leads.join(c, (leads["company_id"] == c["cid"]) & ~F.endswith(host, c["domain"])).select("work_email", "domain").orderBy("work_email", "domain").limit(most)


def audit(leads: DataFrame) -> DataFrame:
    """A14, A16, A18, A21 in one pass."""
    return leads.agg(
        F.count_if(F.col("work_email").rlike(SUSPICIOUS)).alias("suspicious"), F.count_if(host_of(F.col("work_email")).isin(AUDIT_PROVIDERS)).alias("free_mail"), F.count_if(F.coalesce(F.array_size("phones"), F.lit(0)) > 0).alias("with_phones"),
        F.count_if(F.col("linkedin_url").isNotNull()).alias("with_linkedin"), F.count_if(F.col("email_verified")).alias("verified"), F.count_if(F.col("mx_valid")).alias("mx_valid"),
    )


def rescraped(logs: DataFrame, most: int = 10) -> DataFrame:
    """A25."""
    return logs.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "url").limit(most)


def failures(logs: DataFrame) -> DataFrame:
    """Answers other than 200; unknown ones don't count."""
    return logs.agg(F.count_if(F.col("status_code") != 200).alias("failed"))


def latest(rows: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """A26, A28."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(most)


def lead_list(leads: DataFrame) -> DataFrame:
    """A27."""
    return leads.select("id", display_name(F.col("first_name"), F.col("last_name")).alias("name"), "work_email")


def stream_progress(queries: list) -> list[dict]:
    """Depth and rate of running streams."""
    return [{"name": q.name, "active": q.isActive, "progress": q.lastProgress} for q in queries]


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1]))
