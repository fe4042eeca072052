"""Deliverability verdicts from observed mail-server answers.  Nothing here talks to a server.

Inputs: mx_lookup(domain, mx_records, lookup_error), smtp_probe(email, mx_rank, rcpt_code,
catch_all_probe_code, error), catch_all_cache(domain, is_catch_all).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import emails as E

VERIFIED, CATCH_ALL, UNVERIFIED, INVALID, DISPOSABLE = "verified", "catch_all", "unverified", "invalid", "disposable"
MOST_HOSTS, MOST_PERSONS, MOST_CANDIDATES = 2, 10, 3


#: Hours that an answer about mail servers holds, and that a domain rests after none of its servers could be reached.
MX_HOURS, REST_HOURS = 24, 1


def current_mx(observed: DataFrame, now: Column) -> DataFrame:
    """mx_lookup(domain, mx_records, lookup_error) from what was observed (those columns and observed_at).

    A domain's latest answer of the last MX_HOURS counts; that there are no servers is an answer, an outage isn't.
    """
    fresh = observed.filter(F.col("lookup_error").isNull() & (F.col("observed_at") > now - F.make_interval(hours=F.lit(MX_HOURS))) & (F.col("observed_at") <= now))
    plain = F.transform(F.coalesce("mx_records", F.array().cast("array<string>")), lambda h: F.regexp_replace(h, r"\.+$", ""))
    rows = fresh.select(F.lower(F.trim("domain")).alias("domain"), plain.alias("mx_records"), "observed_at")
    return rows.groupBy("domain").agg(F.max_by("mx_records", F.struct("observed_at", "mx_records")).alias("mx_records")).withColumn("lookup_error", F.lit(None).cast("string"))


def resting(probes: DataFrame, now: Column) -> DataFrame:
    """Domains that aren't to be asked now, as an e-mail of theirs found none of the first servers in the last hour.

    probes: those of ``verify`` with observed_at.
    """
    late = probes.filter((F.col("observed_at") > now - F.make_interval(hours=F.lit(REST_HOURS))) & (F.col("observed_at") <= now) & (F.col("mx_rank") <= MOST_HOSTS))
    return late.groupBy("email").agg(F.bool_and(F.col("error").isNotNull()).alias("failed")).filter("failed").select(E.host_of(F.lower(F.trim("email"))).alias("domain")).distinct()


def preflight(email: Column, mx_records: Column) -> Column:
    """A verdict without asking a server, or null."""
    return F.when(~E.valid_syntax(email), INVALID).when(E.disposable(email), DISPOSABLE).when(F.coalesce(F.array_size(mx_records), F.lit(0)) == 0, INVALID)


def server_verdict(code: Column, probe: Column, known: Column) -> Column:
    """E13 for the first server that answered."""
    refused = lambda c: (c >= 500) & (c < 600)
    accepted = F.when(known, CATCH_ALL).when(~known, VERIFIED).when(probe == 250, CATCH_ALL).when(refused(probe), VERIFIED).otherwise(UNVERIFIED)
    return F.when(code == 250, accepted).when(refused(code), INVALID).otherwise(UNVERIFIED)


def verify(emails: DataFrame, mx_lookup: DataFrame, smtp_probe: DataFrame, catch_all: DataFrame) -> DataFrame:
    """A verdict for each distinct, non-empty e-mail."""
    rows = emails.select(F.lower(F.trim("email")).alias("email")).filter("email <> ''").distinct().withColumn("domain", E.host_of(F.col("email")))
    first = smtp_probe.filter(F.col("error").isNull() & (F.col("mx_rank") <= MOST_HOSTS)).groupBy("email").agg(F.min_by(F.struct("rcpt_code", "catch_all_probe_code"), "mx_rank").alias("answer"))
    asked = smtp_probe.select("email").distinct().withColumn("asked", F.lit(True))
    rows = rows.join(mx_lookup.select("domain", "mx_records"), "domain", "left").join(first, "email", "left").join(asked, "email", "left").join(catch_all.select("domain", F.col("is_catch_all").alias("known")), "domain", "left")
    early = preflight(F.col("email"), F.col("mx_records"))
    late = F.when(F.col("answer").isNull(), UNVERIFIED).otherwise(server_verdict(F.col("answer.rcpt_code"), F.col("answer.catch_all_probe_code"), F.col("known")))
    status = F.coalesce(early, late)
    return rows.select(
        "email", "domain", E.valid_syntax(F.col("email")).alias("is_valid_syntax"), (F.coalesce(F.array_size("mx_records"), F.lit(0)) > 0).alias("has_mx_records"), E.disposable(F.col("email")).alias("is_disposable"),
        (status == VERIFIED).alias("is_deliverable"), status.alias("status"), (status == CATCH_ALL).alias("is_catch_all"), (early.isNull() & F.col("asked").isNotNull()).alias("smtp_checked"),
        F.when(early.isNull() & F.col("asked").isNull(), "smtp_skipped").alias("error_message"),
    )


def apply_verdicts(leads: DataFrame, verdicts: DataFrame, now: Column, platform: str) -> DataFrame:
    """Leads with their verdicts; leads without one keep what they have."""
    v = verdicts.select(F.col("email").alias("work_email"), "status", "has_mx_records", "is_disposable", "smtp_checked")
    rows = leads.drop("email_status", "email_verified", "mx_valid", "disposable_flag", "source_platform").join(v, "work_email", "left")
    return rows.withColumns({
        "email_status": F.coalesce("status", F.lit(UNVERIFIED)), "email_verified": F.coalesce(F.col("status") == VERIFIED, F.lit(False)), "mx_valid": F.coalesce("has_mx_records", F.lit(False)), "disposable_flag": F.coalesce("is_disposable", F.lit(False)),
        "email_verified_at": F.when(F.col("smtp_checked"), now), "source_platform": F.lit(platform),
    }).drop("status", "has_mx_records", "is_disposable", "smtp_checked")


def infer_people(persons: DataFrame, verdicts: DataFrame, known: DataFrame) -> DataFrame:
    """For each of a page's first people the first candidate that can be delivered and isn't taken.

    persons(page, pos, first_name, last_name, candidate_emails); a chosen e-mail is taken for the
    people after.  A page has few people, so the ordered fold runs page by page.
    """
    rows = persons.filter(F.col("pos") < MOST_PERSONS).select("page", "pos", "first_name", "last_name", F.posexplode(F.slice("candidate_emails", 1, MOST_CANDIDATES)).alias("n", "email"))
    good = verdicts.filter(F.col("status").isin(VERIFIED, CATCH_ALL)).select("email", "status")
    rows = rows.join(good, "email").join(known.select("email").distinct(), "email", "left_anti")

    def choose(page: pd.DataFrame) -> pd.DataFrame:
        taken, done, out = set(), set(), []
        for r in page.sort_values(["pos", "n"]).itertuples(index=False):
            if r.pos not in done and r.email not in taken:
                done.add(r.pos)
                taken.add(r.email)
                out.append((r.page, r.pos, r.first_name, r.last_name, r.email, r.status))
        return pd.DataFrame(out, columns=["page", "pos", "first_name", "last_name", "work_email", "email_status"])

    return rows.groupBy("page").applyInPandas(choose, "page string, pos int, first_name string, last_name string, work_email string, email_status string")


def legacy_status(disposable: Column, verified: Column, mx: Column) -> Column:
    """A status from old flags."""
    return F.when(disposable, DISPOSABLE).when(verified & mx, VERIFIED).when(~mx, INVALID).otherwise(UNVERIFIED)


