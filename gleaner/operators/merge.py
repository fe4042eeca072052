"""Keyed merges: a new snapshot from the old one and a batch.  ``seq`` orders the batch; the old rows come first.

Repeated keys within a batch are merged in one pass by associative aggregates, so a batch of any size
needs one shuffle on the key, and the result doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.people import merged_phones

LEAD_SOFT = ["first_name", "last_name", "title", "seniority", "department", "linkedin_url", "source_platform"]
LEAD_HARD = ["company_id", "email_status", "email_verified", "mx_valid", "disposable_flag"]


def _last(column: str, seq: str, keep: Column | None = None) -> Column:
    """The value of the highest seq, of those that count."""
    return F.max_by(F.when(keep, F.struct(F.col(column).alias("v"))) if keep is not None else F.struct(F.col(column).alias("v")), F.when(keep, F.col(seq)) if keep is not None else F.col(seq))["v"].alias(column)


def _stacked(old: DataFrame | None, batch: DataFrame, seq: str) -> DataFrame:
    return batch if old is None else old.withColumn(seq, F.lit(None).cast("long")).unionByName(batch, allowMissingColumns=True)


def merged_maps(rows: DataFrame, key: str, column: str, seq: str) -> DataFrame:
    """(key, column): entries of all maps, of equal names the last."""
    entries = rows.select(key, seq, F.explode(column).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", seq).alias("v"))
    return entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def upsert_companies(old: DataFrame | None, batch: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Companies by domain, a new value replaces an old one unless it is null; metadata entries merge.

    An id that a company has stays; a new one follows from its domain.  Any other column of the old snapshot or
    of the batch is kept too, the last known value of it.  Returns the snapshot and the rejected rows: a
    directory's own domain is no company.
    """
    bad = F.col("domain").isNull() | F.col("domain").isin(list(K.DIRECTORIES))
    rows = _stacked(old, batch.filter(~bad), seq).withColumn(seq, F.coalesce(seq, F.lit(-1).cast("long")))
    maps = [c for c, kind in rows.dtypes if kind.startswith("map")]
    plain = [c for c in rows.columns if c not in ("domain", "id", seq, *maps)]
    out = rows.groupBy("domain").agg(*(_last(c, seq, F.col(c).isNotNull()) for c in plain), *([F.min_by(F.when(F.col("id").isNotNull(), F.col("id")), F.when(F.col("id").isNotNull(), F.col(seq))).alias("id")] if "id" in rows.columns else []))
    for column in maps:
        out = out.join(merged_maps(rows, "domain", column, seq), "domain", "left")
    own = F.sha2(F.col("domain"), 256)
    return out.withColumn("id", F.coalesce("id", own) if "id" in rows.columns else own), batch.filter(bad)


def insert_technologies(old: DataFrame | None, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """(company_id, tech_name) keeps its first row; a category defaults to Detected Stack."""
    new = batch.groupBy("company_id", "tech_name").agg(F.coalesce(F.min_by("category", seq), F.lit("Detected Stack")).alias("category"))
    if old is None:
        return new
    return old.select("company_id", "tech_name", "category").unionByName(new.join(old, ["company_id", "tech_name"], "left_anti"))


def upsert_leads(old: DataFrame | None, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Leads by e-mail: some fields only if they say something, some always, phones merged (first five), verified_at if known.

    A lead's first row is taken as it is, so a field that never says anything has what it had there.  Any other
    column is kept too, the last known value of it.
    """
    rows = _stacked(old, batch, seq).withColumn(seq, F.coalesce(seq, F.lit(-1).cast("long")))
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v")), seq)["v"]
    soft = [F.coalesce(_last(c, seq, F.coalesce(F.col(c), F.lit("")) != ""), first(c)).alias(c) for c in LEAD_SOFT if c in rows.columns]
    others = [_last(c, seq, F.col(c).isNotNull()) for c in rows.columns if c not in ("work_email", seq, "phones", "email_verified_at", *LEAD_SOFT, *LEAD_HARD)]
    hard = [_last(c, seq) for c in LEAD_HARD if c in rows.columns]
    known = [_last("email_verified_at", seq, F.col("email_verified_at").isNotNull())] if "email_verified_at" in rows.columns else []
    out = rows.groupBy("work_email").agg(*soft, *hard, *known, *others)
    if "phones" in rows.columns:
        each = rows.select("work_email", seq, F.posexplode("phones").alias("pos", "phone"))
        each = each.withColumn("key", F.regexp_replace("phone.number", r"\D", "")).filter(F.length("key") >= 10)
        first = each.groupBy("work_email", "key").agg(F.min(F.struct(F.col(seq).alias("s"), "pos", "phone")).alias("first"))
        ranked = first.withColumn("n", F.expr("row_number() over (partition by work_email order by first.s, first.pos, key)")).filter("n <= 5")
        phones = ranked.groupBy("work_email").agg(F.array_sort(F.collect_list(F.struct("n", "first.phone"))).alias("found"))
        none = F.array().cast("array<struct<number:string,type:string>>")
        out = out.join(phones.select("work_email", merged_phones(none, F.transform("found", lambda x: x["phone"])).alias("phones")), "work_email", "left").withColumn("phones", F.coalesce("phones", none))
    return out


def purge_duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """U4: of equal keys the row with the highest ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def delete_companies(companies: DataFrame, domains: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Companies without those in ``domains``; children (by company_id) whose company stays."""
    kept = companies.join(domains.select("domain"), "domain", "left_anti")
    return kept, *(c.join(kept.select(F.col("id").alias("company_id")), "company_id", "left_semi") for c in children)


def emptied(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """All tables without rows."""
    return tuple(t.limit(0) for t in tables)
