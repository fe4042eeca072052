"""Reading and writing: tables, configuration, logs, dumps."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions import web

log = logging.getLogger(__name__)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relation(spark: SparkSession, source: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A relation of a database (``jdbc:...``, whose driver is on the class path) or of a folder of Parquet.

    With a numeric ``key`` and its ``bounds`` the database is read in ``partitions`` slices of the key; rows beyond
    the bounds come with the outer slices.  Filters and columns are pushed to the database.
    """
    if not source.startswith("jdbc:"):
        return read(spark, source, name)
    reader = spark.read.format("jdbc").option("url", source).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def replace_relation(rows: DataFrame, target: str, name: str, **options: str) -> None:
    """A merged snapshot into a database, whose table keeps its definition, or as Parquet."""
    if target.startswith("jdbc:"):
        rows.write.format("jdbc").option("url", target).option("dbtable", name).option("truncate", "true").options(**options).mode("overwrite").save()
    else:
        rows.write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def json_config(path: str | Path) -> dict:
    """A JSON object; nothing, with a warning, if it can't be read."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        log.warning("configuration %s can't be read: %s", path, e)
        return {}
    return found if isinstance(found, dict) else {}


def signatures(raw: dict) -> dict[str, tuple[str, list[str]]]:
    """Technology signatures from either form: a list of patterns, or a category with patterns."""
    return {name: (s.get("category") or "Detected Stack", list(map(str, s.get("patterns", [])))) if isinstance(s, dict) else ("Detected Stack", list(map(str, s))) for name, s in raw.items() if isinstance(s, dict | list)}


def setting_list(spark: SparkSession, name: str, default: list[str]) -> list[str]:
    """A comma-separated session setting ``spark.gleaner.<name>``."""
    value = spark.conf.get(f"spark.gleaner.{name}", None)
    return default if value is None else [v.strip() for v in value.split(",") if v.strip()]


@dataclass(frozen=True)
class Settings:
    """What a deployment sets, as ``spark.gleaner.<name>``; lists are comma-separated."""

    directory_domains: tuple[str, ...] = tuple(K.DIRECTORIES)
    blocked_paths: tuple[str, ...] = tuple(K.BLOCKED_PATHS)
    ignored_params: tuple[str, ...] = tuple(K.IGNORED_PARAMS)
    cooldown_days: int = 7
    rate_seconds: float = 3.0
    most_links: int = 15

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {}
        for f in fields(cls):
            if isinstance(f.default, tuple):
                given[f.name] = tuple(setting_list(spark, f.name, list(f.default)))
            elif (value := spark.conf.get(f"spark.gleaner.{f.name}", None)) is not None:
                given[f.name] = type(f.default)(value)
        return cls(**given)


def find_one(rows: DataFrame, **key: object) -> DataFrame:
    """The row of a key, or none; of several the smallest by all columns that can be ordered."""
    for column, value in key.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy(*(c for c, kind in rows.dtypes if not kind.startswith("map"))).limit(1)


def dump_pages(pages: DataFrame, path: str) -> None:
    """Raw HTML under the dump's file names, by day.  Rows of a table, not files: one for each page would be too many."""
    rows = pages.filter(F.coalesce(F.col("html"), F.lit("")) != "").select(web.dump_name(F.col("url")).alias("file"), "url", "html", F.to_date("fetched_at").alias("day"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """An append-only log, by day."""
    rows.withColumn("day", F.to_date("scraped_at")).write.mode("append").partitionBy("day").parquet(path)


def as_json_lines(df: DataFrame, name: str) -> DataFrame:
    """A table's rows as JSON, every value as text."""
    return df.select(F.lit(name).alias("relation"), F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))).alias("row"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A merged snapshot, written to a new place and read back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


DIRECTORY_DOMAINS = list(K.DIRECTORIES)
