"""Stable sharding by weighted rendezvous hashing.  DataFrame functions only.

Every (record key, shard) pair has a fixed score; a record goes to the shard with the highest.  A
new shard can only win records for itself, so growing from n to n + 1 moves about 1/(n + 1) of the
rows, all of them into the new shard.  With weights w the score is w / -ln(u), u uniform in (0, 1)
by the pair's hash, which gives each shard a share in proportion to its weight.

Defined cases: a null key is a key of its own; equal keys share a shard; a null text has size 1
(no bytes, plus one) and the CRC of the empty text; an empty table gives an empty result; other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows aimed at in a numbering cell, and the fewest cells of a shard.
CELL_ROWS, LEAST_CELLS = 20_000, 256
#: Copies of a row that are told out at once.
COPIES = 65_536


def shard_of(key: Column, weights: Sequence[float], seed: int = 1) -> Column:
    """The shard, 0 to len(weights) - 1, that a key belongs to."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), _text(key)).cast("binary"))
        uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        scores.append(F.struct((F.lit(float(weight)) / -F.ln(uniform)).alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], into: str = "shard", seed: int = 1) -> DataFrame:
    """``df`` with its shard in the column ``into``; a projection, no shuffle."""
    return df.withColumn(into, shard_of(df[key], weights, seed))


def number_slots(df: DataFrame, shard: str, key: str, into: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in the order of md5(key), then of all columns.

    A shard can hold any share of the rows, so it isn't sorted in one task.  Rows are counted by
    (shard, cell) first, a cell being a range of digests; running totals of these few counts give
    each cell its first number, and rows are numbered within cells.  More cells give the same
    numbers.  Rows equal in every column are numbered as one group, so copies can't fill a cell.
    """
    names = df.columns
    rows = df.toDF(*(f"_c{i}" for i in range(len(names))))
    s, k = f"_c{names.index(shard)}", f"_c{names.index(key)}"
    rest = [c for c in rows.columns if c not in (s, k)]
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    cells = max(LEAST_CELLS, -(-df.count() // CELL_ROWS))
    rows = rows.withColumn("_digest", F.md5(_text(F.col(k)).cast("binary")))
    rows = rows.withColumn("_cell", F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / float(1 << 32) * cells).cast("int"))
    counts = rows.groupBy(s, "_cell").agg(F.sum("_n").alias("_rows"))
    first = counts.selectExpr(f"{s} as _s", "_cell as _at", f"coalesce(sum(_rows) over (partition by {s} order by _cell rows between unbounded preceding and 1 preceding), 0) as _first")
    within = f"coalesce(sum(_n) over (partition by {s}, _cell order by {', '.join(['_digest', k, *rest])} rows between unbounded preceding and 1 preceding), 0)"
    rows = rows.withColumn("_within", F.expr(within)).drop("_digest")
    rows = rows.join(first, rows[s].eqNullSafe(first["_s"]) & (rows["_cell"] == first["_at"]))
    # Copies are told out in two steps, so that arrays stay small.
    rows = rows.withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {COPIES}L)")))
    rows = rows.withColumn("_copy", F.explode(F.expr(f"sequence(_from, least(_n, _from + {COPIES}) - 1)")))
    return rows.select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)), (F.col("_first") + F.col("_within") + F.col("_copy")).alias(into))


def shard_documents(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) of every document."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(docs["doc_id"], weights).cast("int").alias("shard"),
        shard_of(docs["doc_id"], [*weights, sum(weights) / len(weights)]).cast("int").alias("grown_shard"),
    )
    return number_slots(rows, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

