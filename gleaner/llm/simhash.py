"""SimHash near-duplicate groups with a pigeonring filter.

A fingerprint of 64 bits is a ring of eight segments of eight bits.  If two fingerprints differ in at
most three bits, there is a segment from which every run of consecutive segments, of length l,
differs in at most floor(3 l / 8) bits (the strong form of the pigeonring principle): 0, 0, 1, 1, 1,
2, 2, 3.  So from some start the first two segments are equal, and the next three differ in one bit
at most, hence one half of their 24 bits is equal.  That gives 16 exact keys of 28 bits for each
distinct fingerprint; pairs that meet on a key are checked for the whole chain and only then for
their full Hamming distance.

Copies collapse before this: a fingerprint takes part once, however many documents have it.  A key
that gathers more than ``HOT`` fingerprints is dealt out as pairs of chunks, so its work is spread
and no pair is lost.  A task gives a spanning forest of its links, never all pairs.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles of three words,
repeats counted; fewer words: the whole sequence; none or a null text: fingerprint zero, linked like
any other.  A null doc_id is never a component's name unless all its members' are null.  Very long texts
are read whole; repeated rows are members each; an empty table gives an empty result; other columns are
carried along under their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.llm.blocks import cut_lineage, dealt, parts_for
from gleaner.llm.graph import components
from gleaner.session import ship

WIDTH, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 8
#: Fingerprints with one key that a task takes whole, and a chunk of more.
HOT, CHUNK = 4096, 2048
#: Shingles whose bits are added up at once.
STEP = 1 << 16


def simhash(text: str | None) -> int:
    """Bit b is one if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return folded(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), ">u8"))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes."""
    raw = hashes.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), STEP):
        ones += np.unpackbits(raw[i : i + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_print``, of which it has none: the fingerprint as a signed long."""
    ship(docs.sparkSession)
    names = docs.columns
    rows = dealt(docs.toDF(*(f"_c{i}" for i in range(len(names)))))
    at = names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((simhash(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, "_print"])

    schema = StructType([*rows.schema.fields, StructField("_print", LongType())])
    out = rows.mapInArrow(add, schema)
    return out.toDF(*names, "_print")


def _keys(p: Column) -> Column:
    """(key) of every start and half; the start and half are part of it."""
    out = []
    for start in range(SEGMENTS):
        turn = 8 * start
        ring = F.shiftleft(p, turn).bitwiseOR(F.shiftrightunsigned(p, 64 - turn)) if turn else p
        for half in range(2):
            kept = F.shiftrightunsigned(ring, 48) * (1 << 12) + F.shiftrightunsigned(ring, 36 - 12 * half).bitwiseAND(F.lit((1 << 12) - 1).cast("long"))
            out.append(kept.bitwiseOR(F.lit((start * 2 + half) << 28).cast("long")))
    return F.array(*out)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (column p) within three bits, enough to connect all that are linked."""
    ship(prints.sparkSession)
    parts = max(512, parts_for(prints, 1 << 18))
    keyed = prints.select("p", F.explode(_keys(F.col("p"))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = keyed.join(hot, "key", "left").withColumn("of", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("p"), F.col("chunks")).cast("int")).otherwise(F.lit(0)))
    spread = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("with", F.explode(spread)).withColumn("lo", F.least("of", "with")).withColumn("hi", F.greatest("of", "with"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts)).cast("int"))

    def pairs(table: pa.Table) -> pa.Table:
        p, key, of, lo, hi = (table.column(c).to_numpy() for c in ("p", "key", "of", "lo", "hi"))
        order = np.lexsort((of, hi, lo, key))
        p, key, of, lo, hi = (x[order] for x in (p, key, of, lo, hi))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)]))
        ends = np.append(new[1:], len(p))
        made = [np.empty((0, 2), np.int64)]
        several = ends - new > 1
        for a, b in zip(new[several].tolist(), ends[several].tolist(), strict=True):
            made.append(_forest(p[a:b].view(np.uint64), of[a:b], int(lo[a]), int(hi[a]), int(key[a] >> 29)))
        found = np.unique(np.concatenate(made), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.select("part", "p", "key", "of", "lo", "hi").groupBy("part").applyInArrow(pairs, "a long, b long").distinct()


#: Bits allowed in a chain of so many segments.
BUDGET = [DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _forest(p: np.ndarray, of: np.ndarray, lo: int, hi: int, start: int) -> np.ndarray:
    """Spanning forest of the links between (or within) the chunks ``lo`` and ``hi``."""
    left = np.flatnonzero(of == lo)
    right = left if lo == hi else np.flatnonzero(of == hi)
    root = np.arange(len(p))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    shift = np.uint64(8 * start)
    turned = (p << shift) | (p >> np.uint64(64 - 8 * start)) if start else p
    for i in left.tolist():
        others = right[right > i] if lo == hi else right
        diff = turned[others] ^ turned[i]
        for n, budget in enumerate(BUDGET[:-1], 1):  # the chain, segment by segment
            keep = np.bitwise_count(diff >> np.uint64(64 - 8 * n)) <= budget
            others, diff = others[keep], diff[keep]
            if not len(others):
                break
        near = others[np.bitwise_count(diff) <= DISTANCE]
        for j in near.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((p[i], p[j]))
    return np.array(out, np.uint64).reshape(-1, 2).view(np.int64)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links lead to) of every document."""
    rows = cut_lineage(fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))).drop("text"))
    named = classes(rows)
    out = rows.join(named, "_print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def classes(rows: DataFrame) -> DataFrame:
    """(_print, component_id) of every fingerprint in ``rows`` (doc_id, _print)."""
    groups = cut_lineage(rows.groupBy("_print").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups.select(F.col("_print").alias("p"))))
    joined = groups.join(roots, groups["_print"] == roots["node"], "left").withColumn("root", F.coalesce("root", "_print"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(smallest, "root").select("_print", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, and of rows that repeat that id the first.

    All columns stay.  Rows are told apart by their place in ``docs``, which must be a deterministic plan.
    """
    names = docs.columns
    placed = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    slim = placed.select("_row", F.col(f"_c{names.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"_c{names.index('text')}").cast("string").alias("text"))
    slim = cut_lineage(fingerprints(slim).drop("text"))
    first = slim.join(classes(slim), "_print").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # All members of a class of null ids have its name, so such a class is named by its fingerprint too.
    keep = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("_print"))).agg(F.min("_row").alias("_row")).select("_row")
    return placed.join(keep, "_row", "left_semi").select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))
