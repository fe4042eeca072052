"""One-permutation MinHash fingerprints with optimal densification.  DataFrame functions only.

Every shingle of five words is hashed once.  The hash's high bits name one of ``bins`` bins and the
smallest hash of each bin represents it.  An empty bin borrows from a bin that isn't: it looks up
the bins of a pseudo-random sequence that belongs to it alone and takes the first that holds
something, so two documents borrow alike exactly as often as their sets are alike (densification by
independent 2-universal probes).  The lowest ``BITS`` bits of each bin's hash are kept, packed.  Two
different minima agree in those bits with probability 1 / 2**BITS, which ``likeness`` corrects for.

All work on a text happens in its own row, in the JVM; nothing is exploded.

The next document is found by ids alone: rows are ordered by (doc_id, a hash of the text, their place) in ranges
of that whole key, so neither a repeated id nor a large table makes a range grow.  Only then does each text's
beginning travel to the document before it.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; fewer than five words: the whole
sequence is the only shingle; no word or a null text: the hash of the empty sequence, so empty texts
are like each other and unlike all others.  Equal texts have equal fingerprints.  Documents follow
each other by doc_id, nulls first, then by a hash of the text; rows equal in both are alike, and follow each
other.  Very long texts are read whole; an empty table gives an empty result; other columns are ignored,
whatever their names.  ``docs`` must be a deterministic plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.blocks import cut_lineage, dealt

#: Bins (a multiple of 16) and bits kept of each: 128 * 4 bits = 64 bytes, 128 hex digits.
BINS, BITS, WIDTH = 128, 4, 5
#: Probes unrolled before an empty bin ranks all bins that hold something, which gives the same law.
PROBES = 6
#: Rows aimed at in a range of the order.
RANGE_ROWS = 200_000

_SPACE = r"[\x20\x09-\x0D]+"


def _probe(j: int, t: int, bins: int) -> int:
    """The t-th bin that an empty bin j looks up: a 2-universal hash of j for every t."""
    prime = (1 << 61) - 1
    a, b = pow(48271, 3 * t + 2, prime), pow(69621, 5 * t + 1, prime)
    return ((a * (j + 1) + b) % prime) % bins


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column) -> Column:
    """A hash of each shingle, in order.  Words are hashed once; pairs, fours and fives are hashes of hashes."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), _SPACE)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def fives(h: Column) -> Column:
        n = F.size(h)
        two = both(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1))
        four = _let(two, lambda t: both(F.slice(t, 1, n - 3), F.slice(t, 3, n - 3)))
        return both(F.slice(four, F.lit(1), n - 4), F.slice(h, F.lit(WIDTH), n - 4))

    return _let(words, lambda w: F.when(F.size(w) < WIDTH, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), fives)))


def densified(hashes: Column, bins: int = BINS) -> Column:
    """``bins`` hashes: of each bin the smallest, or what it borrows; hashed once more with the bin's number, so that bins which borrow alike don't repeat the same low bits."""
    low_bits = 64 - (bins.bit_length() - 1)
    full = (1 << low_bits) - 1
    # A mark, the largest hash that it can hold, is added for every bin, so that each has a smallest.
    marks = [((b << low_bits) | full) - (1 << 64 if b >= bins // 2 else 0) for b in range(bins)]
    # Sorted as signed numbers, a bin's hashes are still together and its smallest comes first.
    ordered = F.sort_array(F.concat(hashes, _longs(marks)))
    changes = lambda s: F.concat(F.slice(s, 1, 1), F.array_compact(F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda h, before: F.when(F.shiftrightunsigned(h.bitwiseXOR(before), low_bits) != 0, h))))
    lowest = _let(ordered, changes)
    tables = [F.array(*(F.lit(_probe(j, t, bins)) for j in range(bins))) for t in range(PROBES)]

    def fill(dense: Column) -> Column:
        # The rare rest: every bin that holds something is ranked by a hash of both bins' numbers.
        rank = lambda j: F.array_min(F.transform(dense, lambda h, b: F.when(h.isNotNull(), F.struct(F.xxhash64(j, b).alias("rank"), h.alias("hash")))))["hash"]
        return F.transform(dense, lambda h, j: F.xxhash64(j, F.coalesce(h, *(F.get(dense, F.get(t, j)) for t in tables), rank(j))))

    return _let(F.transform(lowest, lambda h: F.when(h.bitwiseAND(F.lit(full)) != F.lit(full), h)), fill)


def packed(values: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Low-order bits as an array of 64-bit words."""
    per = 64 // bits
    mask = (1 << bits) - 1
    return _let(values, lambda v: F.array(*(F.aggregate(F.slice(v, w * per + 1, per), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, bits).bitwiseOR(x.bitwiseAND(F.lit(mask).cast("long")))) for w in range(bins // per))))


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text, array<long>."""
    return packed(densified(shingle_hashes(text)))


def as_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1, corrected for chance agreement."""
    ones = sum(1 << (bits * i) for i in range(64 // bits))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d
        for k in range(1, bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(ones).cast("long"))).cast("int")

    different = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, n: acc + n)
    agree, chance = 1.0 - different / float(bins), 1.0 / (1 << bits)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (agree - chance) / (1.0 - chance)))


def before_each(rows: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """``carry`` of every row of ``rows`` (with ``order``, ascending, nulls first, which is unique), with ``before_<c>``: what the row before it has (before the first comes the last)."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(ranges, *(F.asc_nulls_first(c) for c in order)) if ranges > 1 else rows
    ranged = cut_lineage(ranged.withColumn("range", F.spark_partition_id() if ranges > 1 else F.lit(0)))
    within = Window.partitionBy("range").orderBy(*(F.asc_nulls_first(c) for c in order))
    # A few numbers for each range: what its last row has.  Structs compare by their fields, nulls first.
    ends = ranged.groupBy("range").agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in carry))).alias("end"))
    over = Window.orderBy("range")
    ends = ends.select("range", F.coalesce(F.lag("end").over(over), F.last("end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    held = ranged.withColumn("held", F.lag(F.struct(*carry)).over(within)).join(ends, "range")
    return held.select(*carry, *(F.when(F.col("held").isNull(), F.col(f"end._{c}")).otherwise(F.col(f"held.{c}")).alias(f"before_{c}") for c in carry))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values)).cast("array<bigint>")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the start of the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("id", F.monotonically_increasing_id())
    half = lambda text: F.floor(F.char_length(text) / 2).cast("int")
    order = before_each(base.select("doc_id", F.xxhash64("text").alias("tie"), "id", half(F.col("text")).alias("half")), ["doc_id", "tie", "id"], ["id", "half"])
    # Both sides of the join below start from this shuffle; they take the same columns, so that it is done once.
    rows = dealt(base).withColumn("print", fingerprint(F.col("text"))).join(order.drop("half"), "id")
    begins = rows.select(F.col("before_id").alias("id"), F.col("doc_id").alias("next_doc_id"), F.substring("text", F.lit(1), F.col("before_half")).alias("begin"), F.col("print").alias("next_print"))
    rows = rows.select("id", "doc_id", "text", "print").join(begins, "id")
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half(F.col("text"))), "begin"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", "next_doc_id", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    # What follows reads the edited fingerprint three times: it is bound once.
    three = _let(F.col("edited_print"), lambda e: F.struct(as_hex(e).alias("hex"), likeness(F.col("print"), e).alias("near")))
    rows = rows.withColumn("edited", three)
    return rows.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("print")).alias("fingerprint"), F.col("edited.hex").alias("edited_fingerprint"), F.col("edited.near").alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"), "next_doc_id")
