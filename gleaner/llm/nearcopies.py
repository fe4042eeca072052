"""Near copies by the Jaccard similarity of word shingles: SimHash, pigeonring, and what these can't reach.

SimHashes of the shingle sets that differ in at most three bits are found by the pigeonring filter of
``simhash``; the similarity itself is computed from the whole sets.  That alone isn't the whole job: texts of
similarity 0.8 differ in ten of 64 bits on average, and a radius that holds nearly all of them is beyond what exact
segment keys can look up.  So classes that the pigeonring made are finished on keys of min-hashes:

1. Texts with one shingle set collapse to one node, which has a SimHash, and ``BANDS`` keys of ``ROWS`` min-hashes
   with a sketch, one byte of each min-hash.  A pair of similarity s shares no key with probability
   (1 - s^ROWS)^BANDS: 3e-6 at 0.8, and less above.
2. Nodes of one SimHash are held against the smallest of them, and those against each other along the links that the
   pigeonring gives.  Whole sets decide; the links make the first classes.
3. Every node is held against one more, the node among its keys that shares most keys with others, unless it is in
   that node's class.  These links and the first ones make classes that take in most of a large group.
4. Keys whose nodes aren't all in one class yet get the whole shingle sets of their nodes, and every pair
   that isn't linked already is compared.  A task gives a spanning forest of its links, never all pairs.  A key
   of more than ``HOT`` nodes is dealt out as pairs of chunks, so no task takes a whole group and no pair is lost.

In steps 2 and 3 the sketch turns a pair away first if fewer than ``LEAST`` of its bytes agree, and the pigeonring gives
a spanning forest of which an edge may be turned away; nothing is lost by either, as step 4 asks neither.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a shingle has:
the whole sequence; no words or a null text: the empty set, equal to itself and unlike any other; very long
texts are read whole; of equal doc_ids the first row counts; an empty table stays empty; columns keep their
names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.blocks import cut_lineage, dealt, give_back, mix, parts_for, release, tokens, window_hashes, word_hashes
from gleaner.llm.graph import components
from gleaner.session import ship

BANDS, ROWS = 42, 6
#: Share of a sketch's bytes that must agree in steps 2 and 3.
LEAST = 0.7
#: Nodes of a key that a task takes whole, and a chunk of more.
HOT, CHUNK = 1024, 512
#: Texts taken at once, and about their bytes.
STEP, STEP_BYTES = 200, 1 << 20

_RANDOM = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def stepped(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most STEP rows, each of about STEP_BYTES of text or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (i - start >= STEP or held + n > STEP_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shingles(text: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, words, starts = tokens(text, lower=True)
    h = word_hashes(words)[codes] if len(words) else np.empty(0, np.uint64)
    windows = window_hashes(h, width)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out.append(np.unique(windows[a : b - width + 1]) if b - a >= width else window_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def band_keys(sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The keys of each set and its sketch; none of an empty one."""
    full = [s for s in sets if len(s)]
    if not full:
        return [np.empty(0, np.int64)] * len(sets), [None] * len(sets)
    flat = np.concatenate(full)
    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
    least = np.stack([np.minimum.reduceat((flat ^ x) * t, starts) for x, t in zip(_XOR, _TIMES, strict=True)], axis=1)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
    for k in range(ROWS):
        keys = mix(keys, least[:, k::ROWS])
    # The lowest bits of a product are poor; the middle ones are kept.
    made, sketch = iter(keys.view(np.int64)), iter((least >> np.uint64(24)).astype(np.uint8))
    return [next(made) if len(s) else np.empty(0, np.int64) for s in sets], [next(sketch).tobytes() if len(s) else None for s in sets]


def _nodes(slim: DataFrame, width: int) -> DataFrame:
    """(_row, doc_id, node, print, keys, sketch) of (_row, doc_id, text); the empty set has no print."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stepped(batch, 2):
                sets = shingles(part.column(2), width)
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prints = np.array([simhash.folded(s) for s in sets], np.uint64).view(np.int64)
                keys, sketch = band_keys(sets)
                empty = np.array([not len(s) for s in sets], bool)
                release()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array(prints, mask=empty), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["_row", "doc_id", "node", "print", "keys", "sketch"])

    return slim.mapInArrow(make, "_row long, doc_id long, node long, print long, keys array<long>, sketch binary")


def _ringed(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of one SimHash, and nodes whose SimHashes the pigeonring links."""
    first = cut_lineage(nodes.filter("print is not null").groupBy("print").agg(F.min("node").alias("least")))
    same = nodes.join(first, "print").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = cut_lineage(simhash.links(first.select(F.col("print").alias("p"))))
    a, b = (first.select(F.col("print").alias(f"print_{x}"), F.col("least").alias(x)) for x in "ab")
    return same.union(found.toDF("print_a", "print_b").join(a, "print_a").join(b, "print_b").select("a", "b"))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _verified(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: distinct nodes) whose whole shingle sets are similar; sketches are compared first."""
    bits = nodes.select("node", "row", "sketch")
    a, b = (bits.select(F.col("node").alias(x), F.col("row").alias(f"row_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sketches(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b", "row_a", "row_b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST if batch.num_rows else np.empty(0, bool)))

    likely = cut_lineage(pairs.join(a, "a").join(b, "b").select("a", "b", "row_a", "row_b", "sketch_a", "sketch_b").mapInArrow(near, "a long, b long, row_a long, row_b long"))
    wanted = likely.select(F.col("row_a").alias("_row")).union(likely.select("row_b")).distinct()
    texts = cut_lineage(slim.select("_row", "text").join(wanted, "_row"))
    both = likely.join(texts.select(F.col("_row").alias("row_a"), F.col("text").alias("text_a")), "row_a").join(texts.select(F.col("_row").alias("row_b"), F.col("text").alias("text_b")), "row_b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stepped(batch, 2):
                x, y = shingles(part.column(2), width), shingles(part.column(3), width)
                yield part.select(["a", "b"]).filter(pa.array([alike(p, q, similarity) for p, q in zip(x, y, strict=True)], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _forest(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between (or within, if they are equal) two groups of sets, enough to join what they link to what is joined by ``label``."""
    within = left is right
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label, out, mark = np.unique(label, return_inverse=True)[1], [], np.zeros(len(names), bool)
    for i in left.tolist():
        others = right[right > i] if within else right
        others = others[(label[others] != label[i]) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9)]
        if not len(others):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        total = np.concatenate([[0], np.cumsum(mark[flat])])
        mark[own] = False
        common = total[ends[others]] - total[ends[others] - size[others]]
        for j in others[common >= similarity * (size[others] + size[i] - common) - 1e-9].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _across(keyed: DataFrame, labels: DataFrame, nodes: DataFrame, slim: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links between nodes that share a key and are in different components."""
    placed = keyed.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    open_ = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).filter("x <> y")
    open_ = open_.select("key", F.when(F.col("n") > HOT, F.ceil(F.col("n") / CHUNK).cast("int")).alias("chunks"))
    rows = cut_lineage(placed.join(open_, "key").withColumn("of", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).otherwise(F.lit(0))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stepped(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingles(part.column(1), width)], pa.binary())], names=["node", "body"])

    wanted = nodes.select("node", "row").join(rows.select("node").distinct(), "node")
    sets = slim.join(wanted, slim["_row"] == wanted["row"]).select("node", "text").mapInArrow(add, "node long, body binary")
    spread = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.join(sets, "node").withColumn("with", F.explode(spread)).withColumn("lo", F.least("of", "with")).withColumn("hi", F.greatest("of", "with"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts_for(keyed, 1 << 17))).cast("int"))

    def pairs(table: pa.Table) -> pa.Table:
        node, key, label, of, lo, hi = (table.column(c).to_numpy() for c in ("node", "key", "label", "of", "lo", "hi"))
        bodies = table.column("body").combine_chunks()
        order = np.lexsort((node, hi, lo, key))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)]))
        a, b = [], []
        for at in np.split(order, new[1:]):
            sets = [np.frombuffer(bodies[int(i)].as_buffer(), np.uint64) for i in at]
            left = np.flatnonzero(of[at] == lo[at[0]])
            right = left if lo[at[0]] == hi[at[0]] else np.flatnonzero(of[at] == hi[at[0]])
            for i, j in _forest(sets, label[at], left, right, similarity):
                a.append(int(node[at[i]]))
                b.append(int(node[at[j]]))
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("part", "node", "key", "label", "of", "lo", "hi", "body").groupBy("part").applyInArrow(pairs, "a long, b long")


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b): each node b of ``keyed`` (node, key, n: the key's nodes) with the node a of its keys whose keys have most nodes in all."""
    weight = keyed.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = keyed.select("node", "key").join(weight, "node")
    hubs = rows.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    best = rows.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub"))
    return best.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).filter("a <> b")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose nodes ``labels`` (node, root) doesn't put into one class."""
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group that links of at least ``similarity`` connect: the one with the smallest doc_id, and of rows that repeat that id the first.

    All columns stay.  Rows are told apart by their place in ``docs``, which must be a deterministic plan.
    """
    ship(docs.sparkSession)
    names = docs.columns
    # Own names, so that no column of the caller's can clash.
    placed = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    slim = placed.select("_row", F.col(f"_c{names.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"_c{names.index('text')}").cast("string").alias("text"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    nodes = cut_lineage(_nodes(dealt(slim), width).groupBy("node").agg(F.min(first).alias("first"), F.min("_row").alias("row"), F.first("print").alias("print"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    near = cut_lineage(_verified(_ringed(nodes), nodes, slim, width, similarity))
    classes = components(near)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    keyed = cut_lineage(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    give_back(docs)
    links = cut_lineage(near.union(_verified(_between(_stars(keyed), classes), nodes, slim, width, similarity)))
    roots = components(links.union(_across(keyed.select("node", "key"), components(links), nodes, slim, width, similarity)))
    joined = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return placed.join(keep, "_row", "left_semi").select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))
