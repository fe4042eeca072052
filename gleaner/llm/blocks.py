"""Document blocks, and the exchange that lets blocks ask the corpus questions.

Several operators need a corpus-wide fact (a count, "is this repeated?") about millions of tiny
items in every document.  One shuffled row per item would be mostly row overhead, so documents are
taken in blocks of a few megabytes, each block sends its *distinct* items once, packed as sorted
numpy arrays, and the answers come back in the order of the questions:

    docs -> blocks --emit--> (part, block, body) --groupBy(part)--> answers --join on block--> blocks

``part`` is a range of hash values, so an item is always judged in one place.  A block sends a hot
item once however often it occurs there, so one item adds one entry for each block to its part, and
parts are even.  The number of parts follows the input size, but a block never writes more than ``FAN``
messages: beyond that many parts, messages are gathered by coarse range and group of blocks, their
items united, and sent on to the finer ranges; answers come back the same way (``answered``).  So the
rows that are exchanged stay in proportion to the input, with a factor of its logarithm to base FAN.

Blocks are cut by the order of rows within a partition.  ``docs`` must therefore be a deterministic
plan (a table that is read, and row-wise functions of it); its partitions are then the same when a
lost executor's work is done again.  A block's name holds a digest of its content, and an answer
that finds no block of that name raises an error instead of giving a wrong result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.checkpoints import cut_lineage, ensure_checkpoint_dir  # noqa: F401
from gleaner.session import ship

BLOCK_BYTES = 4 << 20
PART_BYTES = 2 << 20
#: Messages that a block writes at most.
FAN = 512
BLOCK_SCHEMA = "block string, body binary"
ANSWER_SCHEMA = "block string, part int, body binary"
MESSAGE_SCHEMA = "part int, block string, body binary"

_U = np.uint64
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_N = [np.uint64(i) for i in range(65)]


# ---------------------------------------------------------------- hashing


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    x = a * _C1
    x ^= x >> _N[31]
    x += b * _C2
    x ^= x >> _N[29]
    x *= _C3
    x ^= x >> _N[32]
    return x


def byte_strings(words: pa.Array) -> list[bytes]:
    """The UTF-8 of strings without nulls."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in byte_strings(words)]), ">u8").astype(np.uint64)


def word_hash_pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in byte_strings(words)]), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive values, built by doubling; one per start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, level, size = None, 0, h, 1
    while True:
        if width & size:
            part = level[at : at + n]
            out = part.copy() if out is None else mix(out, part)
            at += size
        if size * 2 > width:
            return out
        level = mix(level[: len(level) - size], level[size:])
        size *= 2


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The range of hash values that ``h`` is in; grows with ``h``."""
    return (((h >> _N[32]) * np.uint64(parts)) >> _N[32]).astype(np.int64)


def cuts_of(sorted_h: np.ndarray, parts: int) -> np.ndarray:
    """Where each part starts in sorted hash values, with the end."""
    return np.searchsorted(part_of(sorted_h, parts), np.arange(parts + 1))


# ---------------------------------------------------------------- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each as byte planes: a plane of equal bytes costs next to nothing compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Numbers in the smallest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def unpack(body: bytes, *kinds: type | None) -> list[np.ndarray]:
    """The arrays of ``pack``; None for unsigned numbers of the width that they were packed in."""
    count = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 2 * count, 8).reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for (width, n), kind in zip(head.tolist(), kinds, strict=True):
        planes = np.frombuffer(body, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind or f"u{width}").reshape(-1))
        at += width * n
    return out


def deltas(sorted_h: np.ndarray) -> np.ndarray:
    return np.diff(sorted_h, prepend=np.uint64(0))


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


# ---------------------------------------------------------------- blocks


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores if it is one file that makes one partition.

    Only then, as the rows of one partition are dealt out alike whenever that is done again with the same columns;
    many partitions stay where they are.  Rows that are told apart by place get their numbers before this.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if cores > 1 and len(docs.inputFiles()) == 1 and docs.rdd.getNumPartitions() == 1 else docs


def _cut(batches: Iterator[pa.RecordBatch], weight: str, block_bytes: int) -> Iterator[tuple[str, bytes]]:
    """The name of each block of a partition, and its rows as an Arrow stream."""
    pid, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out(rows: list[pa.RecordBatch]) -> tuple[str, bytes]:
        body = to_ipc(pa.Table.from_batches(rows))
        return f"{pid}-{seq}-{xxhash.xxh3_64_hexdigest(body)}", body

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = int(total[begin - 1]) if begin else 0
            end = min(batch.num_rows, max(begin, int(np.searchsorted(total, before + block_bytes - size))) + 1)
            held.append(batch.slice(begin, end - begin))
            size += int(total[end - 1]) - before
            begin = end
            if size >= block_bytes:
                made = out(held)
                seq, held, size = seq + 1, [], 0
                yield made
    if held:
        yield out(held)


def blocks(docs: DataFrame, weight: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: its name and its rows as an Arrow stream.  A row is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, body in _cut(batches, weight, block_bytes):
            yield pa.RecordBatch.from_pydict({"block": [name], "body": pa.array([body], pa.binary())})

    ship(docs.sparkSession)
    return dealt(docs).mapInArrow(run, BLOCK_SCHEMA)


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def tokens(text: pa.ChunkedArray | pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Maximal runs of anything but the six ASCII white-space characters: codes, the distinct words, starts of each text's codes."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[ends]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, starts


def release() -> None:
    """Gives a block's memory back to the system before the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- exchange


def give_back(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of steps that end in checkpoints, which it does once the driver has no use of them and collects its garbage."""
    for _ in range(3):  # what the first collection sets free, the next one finds
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads; by its partitions where Catalyst doesn't know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return total if total < 1 << 53 else df.rdd.getNumPartitions() * (64 << 20)


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """At least so many that a few machines share the work evenly; beyond that as the input grows."""
    return int(min(1 << 30, max(256, plan_bytes(df) // part_bytes)))


def emitted(source: DataFrame, emit: Callable[[str, pa.Table, dict[str, list]], Iterator[tuple[int, bytes]]], answers: tuple[str, ...] = ()) -> DataFrame:
    """Rows (part, block, body) of what ``emit`` gives for each block.  ``answers``: columns of earlier answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, table, got = _block_row(batch, i, answers)
                rows = list(emit(name, table, got))
                del table, got
                release()
                yield from _messages(name, rows)

    return source.mapInArrow(run, MESSAGE_SCHEMA)


def emitted_by_blocks(docs: DataFrame, emit: Callable[[str, pa.Table, dict[str, list]], Iterator[tuple[int, bytes]]], weight: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``emitted`` of the ``blocks`` of ``docs``, by one Python worker of a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, body in _cut(batches, weight, block_bytes):
            rows = list(emit(name, from_ipc(body), {}))
            del body
            release()
            yield from _messages(name, rows)

    ship(docs.sparkSession)
    return dealt(docs).mapInArrow(run, MESSAGE_SCHEMA)


def _messages(name: str, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "block": [name] * len(rows), "body": pa.array([b for _, b in rows], pa.binary())})


@dataclass(frozen=True)
class Questions:
    """What an operator asks the corpus.

    ``reduce``: from the askers and bodies that met in a part, the body of an answer for each asker.
    ``unite``: from several bodies, the sorted hashes of their distinct items, the place of each body's items
    among them, and a function that makes a body of the items between two places.
    ``deal``: from the bodies that answer all distinct items, and those places, the body of an answer for each.
    """

    reduce: Callable[[list[str], list[bytes]], Iterator[tuple[str, bytes]]]
    unite: Callable[[list[bytes]], tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bytes]]]
    deal: Callable[[list[bytes], list[np.ndarray]], Iterator[bytes]]


def fan(parts: int) -> int:
    """The number of ranges that a block sends to."""
    return min(parts, FAN)


def answered(sent: DataFrame, questions: Questions, parts: int, now: int | None = None) -> DataFrame:
    """Answers to what was sent to ``now`` ranges (``fan(parts)`` by default), judged in ``parts`` ranges.

    A row with a part below zero is no question; it's handed on.  Its block must be the only one of that name.
    """
    now = now or fan(parts)
    if now >= parts:
        return _judged(sent, questions)
    sent = cut_lineage(sent)
    finer = min(FAN, -(-parts // now))
    groups = max(1, parts // now // 2)
    unite, deal = questions.unite, questions.deal

    def gather(table: pa.Table) -> pa.Table:
        name = f"{table.column('part')[0].as_py()}:{table.column('of')[0].as_py()}"
        return pa.table({"block": [name], "body": pa.array([to_ipc(table.select(["block", "body"]))], pa.binary())})

    def ask(_: str, table: pa.Table, __: dict) -> Iterator[tuple[int, bytes]]:
        h, _, body = unite(table.column("body").to_pylist())
        at = part_of(h, now * finer)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=False):
            yield int(at[a]), body(a, b)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, table, got = _block_row(batch, i, ("got",))
                _, each, _ = unite(table.column("body").to_pylist())
                made = list(deal([b for _, b in got["got"]], each))
                yield pa.RecordBatch.from_pydict({"block": table.column("block").combine_chunks(), "part": pa.array([int(name.split(":")[0])] * len(made), pa.int32()), "body": pa.array(made, pa.binary())})
                release()

    asked = sent.filter("part >= 0").withColumn("of", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    gathered = cut_lineage(asked.groupBy("part", "of").applyInArrow(gather, BLOCK_SCHEMA))
    inner = cut_lineage(answered(emitted(gathered, ask), questions, parts, now * finer))
    answers = with_answers(gathered, got=inner.filter("block <> ''")).mapInArrow(back, ANSWER_SCHEMA)
    # The block "" is no asker: what a part says to all goes straight up.
    return answers.union(inner.filter("block = ''")).union(sent.filter("part < 0").select("block", "part", "body"))


def _judged(sent: DataFrame, questions: Questions) -> DataFrame:
    reduce = questions.reduce

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        names, bodies = table.column("block").to_pylist(), table.column("body").to_pylist()
        del table
        rows = list(reduce(names, bodies)) if part >= 0 else list(zip(names, bodies, strict=True))
        release()
        return pa.table({"block": pa.array([b for b, _ in rows], pa.string()), "part": pa.array([part] * len(rows), pa.int32()), "body": pa.array([x for _, x in rows], pa.binary())})

    of = F.when(F.col("part") < 0, F.xxhash64("block")).otherwise(F.col("part").cast("long"))
    return sent.withColumn("of", of).groupBy("of", "part").applyInArrow(lambda t: run(t.drop_columns(["of"])), ANSWER_SCHEMA)


def with_answers(source: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with the answers that each got, as a column of (part, body) for every keyword."""
    for name, got in answers.items():
        got = got.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias(name))
        source = source.join(got, "block", "full")
    return source


def mapped(source: DataFrame, work: Callable[[pa.Table, dict[str, list]], pa.Table], schema: str, answers: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``work`` makes of each block and its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, table, got = _block_row(batch, i, answers)
                made = work(table, got)
                del table, got
                yield from made.to_batches(max_chunksize=2000)
                release()

    return source.mapInArrow(run, schema)


def _block_row(batch: pa.RecordBatch, i: int, answers: tuple[str, ...]) -> tuple[str, pa.Table, dict[str, list]]:
    name, body = batch.column("block")[i].as_py(), batch.column("body")[i].as_py()
    if body is None:
        raise RuntimeError(f"block {name} is gone: the documents aren't a deterministic plan; write them as a table first")
    got = {a: sorted(((x["part"], x["body"]) for x in batch.column(a)[i].as_py() or ()), key=lambda x: x[0]) for a in answers}
    return name, from_ipc(body), got
