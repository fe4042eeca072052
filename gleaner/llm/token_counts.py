"""Token counts of a byte-level BPE without token ids.

A byte-level BPE splits a text into pre-tokens and encodes each alone, so a text's token count is the
sum over its pre-tokens of the pre-token's own count.  Every block of documents sends each distinct
pre-token once, by hash range.  Where all blocks' copies of a pre-token meet, it is encoded once, and
its count goes back to the blocks that asked; there it is joined to the per-document frequencies, which
travel by block.  No ids are kept and no text is shuffled, and a pre-token that every document holds
weighs one entry for each block.  A block's messages keep to a fixed number however large
the input; beyond it they are routed in steps (``blocks.answered``).

Defined cases: a null text is empty and has no tokens; ``<|endoftext|>``-like added tokens inside a
text count as one token each, as is the library's default; repeated rows are counted each; other
columns are ignored, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gleaner.llm.blocks import BLOCK_BYTES, Questions, answered, cuts_of, dealt, fan, pack, parts_for, release, unpack
from gleaner.session import ship

#: Pre-tokens beyond this length go to the library through their own call.
BATCH = 20_000


def _ranges(kind: str) -> str:
    """The code points of a general category, or of a group of them, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(kind)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, with its Unicode classes spelled out for ``re``."""
    letters, numbers = _ranges("L"), _ranges("N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


@functools.cache
def added_tokens(path: str) -> re.Pattern | None:
    with open(path, encoding="utf-8") as f:
        found = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


@functools.cache
def encoder(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a pre-token is ordinary text
    return t


@functools.cache
def unassigned() -> re.Pattern:
    """Code points that Python's Unicode tables don't know; the library's newer ones may."""
    return re.compile(f"[{_ranges('Cn')}]")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pretokens(text: str, path: str) -> tuple[Counter, int]:
    """Frequencies of a text's pre-tokens, and tokens counted besides: added tokens, or all of a text with unassigned code points."""
    if not latin(text) and unassigned().search(text):
        return Counter(), len(whole(path).encode(text, add_special_tokens=False))
    special = added_tokens(path)
    if special is None or not special.search(text):
        return Counter(splitter().findall(text)), 0
    pieces = special.split(text)
    return sum((Counter(splitter().findall(p)) for p in pieces), Counter()), len(pieces) - 1


@functools.cache
def whole(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def piece_counts(words: list[str], path: str) -> np.ndarray:
    t, out = encoder(path), []
    for i in range(0, len(words), BATCH):
        out += [len(e) for e in t.encode_batch_fast(words[i : i + BATCH], add_special_tokens=False)]
    return np.array(out, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``path``: a tokenizers file of a byte-level BPE."""
    ship(docs.sparkSession)
    parts = parts_for(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Part -1 has a block's documents and their frequencies; the others have its pre-tokens, by hash."""
        pid, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group, begin = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES, 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(group, group[begin], "right"))
                part = batch.slice(begin, end - begin)
                yield _sent(f"{pid}-{seq}", part.column(0), part.column(1).to_pylist(), sizes[begin:end])
                seq, begin = seq + 1, end
                release()

    def _sent(block: str, ids: pa.Array, texts: list[str | None], sizes: np.ndarray) -> pa.RecordBatch:
        codes: dict[str, int] = {}
        known, which, often, specials = codes.setdefault, [], [], []
        for text in texts:
            counts, special = pretokens(text or "", path)
            which.append(np.fromiter((known(w, len(codes)) for w in counts), np.int64, len(counts)))
            often.append(np.fromiter(counts.values(), np.int64, len(counts)))
            specials.append(special)
        raw = [w.encode() for w in codes]
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in raw), np.uint64, len(raw))
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(raw), np.int64)
        rank[order] = np.arange(len(raw))
        cuts = cuts_of(h[order], fan(parts))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = [raw[i] for i in order[cuts[p] : cuts[p + 1]].tolist()]
            rows.append((p, pack(np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own], np.uint32))))
        # A document's pre-tokens in rising order, as steps, which are small numbers.
        held = [np.argsort(rank[w]) for w in which]
        steps = [np.diff(rank[w][o], prepend=0) for w, o in zip(which, held, strict=True)]
        freq = [f[o] for f, o in zip(often, held, strict=True)]
        flat = lambda x: np.concatenate(x or [np.empty(0, np.int64)]).astype(np.uint32)
        head = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.array(sizes, np.int64), np.array(specials, np.int64), np.array([len(w) for w in which], np.uint32), flat(steps), flat(freq))
        return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows] + [-1], pa.int32()), "block": [block] * (len(rows) + 1), "body": pa.array([b for _, b in rows] + [head], pa.binary())})

    def reduce(blocks_: list[str], bodies: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """The number of pieces of every pre-token, in the order of each question."""
        codes: dict[bytes, int] = {}
        each = []
        for body in bodies:
            raw, lengths = unpack(body, np.uint8, np.uint32)
            ends, data = np.cumsum(lengths).tolist(), raw.tobytes()
            each.append(np.array([codes.setdefault(data[a:b], len(codes)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
        counted = piece_counts([w.decode() for w in codes], path)
        for block, words in zip(blocks_, each, strict=True):
            yield block, pack(counted[words].astype(np.uint32))

    def total(table: pa.Table) -> pa.Table:
        """Counts joined to frequencies and summed by document."""
        rows = sorted(zip(table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda x: x[0])
        if rows[0][0] >= 0:
            raise RuntimeError("a block is gone: the documents aren't a deterministic plan; write them as a table first")
        ids, null, sizes, specials, n, steps, freq = unpack(rows[0][1], np.int64, np.uint8, np.int64, np.int64, np.uint32, np.uint32, np.uint32)
        counts = np.concatenate([unpack(b, np.uint32)[0] for _, b in rows[1:]] or [np.empty(0, np.uint32)]).astype(np.int64)
        doc, sums = np.repeat(np.arange(len(n)), n), np.cumsum(steps, dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        before = np.concatenate([[0], sums])[begin]
        tokens = np.bincount(doc, counts[sums - before[doc]] * freq, len(n)).astype(np.int64) + specials
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "n_bytes": sizes, "n_tokens": tokens, "over_limit": tokens > limit})

    sent = dealt(rows).mapInArrow(frequencies, "part int, block string, body binary")
    return answered(sent, Questions(reduce, _united, _dealt), parts).groupBy("block").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _united(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bytes]]:
    """Each distinct pre-token of several questions, by hash."""
    codes: dict[bytes, int] = {}
    each = []
    for body in bodies:
        raw, lengths = unpack(body, np.uint8, np.uint32)
        ends, data = np.cumsum(lengths).tolist(), raw.tobytes()
        each.append(np.array([codes.setdefault(data[a:b], len(codes)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
    words = list(codes)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))

    def body(a: int, b: int) -> bytes:
        own = [words[i] for i in order[a:b].tolist()]
        return pack(np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own], np.uint32))

    return h[order], [rank[e] for e in each], body


def _dealt(bodies: list[bytes], each: list[np.ndarray]) -> Iterator[bytes]:
    counts = np.concatenate([unpack(b, np.uint32)[0] for b in bodies])
    for at in each:
        yield pack(counts[at])
