"""Removal of repeated passages by recompression.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window that also
starts elsewhere is removed.  Recompression makes long repeats cheap to find.  Words are symbols;
a first step names each run of one word, and each of the following rounds names adjacent pairs
(a, b), where a hash bit of the round puts a on the left and b on the right side.  A name is a hash
of what it stands for, so all tasks give the same names to the same content without asking each
other.  Whether symbols join depends on themselves and their neighbours only, so every symbol knows
the stretch of words that decides its existence: wherever these words occur, the symbol occurs.

Round 1 on the cluster counts the highest symbols: one that occurs once proves that every window
around its stretch is unique.  Round 2 verifies: windows that no unique symbol rules out are
compared by a 128-bit hash of their words over the whole corpus.  No window is missed, as a window
without any decisive symbol is always compared.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has no words; texts under a
window lose nothing; repeated rows are other occurrences, so a long document and its copy are both
removed whole; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gleaner.llm.blocks import Questions, answered, blocks, byte_strings, cut_lineage, cuts_of, deltas, emitted, emitted_by_blocks, fan, mapped, mix, pack, parts_for, tokens, undeltas, unpack, window_hashes, with_answers, word_hash_pairs

WINDOW = 35
#: Pair rounds, and the words that a symbol may stand for at most.
ROUNDS, LONGEST = 7, 14
_U = np.uint64


def parse(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of word hashes: names, and the stretch [low, high) of words that decides each.

    ``doc``: the document of each word; symbols don't reach over its end.
    """
    n = len(h)
    if not n:
        return h, np.empty(0, np.int64), np.empty(0, np.int64)
    # Runs of one word.
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.append(first, n))
    name, of = mix(h[first], size.astype(_U)), doc[first]
    start, end = first, first + size
    # A run is what it is as its neighbours differ; a text's edge is no evidence, so the stretch goes over it and no window holds it.
    low, high = start - 1, end + 1
    for r in range(rounds):
        side = (mix(name, np.full(len(name), r + 1, _U)) >> _U(63)).astype(bool)  # True: left
        same = of[1:] == of[:-1]
        join = side[:-1] & ~side[1:] & same & ((end[1:] - start[:-1]) <= LONGEST)
        head, tail = np.append(join, False), np.concatenate([[False], join])
        # A symbol that stays has seen its right neighbour (if left) or its left one (if right).
        right_high = np.append(np.where(same, high[1:], end[:-1] + 1), end[-1] + 1)
        left_low = np.concatenate([[start[0] - 1], np.where(same, low[:-1], start[1:] - 1)])
        high2 = np.where(side & ~head, np.maximum(high, right_high), high)
        low2 = np.where(~side & ~tail, np.minimum(low, left_low), low)
        at = np.flatnonzero(head)
        name = name.copy()
        name[at] = mix(name[at], name[at + 1])
        high2[at], low2[at] = np.maximum(high[at + 1], high[at]), np.minimum(low[at], low[at + 1])
        end = end.copy()
        end[at] = end[at + 1]
        keep = ~tail
        name, of, start, end, low, high = name[keep], of[keep], start[keep], end[keep], low2[keep], high2[keep]
    return name, low, high


def _words(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, words, starts = tokens(table.column("text"), lower=False)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    one, two = word_hash_pairs(words)
    return codes, words, starts, doc, one[codes], two[codes]


def _symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that can rule out a window."""
    name, low, high = parse(h, doc)
    short = high - low <= WINDOW
    return name[short], low[short], high[short]


def _window_starts(starts: np.ndarray) -> np.ndarray:
    """True where a window starts in its document."""
    ok = np.zeros(int(starts[-1]), bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= WINDOW:
            ok[a : b - WINDOW + 1] = True
    return ok


def _ask_symbols(parts: int):
    def emit(_: str, table: pa.Table, __: dict) -> Iterator[tuple[int, bytes]]:
        *_, doc, h, _h2 = _words(table)
        name, _, _ = _symbols(h, doc)
        names, counts = np.unique(name, return_counts=True)
        cuts = cuts_of(names, fan(parts))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            yield p, pack(deltas(names[a:b]), np.packbits(counts[a:b] > 1))

    return emit


def _shared_symbols(blocks_: list[str], bodies: list[bytes]) -> Iterator[tuple[str, bytes]]:
    got = [unpack(b, _U, np.uint8) for b in bodies]
    names = [undeltas(d) for d, _ in got]
    twice = [np.unpackbits(bits, count=len(n)).astype(bool) for n, (_, bits) in zip(names, got, strict=True)]
    every = np.sort(np.concatenate(names + [n[t] for n, t in zip(names, twice, strict=True)]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    for block, n in zip(blocks_, names, strict=True):
        yield block, pack(np.packbits(np.isin(n, shared, assume_unique=True)), np.array([len(n)], np.uint32))


def _united_symbols(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bytes]]:
    got = [unpack(b, _U, np.uint8) for b in bodies]
    names = [undeltas(d) for d, _ in got]
    every, at = np.unique(np.concatenate(names), return_inverse=True)
    twice = np.concatenate([np.unpackbits(bits, count=len(n)) for n, (_, bits) in zip(names, got, strict=True)])
    shared = (np.bincount(at) > 1) | (np.bincount(at, twice) > 0)
    return every, np.split(at, np.cumsum([len(n) for n in names])[:-1]), lambda a, b: pack(deltas(every[a:b]), np.packbits(shared[a:b]))


def _dealt(bodies: list[bytes], each: list[np.ndarray]) -> Iterator[bytes]:
    flags = np.concatenate([np.unpackbits(x, count=int(n[0])) for x, n in (unpack(b, np.uint8, np.uint32) for b in bodies)])
    for at in each:
        yield pack(np.packbits(flags[at]), np.array([len(at)], np.uint32))


def _candidates(starts: np.ndarray, doc: np.ndarray, h: np.ndarray, shared: list[tuple[int, bytes]]) -> np.ndarray:
    """Starts of the windows that no unique symbol rules out."""
    name, low, high = _symbols(h, doc)
    names, inverse = np.unique(name, return_inverse=True)
    bits = [unpack(b, np.uint8, np.uint32) for _, b in shared]
    flags = np.concatenate([np.unpackbits(x, count=int(n[0])) for x, n in bits] or [np.empty(0, np.uint8)]).astype(bool)
    if len(flags) != len(names):
        raise RuntimeError("answers don't fit the block")
    unique = ~flags[inverse]
    ruled = np.zeros(len(h) + 1, np.int64)
    a, b = np.maximum(high[unique] - WINDOW, 0), low[unique]
    ok = a <= b
    np.add.at(ruled, a[ok], 1)
    np.add.at(ruled, b[ok] + 1, -1)
    return np.flatnonzero((np.cumsum(ruled)[:-1] == 0) & _window_starts(starts))


def _ask_windows(parts: int):
    def emit(_: str, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        _, _, starts, doc, h, h2 = _words(table)
        at = _candidates(starts, doc, h, got["symbols"])
        if not len(at):
            return
        one, two = window_hashes(h, WINDOW)[at], window_hashes(h2, WINDOW)[at]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        twice = np.diff(np.append(new, len(one))) > 1
        one, two = one[new], two[new]
        cuts = cuts_of(one, fan(parts))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            yield p, pack(deltas(one[a:b]), two[a:b], np.packbits(twice[a:b]))

    return emit


def _shared_windows(blocks_: list[str], bodies: list[bytes]) -> Iterator[tuple[str, bytes]]:
    got = [unpack(b, _U, _U, np.uint8) for b in bodies]
    one, two = np.concatenate([undeltas(d) for d, _, _ in got]), np.concatenate([t for _, t, _ in got])
    twice = np.concatenate([np.unpackbits(bits, count=len(t)) for _, t, bits in got]).astype(bool)
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    group = np.empty(len(one), np.int64)
    group[order] = np.cumsum(new) - 1
    shared = ((np.bincount(group) > 1) | (np.bincount(group, twice) > 0))[group]
    end = np.cumsum([len(t) for _, t, _ in got])
    for block, a, b in zip(blocks_, [0, *end[:-1]], end, strict=True):
        yield block, pack(np.packbits(shared[a:b]), np.array([b - a], np.uint32))


def _united_windows(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bytes]]:
    got = [unpack(b, _U, _U, np.uint8) for b in bodies]
    one, two = np.concatenate([undeltas(d) for d, _, _ in got]), np.concatenate([t for _, t, _ in got])
    twice = np.concatenate([np.unpackbits(bits, count=len(t)) for _, t, bits in got])
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
    at = np.empty(len(one), np.int64)
    at[order] = np.cumsum(new) - 1
    shared = (np.bincount(at) > 1) | (np.bincount(at, twice) > 0)
    one, two = one[order][new], two[order][new]
    return one, np.split(at, np.cumsum([len(t) for _, t, _ in got])[:-1]), lambda a, b: pack(deltas(one[a:b]), two[a:b], np.packbits(shared[a:b]))


def _removed(table: pa.Table, got: dict) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes, words, starts, and which words go."""
    codes, words, starts, doc, h, h2 = _words(table)
    at = _candidates(starts, doc, h, got["symbols"])
    gone = np.zeros(len(codes) + 1, np.int64)
    if len(at):
        one, two = window_hashes(h, WINDOW)[at], window_hashes(h2, WINDOW)[at]
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        bits = [unpack(b, np.uint8, np.uint32) for _, b in got["windows"]]
        flags = np.concatenate([np.unpackbits(x, count=int(n[0])) for x, n in bits]).astype(bool)
        if len(flags) != int(new.sum()):
            raise RuntimeError("answers don't fit the block")
        hit = at[flags[group]]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
    return codes, words, starts, np.cumsum(gone)[:-1] > 0


def _answered_blocks(docs: DataFrame) -> DataFrame:
    parts = parts_for(docs)
    rows = blocks(docs)
    symbols = cut_lineage(answered(emitted_by_blocks(docs, _ask_symbols(parts)), Questions(_shared_symbols, _united_symbols, _dealt), parts))
    windows = answered(emitted(with_answers(rows, symbols=symbols), _ask_windows(parts), ("symbols",)), Questions(_shared_windows, _united_windows, _dealt), parts)
    return with_answers(rows, symbols=symbols, windows=windows)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and the removed stretches of words, as [start, end) pairs, of every document."""

    def work(table: pa.Table, got: dict) -> pa.Table:
        _, _, starts, gone = _removed(table, got)
        spans = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
            spans.append(edge.reshape(-1, 2).tolist())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(starts), pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(LongType())))])
    return mapped(_answered_blocks(rows), work, schema, ("symbols", "windows"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def work(table: pa.Table, got: dict) -> pa.Table:
        codes, words, starts, gone = _removed(table, got)
        n, lost, sha = np.diff(starts), [], []
        for (kept, removed) in _kept(codes, words, starts, gone):
            lost.append(removed)
            sha.append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return mapped(_answered_blocks(rows), work, "doc_id long, n_words long, n_removed long, kept_sha256 string", ("symbols", "windows"))


def _kept(codes: np.ndarray, words: pa.Array, starts: np.ndarray, gone: np.ndarray) -> Iterator[tuple[bytes, int]]:
    raw = np.array(byte_strings(words) + [b""], object)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        keep = codes[a:b][~gone[a:b]]
        yield b" ".join(raw[keep].tolist()), b - a - len(keep)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``.

    A text that loses nothing stays as it is; another becomes its kept words joined by one space.  A
    column ``n_chars`` follows the text.  All other columns, whatever they are called, stay.
    """
    names = docs.columns
    follows = "n_chars" in names

    def work(table: pa.Table, got: dict) -> pa.Table:
        codes, words, starts, gone = _removed(table, got)
        old = table.column("text").to_pylist()
        new = [kept.decode() if lost else before for before, (kept, lost) in zip(old, _kept(codes, words, starts, gone), strict=True)]
        table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        if follows:
            at = table.schema.get_field_index("n_chars")
            lengths = [n if x is y else len(x) for x, y, n in zip(new, old, table.column("n_chars").to_pylist(), strict=True)]
            table = table.set_column(at, "n_chars", pa.array(lengths, table.schema.field(at).type))
        return table

    return mapped(_answered_blocks(docs), work, docs.schema, ("symbols", "windows")).select(*names)


