"""Language-model scores from a weighted backoff automaton.

The model is a trigram model with Dirichlet smoothing, each order over the next lower one:

    P1(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P2(w|v)  = (c(v w) + K2 P1(w)) / (c(v) + K2)
    P3(w|uv) = (c(u v w) + K3 P2(w|v)) / (c(u v) + K3)    if c(u v) >= HISTORY, else P2(w|v)

which sums to one over all words and the unknown word after any history.  As an automaton, the n-grams
that occur in training texts are states: the root, a state for each word v and one for each pair u v that
occurs HISTORY times or more.  A state has an arc for every word seen after it, weighing log P, that leads to the longest pair or word at
the end of what was read; the root has an arc for every word.  A word without an arc takes the failure
arc, weighing log (K / (c + K)), to the state of the shorter history, and so on to the root.  A text is
read once from left to right from the state of an end, carrying the state and adding up what the arcs
weigh.  Wherever a word's arc is found, it leads to the longest state that ends in that word; so the state
carried over each word is known beforehand, and all words of a block take their arcs, or their failure
arcs, in one sweep for each order (``Automaton.read``).  The end of a text is a token.

The automaton grows with the corpus and is never gathered in one place.  Each block of documents gets the
counts of its own n-grams and builds the part of the automaton that its texts can reach.  A first
exchange counts words and pairs, by the hash of the whole pair, so that a frequent word's pairs are spread
over all parts; a second counts the triples whose first pair is a state and whose last pair occurs.  Items
are told apart by 55 bits of hash: of 10^10 distinct n-grams some 1,400 are taken for another, of 10^12 one in
70,000.

Defined cases: A-Z are lower-cased; tokens are ``[^\\x20\\x09-\\x0D]+`` and one end; a null or empty
text is its end alone; with no training document at all every token has the unknown word's
probability, one; repeated rows count each; very long texts are read whole (a row is one block then); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import Questions, answered, blocks, cut_lineage, cuts_of, deltas, emitted, fan, give_back, mapped, mix, narrow, pack, parts_for, tokens, undeltas, unpack, with_answers, word_hashes

#: Strength of the next lower order, in tokens.
K2, K3 = 500.0, 10.0
#: Training occurrences of a pair that is a state.
HISTORY = 2
FOLDS, HELD_OUT = 5, 1
_U = np.uint64
#: Bits of a hash that are kept, and the bit that tells pairs and triples from words.  The lowest byte is zero, which packs to nothing.
_KEPT, _LONG = _U(0xFFFF_FFFF_FFFF_FE00), _U(0x100)
#: No token holds white space, so this can't be one.
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class _Block:
    """A block's tokens as words and pairs, the distinct ones sorted by hash."""

    def __init__(self, table: pa.Table) -> None:
        codes, words, starts = tokens(table.column("text"), lower=True)
        self.ids = table.column("doc_id")
        self.held = np.array([fold(i) == HELD_OUT for i in self.ids.to_pylist()], bool)
        self.docs, end = len(starts) - 1, len(words)
        self.size = np.diff(starts) + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        to = np.empty(int(self.size.sum()), np.int64)
        last = self.first + self.size - 1
        inner = np.ones(len(to), bool)
        inner[last] = False
        to[inner], to[last] = codes, end
        hashes = np.append(word_hashes(words), _END) & _KEPT
        self.train = np.repeat(~self.held, self.size)
        self.words, place = np.unique(hashes, return_inverse=True)
        self.w = place[to]
        # The state before a text's first token is that of an end.
        before = np.concatenate([[end], to[:-1]])
        self.v = place[before]
        self.pair_of = mix(hashes[before], hashes[to]) & _KEPT | _LONG
        self.pairs, self.pair = np.unique(self.pair_of, return_inverse=True)
        self.word_counts = np.bincount(self.w[self.train], minlength=len(self.words))
        self.pair_counts = np.bincount(self.pair[self.train], minlength=len(self.pairs))

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of tokens with two before them (an end counts) in their text, their triple, the distinct triples' hashes, and their training counts."""
        full = np.ones(len(self.w), bool)
        full[self.first] = False
        at = np.flatnonzero(full)
        names, triple = np.unique(mix(self.pair_of[at - 1], self.words[self.w[at]]) & _KEPT | _LONG, return_inverse=True)
        return at, triple, names, np.bincount(triple[self.train[at]], minlength=len(names))

    def asked(self, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """``triples``, with which of them can have an arc, by the counts of pairs."""
        at, triple, names, own = self.triples()
        asked = np.empty(len(names), bool)
        asked[triple] = (counts[self.pair[at - 1]] >= HISTORY) & (counts[self.pair[at]] > 0)
        return at, triple, names, own, asked


def _sent(h: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    cuts = cuts_of(h, fan(parts))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[p]), int(cuts[p + 1])
        yield p, pack(deltas(h[a:b]), narrow(counts[a:b]))


def _ask_pairs(parts: int) -> Callable:
    def emit(_: str, table: pa.Table, __: dict) -> Iterator[tuple[int, bytes]]:
        b = _Block(table)
        h = np.concatenate([b.words, b.pairs])
        order = np.argsort(h)
        yield from _sent(h[order], np.concatenate([b.word_counts, b.pair_counts])[order], parts)

    return emit


def _pair_counts(b: _Block, got: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words and of its pairs over all training texts."""
    counts = np.concatenate([unpack(x, None)[0] for _, x in got] or [np.empty(0, np.uint8)]).astype(np.int64)
    if len(counts) != len(b.words) + len(b.pairs):
        raise RuntimeError("answers don't fit the block")
    order = np.argsort(np.concatenate([b.words, b.pairs]))
    out = np.empty(len(counts), np.int64)
    out[order] = counts
    return out[: len(b.words)], out[len(b.words) :]


def _ask_triples(parts: int) -> Callable:
    def emit(_: str, table: pa.Table, got: dict) -> Iterator[tuple[int, bytes]]:
        b = _Block(table)
        _, _, names, own, asked = b.asked(_pair_counts(b, got["pairs"])[1])
        yield from _sent(names[asked], own[asked], parts)

    return emit


def _united(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bytes]]:
    h, each, total = _summed(bodies)
    return h, each, lambda a, b: pack(deltas(h[a:b]), narrow(total[a:b]))


def _summed(bodies: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    got = [unpack(b, _U, None) for b in bodies]
    h, at = np.unique(np.concatenate([undeltas(d) for d, _ in got]), return_inverse=True)
    total = np.bincount(at, np.concatenate([n for _, n in got]), len(h)).astype(np.int64)
    return h, np.split(at, np.cumsum([len(d) for d, _ in got])[:-1]), total


def _counted(blocks_: list[str], bodies: list[bytes]) -> Iterator[tuple[str, bytes]]:
    """The sum of all blocks' counts of each item.  The block "" has the part's share of N and V."""
    h, each, total = _summed(bodies)
    words = total[(h & _LONG) == 0]
    if len(words):
        yield "", pack(np.array([words.sum(), (words > 0).sum()], np.int64))
    for block, at in zip(blocks_, each, strict=True):
        yield block, pack(narrow(total[at]))


def _dealt(bodies: list[bytes], each: list[np.ndarray]) -> Iterator[bytes]:
    counts = np.concatenate([unpack(b, None)[0].astype(np.int64) for b in bodies])
    for at in each:
        yield pack(narrow(counts[at]))


_COUNTS = Questions(_counted, _united, _dealt)


class Automaton:
    """The part of the automaton that a block's texts can reach: log-weights of the arcs of the root, of words and of pairs, and of failure arcs."""

    def __init__(self, b: _Block, one: np.ndarray, two: np.ndarray, got: list[tuple[int, bytes]], total: int, distinct: int, k2: float, k3: float) -> None:
        self.at, self.triple, names, _, asked = b.asked(two)
        answers = np.concatenate([unpack(x, None)[0] for _, x in got] or [np.empty(0, np.uint8)]).astype(np.int64)
        if len(answers) != int(asked.sum()):
            raise RuntimeError("answers don't fit the block")
        three = np.zeros(len(names), np.int64)
        three[asked] = answers
        self.b, self.one, self.two, self.three = b, one, two, three
        root = (one + 0.5) / (total + 0.5 * (distinct + 1))
        v, w = np.empty(len(two), np.int64), np.empty(len(two), np.int64)
        v[b.pair], w[b.pair] = b.v, b.w
        p2 = (two + k2 * root[w]) / (one[v] + k2)
        first, last = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        first[self.triple], last[self.triple] = b.pair[self.at - 1], b.pair[self.at]
        p3 = (three + k3 * p2[last]) / (two[first] + k3)
        self.root, self.arc2, self.arc3 = np.log10(root), np.log10(p2), np.log10(p3)
        self.fail2, self.fail3 = np.log10(k2 / (one + k2)), np.log10(k3 / (two + k3))

    def read(self) -> np.ndarray:
        """What each word of the block adds to its text's log-probability, from the state that the words before it lead to."""
        b, out = self.b, np.zeros(len(self.b.w))
        # In a pair's state: its arc, or the failure arc to the last word's state.
        deep = self.two[b.pair[self.at - 1]] >= HISTORY
        at, triple = self.at[deep], self.triple[deep]
        found = self.three[triple] > 0
        out[at] = np.where(found, self.arc3[triple], self.fail3[b.pair[at - 1]])
        todo = np.ones(len(out), bool)
        todo[at[found]] = False
        # In a word's state, which those words have that occur: its arc, or the failure arc to the root.
        at = np.flatnonzero(todo & (self.one[b.v] > 0))
        found = self.two[b.pair[at]] > 0
        out[at] += np.where(found, self.arc2[b.pair[at]], self.fail2[b.v[at]])
        todo[at[found]] = False
        # At the root, where every word has an arc.
        out[todo] += self.root[b.w[todo]]
        return out


def score_documents(docs: DataFrame, k2: float = K2, k3: float = K3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; logarithms to base 10."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts, rows = parts_for(docs), blocks(rows)
    pairs = cut_lineage(answered(emitted(rows, _ask_pairs(parts)), _COUNTS, parts))
    # N and V: a pair of numbers from each part, summed as rows.
    sums = pairs.filter("block = ''").mapInArrow(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    total, distinct = (int(x or 0) for x in sums)
    pairs = pairs.filter("block <> ''")
    give_back(docs)  # the questions about pairs, the largest part of what is shuffled
    triples = answered(emitted(with_answers(rows, pairs=pairs), _ask_triples(parts), ("pairs",)), _COUNTS, parts).filter("block <> ''")

    def work(table: pa.Table, got: dict) -> pa.Table:
        b = _Block(table)
        one, two = _pair_counts(b, got["pairs"])
        automaton = Automaton(b, one, two, got["triples"], total, distinct, k2, k3)
        by_doc = lambda x: np.add.reduceat(x, b.first) if b.docs else np.empty(0)
        return pa.table({
            "doc_id": b.ids, "held_out": pa.array(b.held), "n_tokens": pa.array(b.size, pa.int64()), "n_known": pa.array(by_doc((one[b.w] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(b.docs, total), pa.int64()), "base_score": by_doc(automaton.root[b.w]), "score": by_doc(automaton.read()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return mapped(with_answers(rows, pairs=pairs, triples=triples), work, schema, ("pairs", "triples"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.array([unpack(b.as_py(), np.int64)[0] for b in batch.column("body")], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"n": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})
