"""SentencePiece encoding and decoding with shared-prefix dynamic programming.

Spaces become the mark U+2581, one is put in front, and a text falls apart into marked words: no
piece goes past the end of a word, and a character that no piece holds (a line break) stands alone.
The distinct words of a block are sorted, which is a depth-first walk of their trie, and each prefix
keeps its forward state, so words share the work on what they have in common.

For a unigram model the state of a prefix is its best sum of piece scores and the last piece (Viterbi).
For a BPE model, adding up scores would give other pieces than the library does, so its forward step is: the
encoding of a prefix is that of a shorter prefix and one last piece, namely the one piece that ends
there and is *stable* next to the last piece of the shorter prefix (BPE applied to both pieces'
characters gives just these two pieces).  Exactly one piece qualifies, so the state of a prefix is
the length of its last piece, and back pointers give the encoding, as in Viterbi's algorithm.  The kind of
model is told by its scores, which are ranks in a BPE model; a model that disagrees with the library on
``PROBES`` (one that normalises texts, say) is refused.

Defined cases: a null or empty text has no pieces; unknown characters become their UTF-8 bytes'
pieces; a text that holds the mark itself decodes to spaces in its place, as in the library;
repeated rows and other columns are carried along, whatever their names, but for a column that has the
name of the result, which it replaces; very long texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gleaner.llm.blocks import dealt, release
from gleaner.session import ship

MARK = "▁"
#: Bytes of text whose distinct words are encoded at once, and words that a worker remembers.
STEP, MOST_PAIRS = 4 << 20, 500_000
#: The same where ids and decoded texts are held beside the texts: 108 MB a worker at most on documents, 275 by STEP.
SMALL_STEP = 1 << 20
#: Characters of the words that a worker remembers, and of the longest that it does; some 40 MB.
REMEMBERED, LONGEST = 1 << 20, 32
#: The library's and this module's pieces of these must be the same.
PROBES = ["Hello world", " two  spaces ", "Ünïcode ﬁ ① ﾊﾝ 中文 😀\t\n1234.5", "a" * 40]
#: Stands for no piece.
EDGE = 1 << 19
SHORT = (2, 1)
#: Cuts words apart; texts that hold it go another way.
CUT = "\x1f"


class Codec:
    """Pieces and ranks of a BPE model, and the trie walk."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.unigram = not all(float(r).is_integer() for r in self.rank.values())
        self.unknown = max(self.rank.values(), default=0.0) + 10.0  # the library's penalty
        self.most = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes past the end of a word; this model isn't handled")
        # Characters that join no other end a word too, which makes words repeat more often.
        self.alone = alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids if len(p) > 1))
        self.word = re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        # The lengths, from three on, of pieces by their last three characters.
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: (*sorted(found, reverse=True), 2, 1) for t, found in tails.items()}
        self.text_of = {i: p for p, i in self.ids.items()}
        self.stable: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.known: dict[str, np.ndarray] = {}
        self.known_size = 0
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        for text in PROBES:
            if self.encode([text])[0].tolist() != sp.encode(text):
                raise ValueError("the library encodes otherwise; this model isn't handled")

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-ranked neighbours join first, the leftmost of equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _history(self, piece: int) -> tuple[list, list] | None:
        """The symbols at a piece's two ends while BPE builds it, each with the ranks of the joins that make and use it.

        None if BPE doesn't build the piece, or not in the order of ranks.
        """
        if piece in self.edges:
            return self.edges[piece]
        text, rank = self.text_of[piece], self.rank
        parts, now = list(text), float("-inf")
        sides: tuple[list, list] = ([[parts[0], now, None]], [[parts[-1], now, None]])
        fine = True
        while len(parts) > 1 and fine:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
            fine = best is not None and best[0] >= now
            if fine:
                now, i = best
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                for side, end in zip(sides, (parts[0], parts[-1]), strict=True):
                    if side[-1][0] != end:
                        side[-1][2] = now
                        side.append([end, now, None])
        made = None
        if fine:
            made = tuple([(s, born, float("inf") if gone is None else gone) for s, born, gone in side] for side in sides)
        self.edges[piece] = made
        return made

    def _judge(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces as they are; EDGE on the left stands for a border that nothing crosses."""
        if len(self.stable) > MOST_PAIRS:
            self.stable.clear()
        b = self._history(right)
        a = b if left == EDGE else self._history(left)
        if a is None or b is None:
            text = self.text_of[right]
            found = self.merged(text) == [text] if left == EDGE else self.merged(self.text_of[left] + text) == [self.text_of[left], text]
        elif left == EDGE:
            found = True
        else:
            # A join over the border happens if both symbols are there at its rank; of equal ranks the leftmost goes first.
            rank, found = self.rank.get, True
            for x, born_x, gone_x in a[1]:
                for y, born_y, gone_y in b[0]:
                    q = rank(x + y)
                    if q is not None and q >= born_x and q >= born_y and q < gone_x and q <= gone_y:
                        found = False
        self.stable[left << 20 | right] = found
        return found

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The pieces of each of the sorted, distinct words, from the last to the first; a code point below zero is unknown."""
        if self.unigram:
            yield from self._viterbi(words)
            return
        last: list[int] = [EDGE]  # of every prefix, the piece that it ends in
        before, ids, known, tails, judge = "", self.ids.get, self.stable.get, self.tails.get, self._judge
        size = [len(self.text_of.get(i, "x")) for i in range(len(self.bytes_of))]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for length in tails(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                    start = end - length
                    if start < 0:
                        continue
                    piece = ids(word[start:end])
                    if piece is None:
                        continue
                    left = last[start]
                    if left < 0:
                        left = EDGE
                    ok = known(left << 20 | piece)
                    if ok is None:
                        ok = judge(left, piece)
                    if ok:
                        last.append(piece)
                        break
                else:
                    last.append(-ord(word[end - 1]) - 1)
            pieces, end = [], len(word)
            while end:
                p = last[end]
                pieces.append(p)
                end -= size[p] if p >= 0 else 1
            yield word, pieces
            before = word

    def _viterbi(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """``walk`` by the best sum of scores: of every prefix the best cost, and the last piece on the way to it."""
        cost, last, before, ids, rank = [0.0], [EDGE], "", self.ids.get, self.rank
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del cost[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, at = cost[end - 1] + self.unknown, -ord(word[end - 1]) - 1
                for start in range(max(0, end - self.most), end):
                    piece = ids(word[start:end])
                    if piece is not None and (now := cost[start] + rank[word[start:end]]) < best:
                        best, at = now, piece
                cost.append(best)
                last.append(at)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(self.text_of[last[end]]) if last[end] >= 0 else 1
            yield word, pieces
            before = word

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        new = sorted(w for w in words if w not in self.known)
        made = {}
        for word, pieces in self.walk(new):
            out = []
            for p in reversed(pieces):
                out += [p] if p >= 0 else self.byte_ids[list(chr(-p - 1).encode())].tolist()
            made[word] = np.array(out, np.uint32)
        result = [made[w] if w in made else self.known[w] for w in words]
        for word, pieces in made.items():
            if len(word) <= LONGEST:
                if self.known_size > REMEMBERED:
                    self.known.clear()
                    self.known_size = 0
                self.known[word] = pieces
                self.known_size += len(word)
        return result

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Marked words of all texts: codes, how many of each text, and the distinct words."""
        plain = pa.array(["" if not t or "  " in t or t[0] == " " or CUT in t or MARK in t else CUT + MARK + t.replace(" ", CUT + MARK) for t in texts], pa.string())
        for c in self.alone:
            plain = pc.replace_substring(plain, c, CUT + c + CUT)
        lists = pc.split_pattern(plain, CUT)
        flat = lists.flatten()
        full = pc.not_equal(flat, "")
        coded = flat.filter(full).dictionary_encode()
        at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        order, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        slow = [i for i, t in enumerate(texts) if t and at[i] == at[i + 1]]
        if not slow:
            return order, np.diff(at), words
        # Runs of spaces belong to one word; these texts are taken by the pattern.
        codes = {w: i for i, w in enumerate(words)}
        each = [order[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i in slow:
            each[i] = np.array([codes.setdefault(w, len(codes)) for w in self.word.findall(MARK + texts[i].replace(" ", MARK))], np.int64)
        return np.concatenate(each), np.array([len(e) for e in each], np.int64), list(codes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids end."""
        order, counts, words = self.split(texts)
        words = self.encode_words(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ids = _gather(np.concatenate(words or [np.empty(0, np.uint32)]), sizes, order)
        ends = np.concatenate([[0], np.cumsum(sizes[order])])[np.cumsum(np.concatenate([[0], counts]))]
        return ids.astype(np.int32), ends[1:]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data = _gather(self.piece_bytes, self.piece_sizes, ids).tobytes()
        at = np.concatenate([[0], np.cumsum(self.piece_sizes[ids])])[np.concatenate([[0], ends])].tolist()
        # The mark in front isn't the text's.
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(at, at[1:], strict=False)]


def _gather(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` (of ``sizes``) in the given order."""
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = sizes[order]
    if not len(n):
        return values[:0]
    shift = start[order] - np.concatenate([[0], np.cumsum(n)[:-1]])
    return values[np.repeat(shift, n) + np.arange(int(n.sum()))]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _steps(batches: Iterator[pa.RecordBatch], at: int, step: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // (step or STEP)
        cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
            release()


def encode_documents(docs: DataFrame, path: str, into: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of its texts' pieces, array<int>."""
    ship(docs.sparkSession)
    docs = docs.drop(into)
    names, at = docs.columns, docs.columns.index("text")
    rows = dealt(docs.toDF(*(f"_c{i}" for i in range(len(names)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches, at):
            ids, ends = codec(path).encode(part.column(at).to_pylist())
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield from _small(pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "_ids"]))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_ids", ArrayType(IntegerType()))])).toDF(*names, into)


def _small(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def decode_documents(encoded: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    ship(encoded.sparkSession)
    encoded = encoded.drop(into)
    names, at = encoded.columns, encoded.columns.index(ids)
    rows = encoded.toDF(*(f"_c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                lists = part.column(at)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                made = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.decode(errors="replace") for m in made], pa.string())], names=[*part.schema.names, "_text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_text", StringType())])).toDF(*names, into)


def round_trips(docs: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """The columns of ``docs`` but ``text``, with the ids of its pieces and the text that these stand for, by one Python worker of a task."""
    ship(docs.sparkSession)
    docs = docs.drop(ids, into)
    at = docs.columns.index("text")
    names = [c for i, c in enumerate(docs.columns) if i != at]
    rows = dealt(docs.toDF(*(f"_c{i}" for i in range(len(docs.columns)))))
    fields = [f for i, f in enumerate(rows.schema.fields) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches, at, SMALL_STEP):
            made, ends = codec(path).encode(part.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(made, pa.int32()))
            texts = pa.array([m.decode(errors="replace") for m in codec(path).decode(made.astype(np.int64), ends)], pa.string())
            kept = [i for i in range(part.num_columns) if i != at]
            yield from _small(pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), lists, texts], names=[*(part.schema.names[i] for i in kept), "_ids", "_text"]))

    return rows.mapInArrow(run, StructType([*fields, StructField("_ids", ArrayType(IntegerType())), StructField("_text", StringType())])).toDF(*names, ids, into)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256, round_trip of every document."""
    ship(docs.sparkSession)
    rows = dealt(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches, 1):
            texts = part.column(1).to_pylist()
            c = codec(path)
            ids, ends = c.encode(texts)
            made = c.decode(ids, ends)
            cut = [0, *ends.tolist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_pieces": pa.array(np.diff(cut), pa.int64()), "ids_sha256": pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]),
                "decoded_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in made]), "round_trip": pa.array([m == (t or "").encode() for m, t in zip(made, texts, strict=True)]),
            })

    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
