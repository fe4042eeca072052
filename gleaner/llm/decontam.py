"""Benchmark decontamination by templates.

Numbers, quantities and names are replaced by typed placeholders, so that a question with other
numbers or names keeps its template.  Windows of ``WINDOW`` template words of the benchmark are
looked up in every document by hash.  Windows that line up (same document, same item, same offset)
and touch make a span, which is verified word by word; its placeholders' fillings must be consistent:
one filling of the item always stands against one filling of the document, and the other way round.
Of an inconsistent span only the stretches that are verbatim count.  Consistent spans whose offsets
differ by no more than the item's length are united, longest first, as far as their fillings agree;
verbatim ones come first.  A document is contaminated by an item if the united spans cover
``COVERAGE`` of the item's words, or if ``VERBATIM`` of its words stand there in a row.

Words are lower-cased and stripped of punctuation; a word of digits is a number, a number with a
unit (joined or as the next word) a quantity, a capitalised word a name; names in a row within a
sentence are one.  A capitalised word that opens a sentence may be a name or not, so there are two
templates: in one it's a word, in the other a name.

Nothing of the benchmark goes through the driver.  Its window hashes are a table, and a table of bits of
``BITS`` bits, whatever its size, tells most windows of a document that they aren't in it.  The windows
that pass are hash-joined to the benchmark's; pairs of a document and an item with so few windows in common
that they can't cover enough are dropped, and the others meet with both texts to be verified.

Defined cases: null and empty texts on either side match nothing; an item of fewer than ``WINDOW``
template words (but at least ``least``, one by default) has one window, itself, and counts only verbatim;
several items in one document give one row each; of several ways to line up a document and an item the one
that covers most counts; repeated rows repeat; an empty benchmark matches nothing; an empty table gives an
empty result; very long texts are read whole; other columns are carried along under their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import _U, byte_strings, cut_lineage, dealt, mix, release, tokens, window_hashes, word_hashes
from gleaner.session import ship

WINDOW, COVERAGE = 8, 0.5
#: Words of an item that contaminate by themselves if they are copied verbatim.
VERBATIM = 35
#: Texts of so many bytes are taken at once.
STEP = 4 << 20
#: Logarithm of the number of bits that tell a document's windows apart from the benchmark's, and of their slices.
BITS, SLICES = 24, 5

#: Unit words and symbols.
UNITS = frozenset("% percent mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ton tons lb lbs pound pounds oz ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur degree degrees".split())

_NUMBER = regex.compile(r"[$€£]?[+-]?\d[\d.,:/]*([\p{L}%°]*)")
_CORE = regex.compile(r"[\p{L}\p{N}%$€£°](?:.*[\p{L}\p{N}%°])?")
WORD, NUMBER, QUANTITY, NAME, UNIT, NONE = range(6)


def classify(token: str) -> tuple[int, str, bool]:
    """Kind of a raw token by itself (a capitalised word counts as a name here), its plain form, and whether it ends a sentence."""
    bare = token.rstrip(".,;:!?")
    if bare.isalpha():  # most words; what follows gives the same for them
        plain = bare.lower()
        return (UNIT if plain in UNITS else NAME if bare[0].isupper() and not bare.isupper() else WORD), plain, token[-1] in ".!?:"
    ends = token.rstrip("\"')]}»”’")[-1:] in tuple(".!?:")
    core = _CORE.search(token)
    if core is None:
        return NONE, "", ends
    plain = core[0]
    number = _NUMBER.fullmatch(plain)
    if number:
        return (QUANTITY if number[1].lower() in UNITS or plain[0] in "$€£" else NUMBER if not number[1] else WORD), plain.lower(), ends
    if plain.lower() in UNITS:
        return UNIT, plain.lower(), ends
    return (NAME if plain[0].isupper() and not plain.isupper() else WORD), plain.lower(), ends


class Words:
    """Words of a column of texts: kind, filling, text and sentence of each, and where each text starts."""

    def __init__(self, text: pa.Array) -> None:
        codes, words, starts = tokens(text, lower=False)
        made = [classify(w.decode()) for w in byte_strings(words)]
        kind = np.array([k for k, _, _ in made], np.int8)[codes] if made else np.empty(0, np.int8)
        ends = np.array([e for _, _, e in made], bool)[codes] if made else np.empty(0, bool)
        plain = pa.array([p for _, p, _ in made], pa.string())
        filling = word_hashes(plain)[codes] if made else np.empty(0, _U)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        # Punctuation alone is no word, but it can end a sentence.
        full = kind != NONE
        sentence = np.cumsum(np.concatenate([[False], ends[:-1]])) if len(ends) else np.empty(0, np.int64)
        self.kind, self.filling, self.doc, self.sentence = kind[full], filling[full], doc[full], sentence[full]
        self.starts = np.searchsorted(self.doc, np.arange(len(starts)))


class Templates:
    """Template words of texts: hashes of template and of filling, the words that each stands for, where each text starts.

    ``loose``: a capitalised word is a name wherever it stands; otherwise it's a word at the start of a sentence.
    """

    def __init__(self, words: Words, loose: bool) -> None:
        kind, filling, doc, sentence = words.kind, words.filling, words.doc, words.sentence
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (sentence[1:] == sentence[:-1])])[: len(doc)]
        # A unit after a number makes it a quantity, and is a word anywhere else.
        joins = np.concatenate([(kind[:-1] == NUMBER) & (kind[1:] == UNIT) & (doc[1:] == doc[:-1]), [False]])[: len(doc)]
        gone = np.concatenate([[False], joins[:-1]])[: len(doc)]
        plain = (kind == UNIT) if loose else (kind == UNIT) | ((kind == NAME) & ~same)
        kind = np.where(joins, QUANTITY, np.where(plain, WORD, kind))
        filling = np.where(joins, filling * _U(31) + np.append(filling[1:], _U(0))[: len(filling)], filling) if len(filling) else filling
        # Names in a row are one name.
        run = np.concatenate([[False], (kind[1:] == NAME) & (kind[:-1] == NAME)])[: len(doc)] & same
        self.first = np.flatnonzero(~(gone | run))
        self.end = np.append(self.first[1:], len(doc))[: len(self.first)]
        if run.any():
            at = np.arange(len(doc))
            place = at - np.maximum.accumulate(np.where(run, 0, at))
            power = np.cumprod(np.concatenate([[_U(1)], np.full(int(place.max()), 0x9E3779B97F4A7C15, _U)]), dtype=_U)
            filling = np.add.reduceat(np.where(gone, _U(0), filling * power[np.where(gone, 0, place)]), self.first)
        else:
            filling = filling[self.first]
        self.kind, self.filling, self.doc = kind[self.first], filling, doc[self.first]
        self.template = np.where(self.kind == WORD, self.filling, self.kind.astype(_U))
        self.starts = np.searchsorted(self.doc, np.arange(len(words.starts)))


def _windows(t: Templates, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that don't leave their text, and where they start."""
    h = window_hashes(t.template, width)
    at = np.flatnonzero(t.doc[: len(h)] == t.doc[width - 1 : width - 1 + len(h)]) if len(h) else np.empty(0, np.int64)
    return h[at], at


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


class Index:
    """The benchmark block's windows by template and width: sorted hashes with their places."""

    def __init__(self, ids: list[int], texts: list[str], least: int = 1) -> None:
        self.ids, self.words = ids, Words(pa.array(texts, pa.string()))
        self.t = [Templates(self.words, loose) for loose in (False, True)]
        self.by_width: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]]] = []
        for t in self.t:
            size, made = np.diff(t.starts), {}
            for width in sorted({min(WINDOW, int(n)) for n in size if n >= least}):
                h, at = _windows(t, width)
                whole = size[t.doc[at]]
                own = whole >= WINDOW if width == WINDOW else whole == width
                h, at = h[own], at[own]
                order = np.argsort(h, kind="stable")
                # Most windows of a document are turned away by one look at a table of leading bits.
                shift = _U(64 - min(26, len(h).bit_length() + 5))
                seen = np.zeros(1 << (64 - int(shift)), bool)
                seen[h >> shift] = True
                made[width] = h[order], at[order], seen, shift
            self.by_width.append(made)

    def search(self, text: pa.Array) -> list[tuple[int, int, float]]:
        """(text, item, coverage) of what is contaminated."""
        words = Words(text)
        spans: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for loose in (False, True):
            d, t = Templates(words, loose), self.t[loose]
            lined: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
            for width, (hashes, places, seen, shift) in self.by_width[loose].items():
                h, at = _windows(d, width)
                likely = np.flatnonzero(seen[h >> shift])
                h, at = h[likely], at[likely]
                low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                for i in np.flatnonzero(high > low).tolist():
                    for place in places[low[i] : high[i]].tolist():
                        pos = int(at[i])
                        lined[int(d.doc[pos]), int(t.doc[place]), pos - place].append((place, width))
            for (doc, item, offset), found in lined.items():
                spans[doc, item] += self._spans(item, offset, found, d, loose)
        out = []
        for (doc, item), found in sorted(spans.items()):
            share, longest = self._cover(item, found)
            if share >= COVERAGE or longest >= VERBATIM:
                out.append((doc, self.ids[item], share))
        return out

    def _spans(self, item: int, offset: int, found: list[tuple[int, int]], d: Templates, loose: bool) -> list[tuple]:
        """(start and end in the item's words, shift to the document's words, verbatim, pairs of fillings) of the spans that are verbatim or consistent."""
        t, base = self.t[loose], int(self.t[loose].starts[item])
        covered = np.zeros(int(t.starts[item + 1]) - base, bool)
        for place, width in found:
            covered[place - base : place - base + width] = True
        at = np.flatnonzero(covered) + base
        covered[at - base] = t.template[at] == d.template[at + offset]
        least, start, out = min(WINDOW, len(covered)), int(self.words.starts[item]), []

        def add(a: int, b: int, verbatim: bool, pairs: set) -> None:
            out.append((int(t.first[a]) - start, int(t.end[b - 1]) - start, int(d.first[a + offset]) - int(t.first[a]), verbatim, pairs))

        for a, b in _runs(covered):
            a, b = a + base, b + base
            if b - a < least:
                continue
            at = np.arange(a, b)
            same = t.filling[at] == d.filling[at + offset]
            slot = t.kind[at] != WORD
            pairs = list(zip([loose] * int(slot.sum()), t.kind[at][slot].tolist(), t.filling[at][slot].tolist(), d.filling[at + offset][slot].tolist(), strict=True))
            # A template of a few words says too little.
            if not same.all() and len(covered) >= WINDOW and _one_to_one(set(pairs)):
                add(a, b, False, set(pairs))
            for x, y in _runs(same):
                if y - x >= least:
                    inside = np.arange(a + x, a + y)
                    inside = inside[t.kind[inside] != WORD]
                    add(a + x, a + y, True, {(loose, k, f, f) for k, f in zip(t.kind[inside].tolist(), t.filling[inside].tolist(), strict=True)})
        return out

    def _cover(self, item: int, spans: list[tuple]) -> tuple[float, int]:
        """The largest share of the item's words that consistent spans at near offsets cover, and the longest verbatim span."""
        size = int(self.words.starts[item + 1] - self.words.starts[item])
        spans = sorted(spans, key=lambda s: s[2])
        share, group = 0.0, []
        for k, span in enumerate(spans):
            group.append(span)
            if k + 1 < len(spans) and spans[k + 1][2] - span[2] <= max(WINDOW, size):
                continue
            covered, pairs = np.zeros(size, bool), set()
            for a, b, _, verbatim, own in sorted(group, key=lambda s: (not s[3], s[0] - s[1], s[0], s[2])):
                if verbatim or _one_to_one(pairs | own):
                    covered[a:b] = True
                    pairs |= own
            share, group = max(share, float(covered.mean())), []
        return share, max((b - a for a, b, _, verbatim, _ in spans if verbatim), default=0)


def _one_to_one(pairs: set[tuple]) -> bool:
    """Whether each filling of the item stands against one filling of the document, and the other way round."""
    return len(pairs) == len({p[:3] for p in pairs}) == len({(p[0], p[1], p[3]) for p in pairs})


def _named(h: np.ndarray, width: int, loose: bool) -> np.ndarray:
    """Hashes of windows that tell widths and kinds of template apart too."""
    return mix(h, np.full(len(h), 2 * width + loose, _U))


def _item_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(h, item, width, need) of (item, text): every window, and how many of an item's must be found at least."""
    for part in _steps(batches, "text"):
        words = Words(part.column("text"))
        size, made, span = np.diff(words.starts), [], np.ones(part.num_rows, np.int64)
        for loose in (False, True):
            t = Templates(words, loose)
            n = np.diff(t.starts)
            for width in sorted({min(WINDOW, int(x)) for x in n if x >= least}):
                h, at = _windows(t, width)
                whole = n[t.doc[at]]
                own = whole >= WINDOW if width == WINDOW else whole == width
                h, at = h[own], at[own]
                np.maximum.at(span, t.doc[at], t.end[at + width - 1] - t.first[at])
                made.append((_named(h, width, loose), t.doc[at], np.full(len(h), width)))
        if not made:
            continue
        h, item, width = (np.concatenate(x) for x in zip(*made, strict=True))
        # A window covers ``span`` words at most, and so many must be covered in all.
        need = np.ceil(np.minimum(COVERAGE * size, VERBATIM) / span).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "item": part.column("item").take(pa.array(item)), "width": pa.array(width, pa.int32()), "need": pa.array(need[item], pa.int64())})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, bits): which leading bits the hashes of a column have."""
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        seen[batch.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - BITS)] = True
    for k, part in enumerate(np.split(seen, 1 << SLICES)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})


def _bits(windows: DataFrame) -> np.ndarray:
    """The bits of all hashes; 2 ** BITS / 8 bytes in all come to the driver."""

    def united(table: pa.Table) -> pa.Table:
        bits = np.zeros((1 << BITS - SLICES) // 8, np.uint8)
        for body in table.column("bits"):
            bits |= np.frombuffer(body.as_buffer(), np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(1 << BITS, bool).reshape(1 << SLICES, -1)
    for r in windows.select("h").mapInArrow(_slices, "slice int, bits binary").groupBy("slice").applyInArrow(united, "slice int, bits binary").collect():
        out[r.slice] = np.unpackbits(np.frombuffer(r.bits, np.uint8))
    return out.reshape(-1)


def _found(rows: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """(_row, doc_id, item_id, coverage) of ``rows`` (_row, doc_id, text)."""
    spark = rows.sparkSession
    ship(spark)
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("item_text"))
    windows = items.select("item", F.col("item_text").alias("text")).mapInArrow(lambda batches: _item_windows(batches, least), "h long, item long, width int, need long")
    windows = cut_lineage(windows.groupBy("h", "item").agg(F.count(F.lit(1)).alias("n"), F.first("width").alias("width"), F.first("need").alias("need")))
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # WINDOW at most
    shared = spark.sparkContext.broadcast(np.packbits(_bits(windows)))  # 2 ** BITS / 8 bytes

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(shared.value).view(bool)
        for part in _steps(batches, "text"):
            words, made = Words(part.column("text")), []
            for loose in (False, True):
                t = Templates(words, loose)
                for width in widths:
                    h, at = _windows(t, width)
                    h = _named(h, width, loose)
                    hit = np.flatnonzero(seen[h >> _U(64 - BITS)])
                    if len(hit):
                        made.append(np.stack([t.doc[at[hit]].astype(_U), h[hit]], axis=1))
            if made:
                found = np.unique(np.concatenate(made), axis=0)
                yield pa.RecordBatch.from_pydict({"_row": part.column("_row").take(pa.array(found[:, 0].astype(np.int64))), "h": pa.array(np.ascontiguousarray(found[:, 1]).view(np.int64))})

    asked = dealt(rows.select("_row", "text")).mapInArrow(likely, "_row long, h long")
    pairs = asked.join(windows.select("h", "item", "n", "need"), "h").groupBy("_row", "item").agg(F.sum("n").alias("n"), F.first("need").alias("need")).filter("n >= need").select("_row", "item")
    both = rows.join(pairs, "_row").join(items, "item").select("_row", "doc_id", "text", "item", "item_id", "item_text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches, "text"):
            own, of = np.unique(part.column("item").to_numpy(), return_index=True)
            index = Index(own.tolist(), part.column("item_text").take(pa.array(of)).to_pylist(), least)
            wanted = part.column("item").to_pylist()
            docs, first = np.unique(part.column("_row").to_numpy(), return_index=True)
            place = {(int(r), i): k for k, (r, i) in enumerate(zip(part.column("_row").to_pylist(), wanted, strict=True))}
            hits = index.search(part.column("text").take(pa.array(first)))
            hits = [(place[int(docs[d]), i], c) for d, i, c in hits if (int(docs[d]), i) in place]
            at = pa.array([k for k, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in ("_row", "doc_id", "item_id")] + [pa.array([c for _, c in hits], pa.float64())], names=["_row", "doc_id", "item_id", "coverage"])
            release()

    return both.mapInArrow(verified, "_row long, doc_id long, item_id long, coverage double")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with columns _c0, _c1, ... and _row, and its _row, doc_id and text."""
    names = docs.columns
    placed = docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id())
    return placed, placed.select("_row", F.col(f"_c{names.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"_c{names.index('text')}").cast("string").alias("text"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, item_id, coverage): a row for every document and every item that it holds."""
    return _found(_placed(docs)[1], benchmark, least).drop("_row")


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about STEP bytes of text."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // STEP
        at = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield batch.slice(a, b - a)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.  ``docs`` must be a deterministic plan."""
    placed, rows = _placed(docs)
    bad = _found(rows, benchmark, least).select("_row").distinct()
    return placed.join(bad, "_row", "left_anti").select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(docs.columns)))
