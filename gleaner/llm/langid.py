"""Language identification by nearest centroid.

Texts are lower-cased and all but letters becomes single spaces; their byte n-grams (one to three
bytes) are hashed to ``DIMENSIONS`` and weighted by TF-IDF at length one.  Labelled training texts of each language are clustered by
spherical k-means into a few centroids, and a text goes to the language of the centroid with the
highest cosine.  A text whose best cosine is under the learned floor for texts of its length is too far
from every centroid and is marked as rejected; so is a text without letters.  The floor of a length is
learned from openings of the sampled texts that have this length, so it is low for short texts and rises
with the evidence, to that of whole texts.

The classifier is fitted on a bounded sample, at most ``PER_LANGUAGE`` labelled rows of each language,
taken by the smallest hashes of their ids.  Texts are clustered in tasks, one language at a time; only
document frequencies (``DIMENSIONS`` numbers from each of ``PARTIALS`` tasks), centroids and floors come to
the driver.  The model has CENTROIDS * DIMENSIONS floats for every language that is learned; more than
``MODEL_BYTES`` of them are an error, no language is left out.  Prediction reads every text whole.

Defined cases: ``und`` if a text is null or has no letter; ``und`` for all if nothing was learned;
ties go to the language that sorts first; rows with a null lang are predicted but not learned from;
a label ``und`` is never learned; of sampled rows with one id and label the smallest text is learned;
very long texts are read whole; an empty table gives an empty result; other columns are ignored, and
carried along under their names by ``keep_identified``, whatever these are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from gleaner.llm.blocks import cut_lineage, dealt
from gleaner.session import ship

DIMENSIONS, CENTROIDS, PER_LANGUAGE = 4096, 4, 400
#: Tasks that sum document frequencies, and the largest model that is sent to executors.
PARTIALS, MODEL_BYTES = 32, 512 << 20
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: The floor of a length is this share of a low quantile of the cosines that texts of the length have to their own language.
FLOOR_SHARE, LOW = 0.5, 0.01
#: Bytes of text whose n-grams are counted at once, and texts.
STEP, ROWS = 1 << 20, 200

_SPACED = re.compile(rb"[^a-z\x80-\xff]+")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length one
    of: np.ndarray  # the language of each row
    floors: np.ndarray  # by the binary logarithm of the number of n-grams

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """The highest cosine to each language's centroids."""
        cos = _weighted(counts, self.idf) @ self.centroids.T
        return np.stack([cos[:, self.of == k].max(axis=1) for k in range(len(self.languages))], axis=1)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64)


#: One for every length that a text can have.
CLASSES = 40


def vectors(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    i = 0
    while i < len(texts):
        j, raw, size = i, [], 0
        while j < len(texts) and (not raw or size < STEP):
            raw.append(_SPACED.sub(b" ", b" " + (texts[j] or "").lower().encode() + b" "))
            size += len(raw[-1])
            j += 1
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        lengths = np.array([len(r) for r in raw])
        row = np.repeat(np.arange(len(raw), dtype=np.int64), lengths)
        counts = np.zeros(len(raw) * DIMENSIONS, np.int64)
        key = np.zeros(len(data), np.uint32)
        for n in range(3):
            key = (key * np.uint32(0x01000193)) if not n else key[:-1] * np.uint32(0x01000193)
            key = key ^ (data[n:] + np.uint32(257 * (n + 1)))
            # A text's n-grams end inside it.
            inside = row[: len(data) - n] == row[n:]
            slot = (((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20)).astype(np.int64) % DIMENSIONS
            counts += np.bincount((row[: len(data) - n] * DIMENSIONS + slot)[inside], minlength=len(counts))
        out[i:j] = counts.reshape(len(raw), DIMENSIONS)
        i = j
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _pick():
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 11).cast("double") / float(1 << 53)


def fit(docs: DataFrame) -> Model | None:
    """Learns from labelled documents outside the held-out fold; None if there are none."""
    ship(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang")).filter((_fold() != HELD_OUT) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    slim = slim.withColumn("pick", _pick())
    common = cut_lineage(slim.groupBy("lang").agg(F.approx_count_distinct("pick").alias("picks")))
    if common.count() * CENTROIDS * DIMENSIONS * 4 > MODEL_BYTES:
        raise ValueError("so many languages make a model that is too large to send to every executor")
    # A row a language, so many at most as the model may have, is small enough to broadcast.
    # Distinct picks are uniform in [0, 1), so the smallest of a language lie under this, with room for the estimate's
    # error of some percent; only these few are ranked, each id once.
    few = slim.join(F.broadcast(common), "lang").filter(F.col("pick") * F.col("picks") <= 4 * PER_LANGUAGE).select("lang", "pick").distinct()
    ranked = few.withColumn("rank", F.expr("row_number() over (partition by lang order by pick)"))
    last = ranked.filter(F.col("rank") <= PER_LANGUAGE).groupBy("lang").agg(F.max("pick").alias("last"))
    sample = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).filter(_fold() != HELD_OUT)
    sample = sample.withColumn("pick", _pick()).join(F.broadcast(last), "lang").filter(F.col("pick") <= F.col("last"))
    sample = cut_lineage(sample.groupBy("lang", "pick").agg(F.min("text").alias("text")).select("lang", "text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                counts = vectors(batch.column(1).slice(at, ROWS).to_pylist())
                texts, held = texts + int(counts.any(axis=1).sum()), held + (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"texts": [texts], "held": pa.array([held.tobytes()], pa.binary())})

    partial = sample.coalesce(PARTIALS).mapInArrow(frequencies, "texts long, held binary").collect()
    texts = sum(r.texts for r in partial)
    if not texts:
        return None
    held = sum(np.frombuffer(r.held, np.int64) for r in partial)
    idf = (np.log((1 + texts) / (1 + held)) + 0.1).astype(np.float32)

    def clustered(table: pa.Table) -> pa.Table:
        # Sorted, as the order in which rows arrive is no input.
        own = sorted(t for t in table.column("text").to_pylist() if t)
        counts = np.concatenate([vectors(own[i : i + ROWS]) for i in range(0, len(own), ROWS)] or [np.zeros((0, DIMENSIONS), np.float32)])
        x = _weighted(counts[counts.any(axis=1)], idf)
        made = _cluster(x, min(CENTROIDS, len(x))) if len(x) else x
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(made), pa.string()), "k": pa.array(range(len(made)), pa.int32()), "body": pa.array([c.astype(np.float32).tobytes() for c in made], pa.binary())})

    rows = sorted(sample.groupBy("lang").applyInArrow(clustered, "lang string, k int, body binary").collect())
    languages = sorted({r.lang for r in rows})
    place = {lang: k for k, lang in enumerate(languages)}
    model = Model(languages, idf, np.stack([np.frombuffer(r.body, np.float32) for r in rows]), np.array([place[r.lang] for r in rows]), np.zeros(CLASSES))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most MODEL_BYTES

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The length and the cosine to its own language of each text's openings of 8, 16, 32, ... characters."""
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS // 10):
                pairs = [(t[: 8 << k], lang, len(t) <= 8 << k) for lang, t in zip(*(c.slice(at, ROWS // 10).to_pylist() for c in batch.columns), strict=True) if lang in place for k in range(max(1, len(t or "").bit_length() - 2)) if t]
                if pairs:
                    counts = vectors([t for t, *_ in pairs])
                    cos = m.cosines(counts)[np.arange(len(pairs)), [place[lang] for _, lang, _ in pairs]].astype(np.float64)
                    whole = np.array([w for *_, w in pairs])
                    # Whole texts count for their length, and together with all others.
                    yield pa.RecordBatch.from_pydict({"length": pa.array(np.concatenate([length_class(counts), np.full(whole.sum(), -1)])), "cos": pa.array(np.concatenate([cos, cos[whole]]))})

    low = sample.mapInArrow(openings, "length long, cos double").groupBy("length").agg(F.percentile_approx("cos", LOW, 1000).alias("low")).collect()
    found = {r.length: max(0.0, r.low) * FLOOR_SHARE for r in low}
    # More evidence never lowers the floor; lengths that weren't seen have that of the next shorter one, and a
    # length with few sampled texts has no higher one than whole texts of all lengths.
    floors = np.maximum.accumulate([found.get(k, 0.0) for k in range(CLASSES)])
    model.floors[:] = np.minimum(floors, found.get(-1, 0.0))
    return model


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first rows."""
    at = [0]
    near = x @ x[0]
    while len(at) < k:
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs``, named _c0, _c1 and so on, with _lang, _score and _rejected."""
    ship(docs.sparkSession)
    names = docs.columns
    rows = dealt(docs.toDF(*(f"_c{i}" for i in range(len(names)))))
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most MODEL_BYTES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column(at).to_pylist()
                lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
                if m is None:
                    lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    counts = vectors(texts)
                    by_lang = m.cosines(counts)
                    best = np.argmax(by_lang, axis=1)
                    score = np.where(lettered, np.clip(by_lang.max(axis=1), 0, 1), 0).astype(np.float64)
                    lang = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    far = ~lettered | (score < m.floors[length_class(counts)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far)], names=[*part.schema.names, "_lang", "_score", "_rejected"])

    schema = StructType([*rows.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType()), StructField("_rejected", BooleanType())])
    return rows.mapInArrow(add, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; lang, source and doc_id aren't looked at to predict."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    made = predict(rows, fit(docs)).withColumnRenamed("_c0", "doc_id")
    return made.select("doc_id", (_fold() == HELD_OUT).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    return predict(docs, fit(docs)).filter(~F.col("_rejected")).select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(docs.columns)))
