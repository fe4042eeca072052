"""Plain twins of what is otherwise tested only by its estimates: fingerprints, language vectors, each pipeline stage."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import fingerprints as fp
from gleaner.llm import langid

pytest.importorskip("public_tokenizers")
FULL = (1 << 64) - 1


def x64(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def pair(a: int, b: int) -> int:
    """Spark's xxhash64 of two longs: the first one's hash is the seed for the second."""
    return x64(b.to_bytes(8, "little"), x64(a.to_bytes(8, "little")))


def numbered(j: int, h: int) -> int:
    return x64(h.to_bytes(8, "little"), x64(j.to_bytes(4, "little")))


def plain_fingerprint(text: str | None) -> str:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = [x64(w.encode()) for w in words]
    if len(words) < fp.WIDTH:
        hashes = [x64(" ".join(words).encode())]
    else:
        two = [pair(a, b) for a, b in zip(h, h[1:], strict=False)]
        four = [pair(a, b) for a, b in zip(two, two[2:], strict=False)]
        hashes = [pair(a, b) for a, b in zip(four, h[4:], strict=False)]
    shift = 64 - (fp.BINS.bit_length() - 1)
    low: dict[int, int] = {}
    for x in hashes:
        low[x >> shift] = min(x, low.get(x >> shift, FULL))
    # Bins are told apart as signed numbers: the upper half of the hashes comes first.
    order = [*range(fp.BINS // 2, fp.BINS), *range(fp.BINS // 2)]
    dense = [low.get(b) for b in order]

    def borrowed(j: int) -> int:
        for t in range(fp.PROBES):
            if (h := dense[fp._probe(j, t, fp.BINS)]) is not None:
                return h
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rank = lambda b: signed(x64(b.to_bytes(4, "little"), x64(j.to_bytes(4, "little"))))
        return min((rank(b), signed(h), h) for b, h in enumerate(dense) if h is not None)[2]

    values = [numbered(j, h if h is not None else borrowed(j)) & ((1 << fp.BITS) - 1) for j, h in enumerate(dense)]
    return "".join(f"{v:x}" for v in values)


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", "é ü 中文 x\x1cy 😀 z"] + [" ".join(f"w{rng.randrange(200)}" for _ in range(n)) for n in (6, 9, 30, 200, 3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fp.as_hex(fp.fingerprint(F.col("t"))).alias("f")).collect()
    assert [r.f for r in sorted(got)] == [plain_fingerprint(t) for t in texts]


def plain_vector(text: str | None) -> np.ndarray:
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + (text or "").lower().encode() + b" ")
    counts, mask = Counter(), (1 << 32) - 1
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            key = 0
            for k, byte in enumerate(raw[i : i + n]):
                key = (key * 0x01000193 & mask) ^ (byte + 257 * (k + 1))
            counts[((key ^ (key >> 15)) * 0x85EBCA6B & mask) >> 20] += 1
    return np.array([counts[k] for k in range(langid.DIMENSIONS)], np.float32)


def test_language_vectors_and_prediction(spark, data):
    texts = ["Hello World", "", None, "1 2 3", "é", "naïve ÉTÉ " * 30, "x" * 300, "a b"]
    assert (langid.vectors(texts) == np.stack([plain_vector(t) for t in texts])).all()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.limit(40).collect():
        if r.text and re.search(r"[^\W\d_]", r.text):
            x = np.log1p(plain_vector(r.text)) * model.idf
            cos = model.centroids @ (x / np.linalg.norm(x))
            best = max(range(len(model.languages)), key=lambda k: cos[model.of == k].max())
            assert abs(rows[r.doc_id].score - max(0, cos.max())) < 1e-4 and (rows[r.doc_id].lang_pred == model.languages[best] or abs(np.sort(cos)[-1] - np.sort(cos)[-2]) < 1e-4)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_substring_stage(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared, other = text(60), text(35)
    rows = [(0, f"{text(30)} {shared} {text(30)}"), (1, f"{shared}\n{text(9)}"), (2, f"{text(50)}  {other}"), (3, other), (4, text(34)), (5, "k " * 90), (6, None), (7, text(200)), (8, f"{text(5)} {' '.join(shared.split()[:34])} {text(5)}")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "d"))
    seen = Counter(tuple(words(t)[i : i + 35]) for _, t in rows for i in range(len(words(t)) - 34))
    want = {}
    for i, t in rows:
        w = words(t)
        gone = {p for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for p in range(a, a + 35)}
        want[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    got = corpus_pipeline.substring_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text or "") for r in got) and want[3] == "" and want[4] and want[8]


def test_language_and_decontamination_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    far = {r.doc_id for r in langid.identify(docs).filter("rejected").collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, data).collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id not in far)
    flat = lambda t: " ".join((t or "").split())
    items = [flat(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in docs.collect() if not any(i in flat(r.text) for i in items))
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, data).collect()) == want
