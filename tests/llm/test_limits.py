"""Cases beyond what used to be limits, clashing columns through all stages, and items that were changed."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontam, fingerprints, langid, nearcopies, sentencepieces, sharding, simhash, substrings

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def test_copies_are_numbered_in_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.range(100).select((F.col("id") % 3).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(docs).collect()
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len(got) == 100


def test_short_texts_can_be_rejected(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "съешь ещё этих мягких булок да выпей"), (2, "ok"), (3, "12 34 !")], "doc_id long, text string")
    far = {r._c0: r._rejected for r in langid.predict(odd, model).collect()}
    assert far[1] and far[3] and (model.floors[:4] <= model.floors[10]).all()
    assert langid.keep_identified(docs).count() >= 0.99 * docs.count()


def test_every_language_is_learned(spark):
    rows = [(300 * k + j, f"word{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 5, f"l{k:03d}") for k in range(300) for j in range(2)]
    learned = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages
    assert learned == sorted({lang for i, _, lang in rows if not langid._held_out(i)}) and len(learned) > 256


CLASH = ["_row", "_lang", "_score", "_rejected", "_print", "piece_ids", "_text", "_ids", "node", "key", "row_a", "item", "h", "part", "block"]


def test_clashing_columns_stay(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(60)), "en", *[-5 - i] * len(CLASH)) for i in range(30)]
    rows += [(30, rows[0][1], "en", *[-35] * len(CLASH)), (None, None, None, *[None] * len(CLASH)), (31, "", "en", *[-36] * len(CLASH))]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in CLASH)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    items = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    want = {r[0]: r[3:] for r in rows}
    for made, most in ((langid.keep_identified(docs), 31), (nearcopies.drop_near_copies(docs), 32), (simhash.drop_near_duplicates(docs), 32), (substrings.remove_repeats(docs), 33), (decontam.drop_contaminated(docs, items), 32)):
        got = made.collect()
        assert made.columns == docs.columns and 0 < len(got) <= most and all(tuple(r)[3:] == want[r.doc_id] for r in got)
    encoded = sentencepieces.decode_documents(sentencepieces.encode_documents(docs, PIECES), PIECES)
    assert encoded.columns == [c for c in docs.columns if c != "piece_ids"] + ["piece_ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r._text == (None if r.doc_id is None else want[r.doc_id][0]) for r in encoded.collect())
    assert fingerprints.fingerprint_documents(docs).count() == 33 and simhash.near_duplicates(docs).count() == 33 and langid.identify(docs).count() == 33


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    long = text(20_000)
    rows = [(i, text(80), "en", "s", 0) for i in range(20)] + [(3, None, "en", "s", 0), (4, None, None, None, None), (None, "", None, "s", 0), (5, text(80), "en", "s", 0), (21, long, "en", "s", 0), (22, long, "fr", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, rows[2][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("odd", rows), ("none", [])):
        place = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(place / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(place / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(place)).collect()
        # Without text there is no language; 22 is a copy of 21; 2 is the benchmark's item; of a repeated id other texts stay.
        assert sorted(r.doc_id for r in got) == ([i for i in sorted([*range(20), 5, 21]) if i != 2] if some else [])
        assert all(r.n_pieces == len(r.piece_ids) for r in got)


class _Toy(sentencepieces.Codec):
    """A unigram model that is written down here, as none ships."""

    def __init__(self, scores):
        self.text_of = dict(enumerate(scores))
        self.ids, self.rank = {p: i for i, p in self.text_of.items()}, {p: -s for p, s in scores.items()}
        self.unigram, self.unknown, self.most = True, 20.0, max(map(len, scores))


def test_unigram_models_take_the_best_sum():
    rng = random.Random(8)
    toy = _Toy({"".join(rng.choices("abc", k=n)): -rng.random() * 5 for n in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(4)})
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(200)})

    def best(word):
        if not word:
            return 0.0
        return min([20.0 + best(word[1:])] + [toy.rank[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in toy.rank])

    for word, pieces in toy.walk(words):
        parts = [toy.text_of[p] if p >= 0 else chr(-p - 1) for p in reversed(pieces)]
        assert "".join(parts) == word and abs(sum(toy.rank[toy.text_of[p]] if p >= 0 else 20.0 for p in pieces) - best(word)) < 1e-9


def _changed(rng, text, inserted, names):
    words = [str(int(w) + rng.randrange(1, 50)) if w.isdigit() else names.get(w, w) for w in text.split()]
    for _ in range(inserted):
        words.insert(rng.randrange(1, len(words)), rng.choice(["really", "then", "quite", "also"]))
    return " ".join(words)


def test_changed_items_are_found_and_nothing_else(spark):
    """Other numbers, names of one and two words, and inserted words; against every item held against every text."""
    rng = random.Random(11)
    syllables = ["ba", "ko", "ri", "ten", "lum", "sa", "vor", "mi"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 4)))
    items = []
    for k in range(40):
        w = [word() for _ in range(rng.randrange(30, 50))]
        w[4], w[12], w[20], w[27] = "Alice", "12", "Alice", "7"
        items.append((k, " ".join(w)))
    texts = []
    for k, t in items:
        for inserted in range(5):
            texts.append((k, inserted, " ".join([word() for _ in range(40)] + [_changed(rng, t, inserted, {"Alice": rng.choice(["Carol", "Carol Ann"])})] + [word() for _ in range(40)])))
    clean = [" ".join(word() for _ in range(120)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate([t for *_, t in texts] + clean)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for inserted in range(5):
        own = [(i, k) for i, (k, n, _) in enumerate(texts) if n == inserted]
        assert sum(x in got for x in own) >= 0.9 * len(own), inserted
    assert all(i < len(texts) and texts[i][0] == k for i, k in got)
    index = decontam.Index([k for k, _ in items], [t for _, t in items])
    assert got == {(d, k) for d, k, _ in index.search(pa.array([t for *_, t in texts] + clean, pa.string()))}
