"""Each operator against a brute-force version, and on null, empty, repeated, tied and clashing input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import blocks, decontam, fingerprints, graph, langid, licenses, lm_scoring, sentencepieces, sharding, simhash, substrings, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE, PIECES = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    """Odd texts: null, empty, white space only, copies, a repeated id, long, passages that are shared, all kinds of characters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "the", "naïve", "ÉTÉ", "中文", "x\x1cy", "a\xa0b", "😀", "don't", "3.5"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = text(60)
    out = [(i, text(rng.choice([1, 2, 4, 5, 20, 60, 120])), ["en", "fr"][i % 2]) for i in range(40)]
    out += [(40, None, "en"), (41, "", None), (42, " \n\t ", "en"), (43, out[7][1], "fr"), (43, out[8][1], None), (44, f"{text(20)} {passage}  {text(5)}\n", "en"), (45, f"{passage}\n{text(9)}", "en"), (46, "k " * 300, "fr"), (47, "ab cd " * 50, "en"), (48, text(3000), "en"), (None, text(30), "en"), (49, "<|endoftext|> a<|endoftext|>", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "text").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- helpers


def test_packing_and_windows():
    a, b = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)), np.arange(7, dtype=np.uint32)
    x, y = blocks.unpack(blocks.pack(blocks.deltas(a), b), np.uint64, np.uint32)
    assert (blocks.undeltas(x) == a).all() and (y == b).all()
    for width in (1, 2, 3, 8, 35):
        h = blocks.window_hashes(np.tile(a[:40], 2), width)
        assert len(h) == 81 - width and h[0] == h[40] and len(set(h.tolist())) <= 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (-7, 200), (200, 201)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[201] == -7
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op1


def brute_scores(rows, k2=lm_scoring.K2, k3=lm_scoring.K3):
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    texts = [(i, words_of((t or "").translate({c: c + 32 for c in range(65, 91)}))) for i, t, *_ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if train(i):
            q = [b"\n", *w, b"\n"]
            one.update(q[1:])
            two.update(zip(q, q[1:], strict=False))
            three.update(zip(q, q[1:], q[2:], strict=False))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, w: (two[h, w] + k2 * p1(w)) / (one[h] + k2)
    p3 = lambda g, h, w: (three[g, h, w] + k3 * p2(h, w)) / (two[g, h] + k3) if two[g, h] >= lm_scoring.HISTORY else p2(h, w)
    out = []
    for i, w in texts:
        q = [b"\n", *w, b"\n"]
        score = math.log10(p2(q[0], q[1])) + sum(math.log10(p3(*x)) for x in zip(q, q[1:], q[2:], strict=False))
        out.append((i, not train(i), len(w) + 1, sum(one[x] > 0 for x in q[1:]), n, round(sum(math.log10(p1(x)) for x in q[1:]), 6), round(score, 6)))
    # The model is a distribution: over all words and the unknown word it sums to one.
    for g, h in [x for x in two if two[x] >= 2][:5] + list(two)[:2]:
        if h != b"\n":
            assert abs(sum(p3(g, h, w) for w in one) + p3(g, h, b"unknown word") - 1) < 1e-9
    return sorted(map(repr, out))


def test_lm_scores(rows, docs, empty):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score_documents(docs).collect()]
    assert sorted(map(repr, got)) == brute_scores(rows)
    assert lm_scoring.score_documents(empty).count() == 0


def test_steps_of_the_exchange_change_nothing(docs, monkeypatch):
    """Many more parts than messages of a block, so that answers take several steps."""

    def results():
        return [sorted(map(repr, f.collect())) for f in (lm_scoring.score_documents(docs), substrings.digests(docs), token_counts.count_tokens(docs, BYTE_BPE))]

    want = results()
    monkeypatch.setattr(blocks, "FAN", 4)
    for module in (lm_scoring, substrings, token_counts):
        monkeypatch.setattr(module, "parts_for", lambda df: 33)
    assert results() == want


def test_lm_beats_its_base_on_held_out_documents(spark, data):
    r = lm_scoring.score_documents(spark.read.parquet(f"{data}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# ---------------------------------------------------------------- op2


def brute_removed(rows, width=substrings.WINDOW):
    texts = [(i, words_of(t)) for i, t, *_ in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(map(repr, out))


def test_repeats(rows, docs, empty):
    assert sorted(repr(tuple(r)) for r in substrings.digests(docs).collect()) == brute_removed(rows)
    assert substrings.digests(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0
    spans = substrings.repeated_spans(docs).collect()
    assert sorted(repr((r.doc_id, r.n_words, sum(b - a for a, b in r.spans))) for r in spans) == sorted(repr(tuple(r)[:3]) for r in substrings.digests(docs).collect())


def test_removal_keeps_other_columns(docs):
    out = substrings.remove_repeats(docs.withColumn("block", F.lit("x")).withColumn("body", F.lit(1)))
    assert out.columns == [*docs.columns, "block", "body"] and out.count() == docs.count()
    assert {(r.body, r.block) for r in out.collect()} == {(1, "x")}
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_symbols_are_decided_by_their_stretch():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 60, 40).astype(np.uint64)[rng.integers(0, 40, 400)]
    name, low, high = substrings.parse(h, np.zeros(400, np.int64))
    for a, b in ((50, 130), (131, 390)):
        inner, ilow, ihigh = substrings.parse(h[a:b], np.zeros(b - a, np.int64))
        there = {(n, x - a, y - a) for n, x, y in zip(name.tolist(), low.tolist(), high.tolist(), strict=True) if x >= a and y <= b}
        here = {(n, x, y) for n, x, y in zip(inner.tolist(), ilow.tolist(), ihigh.tolist(), strict=True) if x >= 0 and y <= b - a}
        assert there == here and there


# ---------------------------------------------------------------- op3


def test_token_counts(rows, docs, empty):
    library = token_counts.whole(BYTE_BPE)
    want = sorted(repr((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512)) for i, t, *_ in rows)
    assert sorted(repr(tuple(r)) for r in token_counts.count_tokens(docs, BYTE_BPE).collect()) == want
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


def test_pretokens_follow_the_library():
    library, rng = token_counts.whole(BYTE_BPE), random.Random(2)
    alphabet = "aB1 \n\t'sé中²½٣ \x1c\x85\xa0​͸\U0001e2ff\U0001f600<|endoftext|>_-"
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=30))
        counts, extra = token_counts.pretokens(text, BYTE_BPE)
        words = list(counts)
        assert extra + int((token_counts.piece_counts(words, BYTE_BPE) * [counts[w] for w in words]).sum()) == len(library.encode(text, add_special_tokens=False))


# ---------------------------------------------------------------- op4


def brute_print(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(rows, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    assert sorted(repr((r.doc_id, r.fingerprint)) for r in got) == sorted(repr((i, f"{p:016x}")) for i, p in prints)
    assert {r.component_id for r in got if r.doc_id in (41, 42, 40)} == {40}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({r.component_id for r in got} - {None})


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3, 4, 6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = dict(map(tuple, graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "p long"))).collect()))
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(v, v) == find(v) for v in signed)


def test_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    monkeypatch.setattr(simhash, "CHUNK", 4)
    chain = [0]
    for b in range(20):
        chain.append(chain[-1] ^ (0b111 << (3 * b)))
    got = dict(map(tuple, graph.components(simhash.links(spark.createDataFrame([(v,) for v in chain if v < 1 << 63], "p long"))).collect()))
    assert set(got.values()) == {0}


# ---------------------------------------------------------------- op5


def test_language_id(spark, data, docs, empty):
    whole = spark.read.parquet(f"{data}/documents.parquet")
    r = langid.identify(whole).join(whole.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 0.9
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and {x.lang_pred for x in got} <= {"en", "fr", "und"} and all(0 <= x.score <= 1 for x in got)
    assert all(x.lang_pred == "und" for x in got if x.doc_id in (40, 41, 42))
    assert langid.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.identify(unlabelled).collect()} == {"und"}
    foreign = spark.createDataFrame([(10_001, "съешь ещё этих мягких французских булок да выпей чаю " * 5, None, "s", 1)], SCHEMA)
    assert langid.keep_identified(whole.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(foreign)).filter("doc_id = 10001").count() == 0


# ---------------------------------------------------------------- op6

ITEM = "Alice has 12 apples and gives Bob 3 kg of flour, so how many apples does Alice have?"


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one two"), (5, "six plain words make one item")], "item_id long, text string")
    texts = [ITEM, "So: in it Carol has 7 apples and gives Dan 4kg of flour, so how many apples does Carol have? Yes.", "In it Carol has 7 apples and gives Dan 4 kg of flour, so how many apples does Dan have?", "Nothing to see here at all, one two", "here: six plain words make one item", None]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {(r.doc_id, r.item_id) for r in decontam.find_contaminated(d, items).collect()} == {(0, 1), (1, 1), (3, 4), (4, 5)}
    assert [r.doc_id for r in decontam.drop_contaminated(d, items, least=5).orderBy("doc_id").collect()] == [2, 3, 5]
    assert decontam.find_contaminated(docs, items.limit(0)).count() == 0 and decontam.drop_contaminated(empty, items).count() == 0


def test_every_planted_item_is_found(spark, data):
    d, b = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    want = {(x.doc_id, y.item_id) for x in d.collect() for y in b.collect() if flat(y.text) in flat(x.text)}
    assert want and want == {(r.doc_id, r.item_id) for r in decontam.find_contaminated(d, b).collect()}


# ---------------------------------------------------------------- op7


def test_pieces_follow_the_library(rows, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = sentencepieces.encode_documents(docs, PIECES)
    assert encoded.columns == [*docs.columns, "piece_ids"]
    decoded = sentencepieces.decode_documents(encoded, PIECES).collect()
    assert all(r.piece_ids == library.encode(r.text or "") and r.decoded == (r.text or "") for r in decoded)
    assert sentencepieces.digests(docs, PIECES).filter("round_trip").count() == len(rows) and sentencepieces.digests(empty, PIECES).count() == 0
    codec, rng = sentencepieces.codec(PIECES), random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices("abcdeinth  ▁\n\t\rABß中😀​\x00\x1f<s>''—", k=25))
        assert codec.encode([text])[0].tolist() == library.encode(text)


# ---------------------------------------------------------------- op8


def test_licenses(spark, docs, empty):
    body = licenses.KNOWN[0][1].split("\n", 1)[1]
    texts = ["MIT LICENSE\n\nCopyright (c) 2020 A. Person\n\n" + body.replace(" ", "\n  ").upper(), body.replace("sublicense", "sub-licence"), "some text\n* Released under the MIT licence *", None, ""]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == ["MIT", "MIT", None, None, None] and got[2].notices == "MIT" and got[3].digest == got[4].digest
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


# ---------------------------------------------------------------- op9


def test_shards(rows, docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert any((r.doc_id, r.size, r.text_crc32) == (i, len(raw) + 1, zlib.crc32(raw)) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and {r.law for r in got} == {"key"}
    scores = lambda i, n: max(range(n), key=lambda s: int(hashlib.md5(f"1:{s}:{'null' if i is None else i}".encode()).hexdigest()[:12], 16))
    assert all((r.shard, r.grown_shard) == (scores(r.doc_id, 8), scores(r.doc_id, 9)) for r in got)
    assert sharding.shard_documents(empty).count() == 0


def test_weighted_shards(spark):
    got = Counter(r.s for r in sharding.assign_shards(spark.range(8000), "id", [1, 3], "s").collect())
    assert 0.7 < got[1] / 8000 < 0.8


# ---------------------------------------------------------------- op10


def test_fingerprints(rows, docs, empty):
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := words_of(t)) > 4 else {tuple(w)}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)))
    got = fingerprints.fingerprint_documents(docs).collect()
    errors, by_hash = [], {}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = next(r for r in got if (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        by_hash.setdefault(t, set()).add(r.fingerprint)
        a, b, c = shingles(t), shingles(edited), shingles(after)
        errors += [r.near_edited - len(a & b) / len(a | b), r.near_next - len(a & c) / len(a | c)]
    assert all(len(x) == 1 for x in by_hash.values()) and len({next(iter(x)) for x in by_hash.values()}) > 40
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_ranges_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    ids = random.Random(8).sample(range(10_000), 60) + [77_777] * 40 + [None]
    frame = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, id long").repartition(3)
    got = fingerprints.before_each(frame, ["doc_id", "id"], ["id"]).collect()
    want = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
    assert sorted((r.id, r.before_id) for r in got) == sorted(zip(want, want[-1:] + want[:-1], strict=True))
