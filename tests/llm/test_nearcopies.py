"""The near-dedup stage against brute force."""

import random

import corpus_pipeline
from gleaner.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def brute_kept(rows):
    """doc_ids that stay; rows are (doc_id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


def near_rows():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 12, 80, 300]))) for _ in range(40)]
    # From a word that is changed here and there to more than the similarity allows.
    texts += [edited(rng, t, n) for t in texts for n in (1, 2, 4, 6, 9) if len(t.split()) >= max(80, n * 10)]
    texts += ["", None, " \n", texts[0].upper(), texts[3]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, t) for d, t in zip(order, texts, strict=True)]


def frame(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    rows = near_rows()
    docs = frame(spark, rows, tmp_path)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = brute_kept(rows)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(rows) - 60
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_hot_components_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 8)
    monkeypatch.setattr(nearcopies, "CHUNK", 4)
    words = [f"w{k}" for k in range(100)]
    # Each text is linked to the next ones only.
    rows = [(k, " ".join(words[k:] + [f"x{j}" for j in range(k)])) for k in range(0, 60, 4)] + [(1000, " ".join(words)), (1001, " ".join(words[:50]))]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows, tmp_path), "")
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_stage_on_the_small_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()) == brute_kept(rows)


def test_pigeonring_links_what_is_near(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(900)) for _ in range(30)]
    rows = list(enumerate([*texts, *(edited(rng, t, 1) for t in texts), "", None]))
    slim = frame(spark, rows, tmp_path).selectExpr("doc_id as _row", "doc_id", "text")
    nodes = nearcopies._nodes(slim, 5).dropDuplicates(["node"])
    prints = {r.node: r.print for r in nodes.collect()}
    assert sorted(p is None for p in prints.values()) == [False] * 60 + [True]
    doc = {r.node: r.doc_id for r in nodes.collect()}
    pairs = [(r.a, r.b) for r in nearcopies._ringed(nodes).collect()]
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and None not in (prints[a], prints[b]) and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3}
    assert {frozenset(p) for p in pairs} == want and len(want) > 10
    assert all(abs(doc[a] - doc[b]) == 30 for a, b in pairs)


def test_stage_goes_by_the_pigeonring_first(spark, tmp_path, monkeypatch):
    rows = near_rows()
    # Without min-hash keys only the pigeonring's links are left, and those are found.
    monkeypatch.setattr(nearcopies, "band_keys", lambda sets, made=nearcopies.band_keys: ([k[:0] for k in made(sets)[0]], made(sets)[1]))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows, tmp_path), "").collect())
    assert len(brute_kept(rows)) < len(got) < len({frozenset(shingles(t)) for _, t in rows})
