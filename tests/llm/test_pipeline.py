"""The pipeline's stages on the small tables."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from gleaner.llm import blocks, queries, sentencepieces


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        n = docs.count()
        assert 0 < n <= before
        before = n
        if k < 4:
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "n_pieces", "piece_ids", "decoded"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(r.decoded == texts[r.doc_id] for r in docs.collect())


def test_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_batches_are_bounded_and_workers_one_a_task(spark, data):
    docs = spark.createDataFrame([(k, "word " * 400_000, "en", "s", 2_000_000) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    made = corpus_pipeline.sentencepiece(spark, docs.coalesce(1), data)
    rows = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in rows) == 6 and max(r.n for r in rows) <= 3
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(r.decoded == "word " * 400_000 and r.n_pieces == len(r.piece_ids) for r in made.collect())


def test_round_trips_equal_encoding_and_decoding(spark, data):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " a  b\n")], "doc_id long, text string"))
    want = sentencepieces.decode_documents(sentencepieces.encode_documents(docs, path), path).drop("text")
    got = sentencepieces.round_trips(docs, path)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_messages_of_blocks_take_one_worker(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")

    def emit(name, table, got):
        yield 0, name.encode()
        yield 1, str(table.column("doc_id").to_pylist()).encode()

    want, got = blocks.emitted(blocks.blocks(docs, block_bytes=1 << 16), emit), blocks.emitted_by_blocks(docs, emit, block_bytes=1 << 16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 8
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
