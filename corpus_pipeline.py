"""Corpus preparation: stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents too far from every learned language, or without letters, go;
2. near-dedup: of every group linked by a Jaccard similarity of 0.8 or more between the sets of five-word
   shingles the document with the smallest doc_id stays; pigeonring over their SimHashes finds the nearest pairs,
   min-hash keys finish the classes (``nearcopies``), as most SimHashes of such texts differ in more bits than can
   be looked up;
3. substring dedup: words in passages of 35 words or more that start elsewhere too are removed;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: texts become piece ids, with the decoded text beside them.

Stages 1 to 4 return the columns of documents, the last doc_id, n_pieces, piece_ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, langid, nearcopies, sentencepieces, substrings


#: Bytes at most of a batch that goes to a Python worker, unless a row has more; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds batches by bytes: executor and worker each hold some of them at once."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return nearcopies.drop_near_copies(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substrings.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    made = sentencepieces.round_trips(docs.select("doc_id", "text"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return made.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "decoded")


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", sentencepiece)]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared checkpoint folder and read again."""
    import uuid

    from gleaner.llm.blocks import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
