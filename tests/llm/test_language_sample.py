"""The training sample of languages whose rows repeat few ids."""

from pyspark.sql import functions as F

from gleaner.llm import langid


def test_repeated_ids_are_learned_from(spark):
    late = spark.range(2000).withColumnRenamed("id", "doc_id").filter((langid._fold() != langid.HELD_OUT) & (langid._pick() > 0.9)).limit(3)
    few = late.crossJoin(spark.range(1000)).select("doc_id", F.lit("fr").alias("lang"), F.lit("les petits chats dorment sous la table").alias("text"))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("the small cats sleep under the table").alias("text"))
    assert langid.fit(few.unionByName(other)).languages == ["en", "fr"]
