"""The bounded sample of labelled documents."""

from pyspark.sql import functions as F

from kmerloom.llm import langid


def test_a_rare_language_is_learned_from_a_bounded_sample(spark):
    common = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the common words of the first language").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(4000, 4008).select(F.col("id").alias("doc_id"), F.lit("quelques mots rares du second idiome").alias("text"), F.lit("fr").alias("lang"))
    assert set(langid.learn(common.unionByName(rare), most=40).langs) == {"en", "fr"}
