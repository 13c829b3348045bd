"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing to target weights, and tokens.

Defined cases, in every stage: a null text is empty (not toxic, equal to other empty ones, near nothing, taken 0 times); a null
source is a source; null ids come after all others and are never near copies; rows that repeat an id are rows of one
document, which goes as a near copy if any of them does; an empty table gives an empty table; other columns are carried along.
Without any label outside the held-out fold nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import bpe, common, exact_dedup, jaccard, mixing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5. The model is learned from labelled documents outside the held-out fold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest id; of several such rows, one."""
    rows, back = common.aside(docs, exact_dedup.OUT)
    return exact_dedup.exact_dedup(rows).filter("kept").select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, similarity of 0.8 or more) the one with the smallest id."""
    scratch = common.Scratch(spark)
    found = jaccard.jaccard_components(docs, width=5, percent=80)
    drop = scratch.save(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(common.counted_broadcast(drop, drop.count()), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; expected copies rise with the number of words' digits, as in op3."""
    rows, back = common.aside(docs, mixing.OUT)
    mixed = mixing.mix(rows, size_weight=mixing.digits).filter("copies > 0")
    (copy,) = common.unused(mixed.columns, "copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens, with digests of them and of the text that they decode to."""
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Toxicity is a trained model, which SQL can't express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again, then its input deleted."""
    scratch, docs, before = common.Scratch(spark), common.documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
