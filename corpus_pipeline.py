"""A training-text pipeline of five stages over ``documents``.

Each stage takes all rows that the one before kept. All but the last return the columns of
``documents``; the last adds the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm import bpe, line_dedup, mixing, near_duplicates, quality
from assayloom.llm.queries import tokenizer_path
from assayloom.session import shared_folder


#: Texts of which so many percent of the shingles are common are near-duplicates.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is taught by ``labels``. Rejected ones go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; documents of which nothing is left go, empty ones before do not."""
    cleaned = line_dedup.remove_repeated_lines(docs, count="__removed")
    left = cleaned.filter((F.col("__removed") == 0) | F.col("text").rlike(line_dedup.WORD))
    return left.withColumn("n_chars", F.when(F.col("__removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows with a null id stay.

    Rows that share an id are one document: it stays with all its different texts, each once, in the row with the smallest hash.
    """
    kept = near_duplicates.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    plain = [f"`{f.name}`" for f in docs.schema.fields if not f.dataType.simpleString().startswith("map")]
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).orderBy(F.xxhash64(*plain)))
    named = docs.join(kept, F.col("doc_id") == F.col("__kept")).withColumn("__first", first).filter("__first = 1")
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages in the tempered shares; no document comes twice, as the budget is what needs no repetition."""
    return mixing.mix_documents(docs, docs, "lang", budget="once", temperature=0.9)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens, and the digests of tokens and decoded text."""
    encoded = bpe.encode_documents(docs, tokenizer_path(), keep=tuple(docs.columns))
    return bpe.digest(encoded, more=(*docs.columns, "token_ids"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_to_targets", mix_languages),
    ("bpe_encode_decode", tokenize),
]
#: The classifier and the rates have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
