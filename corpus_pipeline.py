"""A corpus in five stages. Each stage's result is written as Parquet to the shared folder and read again as the next one's documents.

Quality rules drop what they reject; of each class of near duplicates (five-word n-grams, Jaccard 0.8 or more) one row stays,
with the smallest doc_id (null is the largest) and, among equal ids, the text of the smallest hash; personal data and secrets get surrogates; sources are mixed to their target weights, so that a document may
come up to three times or not at all; the copies are packed into sequences of 4,096 tokens.

Rows without a word can't pass the first stage. Unlike texts stay, whether their ids are null, equal or different; of rows
that repeat both id and text one stays. All stages but the last keep the columns of
``documents``, extra ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridax.llm._scratch import staged
from meridax.llm.ngram_jaccard import classed_texts, text_key
from meridax.llm.packing import packed
from meridax.llm.pii_surrogates import with_surrogates
from meridax.llm.quality_rules import quality_filter
from meridax.llm.source_mixing import mix_rows
from meridax.llm.tokenizing import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    texts = classed_texts(spark, docs, words=5, num=80)
    keep = texts.where("class is not null").groupBy("class").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key")
    keep = keep.unionByName(texts.where("class is null").select("doc_id", "text_key").distinct()).toDF("keep_id", "keep_key")
    keyed = docs.withColumn("__text_key", text_key(docs["text"]))
    same = keyed["doc_id"].eqNullSafe(keep["keep_id"]) & (keyed["__text_key"] == keep["keep_key"])
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_surrogates(spark, docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(spark, docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Tokenizing and linear programs aren't SQL; the tests hold the result against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
