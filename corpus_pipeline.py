"""From raw documents to packed sequences: language, near-duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir), where docs are the rows its predecessor
kept, and returns a DataFrame.  Each result is written as Parquet and read back
before the next stage.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tritmarts.llm import language, mixing, near_texts, packing, secrets
from tritmarts.llm.tables import row_key, written

#: a document is rejected without a letter, or if its best language stands out by less than this (language.sureness)
LEAST_SURE = 0.05


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is learned from the stage's own input.

    Where nothing can be learned, no row being labelled, all documents with letters stay.
    """
    model = language.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.identify(docs, model)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("sure") >= LEAST_SURE)).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id (a null id comes last), of several the least row key.

    Candidates meet by SimHash fingerprints, as in op2 but over five words, and by MinHash bands; groups are
    linked by their Jaccard similarity of 0.8 or more of five-word shingles.
    Rows of one doc_id with different texts are in different groups, and each counts for its own.
    """
    groups = written(near_texts.near_texts(docs), "text_groups")
    first = groups.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("kept")).select("kept.row")
    one = docs.select(F.struct("*").alias("r"), row_key(*docs.columns).alias("row")).join(first, "row", "left_semi")
    repeated = groups.groupBy("row").count().where("count > 1").join(first, "row", "left_semi").select("row")
    if repeated.isEmpty():
        return one.select("r.*")
    single = one.join(repeated, "row", "left_anti")
    return single.union(one.join(repeated, "row", "left_semi").dropDuplicates(["row"]).select(single.columns)).select("r.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars counted again."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mixture: a document drawn twice is two rows."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: the first, second and last stage learn a model, hash word shingles and tokenize: SQL cannot state them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
