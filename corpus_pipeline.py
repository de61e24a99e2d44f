"""A corpus from raw documents to packed sequences; each stage works on all that the one before kept.

1. quality: documents the classifier rejects go. It learns from the labelled documents whose key is not held out.
2. near_duplicates: one document of each group of similar texts stays, that with the smallest id.
3. decontamination: documents that hold benchmark passages, by the contamination rule, go.
4. secrets: findings the forest confirms are replaced in the text, and ``n_chars`` follows.
5. packing: token pieces in sequences; the pieces are the result.

Null texts count as empty: the classifier judges them, one empty document can stay, and it is packed as its
end token. All columns of the documents pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from httplens.llm import contamination, jaccard, packing, quality, secrets
from httplens.llm.queries import table, tokenizer_files
from httplens.llm.rows import free_name
from httplens.session import scratch_path

# SQL has no boosted trees, forests or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out("doc_id")))
    return docs.where(quality.score("text", model) >= 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name("contamination", docs.columns)
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), column=name)
    return found.where(~F.col(f"{name}.contaminated")).drop(name)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known, forest = secrets.scanner(docs)
    clean = docs.withColumn("text", secrets.redacted("text", secrets.scored("text", known, forest)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, *tokenizer_files())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", untested),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
