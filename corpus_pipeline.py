"""From raw documents to packed token sequences: the stages in order, each an operator of weakspot.llm.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weakspot.llm.chosen_path import one_of_each_class
from weakspot.llm.common import materialize, tokenizer_path
from weakspot.llm.crf import quality_scores
from weakspot.llm.host_rules import without_failures
from weakspot.llm.packing import pack
from weakspot.llm.recompression import without_repeats


#: Words that a worker remembers while packing: fewer than in packing alone, as the stages before have filled the JVM's heap.
WORDS = 250_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return quality_scores(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), keep=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected."""
    return without_failures(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return one_of_each_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of smaller doc_id has."""
    return without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), cache=WORDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: SQL can express neither the classifier nor the packing; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of sf_dir; each stage's result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    spent: list[DataFrame] = []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage", *spent)
            spent = [docs]
    return docs
