"""Documents to training sequences, in five stages; each takes what the one before has kept.

1. The co-trained quality classifier drops documents that it rejects.
2. The quality rules drop documents that they reject.
3. Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the first document stays.
4. Passages of 200 bytes or more that occur earlier are cut out of the texts; a document without text left goes on
   with an empty text.
5. Documents are tokenized and packed into sequences of 2048 tokens: a row per piece.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. Models are fitted on labelled documents of the whole
table, also where a stage is given fewer: the documents that stage 1 drops are the examples of poor ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from primerflow.llm import cotraining, packing, quality_rules, simhash, suffix_dedup
from primerflow.llm.common import table, written
from primerflow.llm.text_model import Linear
from primerflow.llm.vocab import public


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def rules_model(spark: SparkSession, sf_dir: str) -> Linear | None:
    """The classifier of the quality rules, fitted on labels that have a document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.train(docs, table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, rules_model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs, keep_first=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: No SQL: fitted models and byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
