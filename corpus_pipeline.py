"""The corpus pipeline: documents through five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. What a stage decides takes effect: rejected documents and copies go, repeated passages
are cut from the texts, and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import packing, quality_cnn, quality_rules, simhash, substring_dedup
from ledgerloom.llm.common import stored, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the rules or their model reject go."""
    return quality_rules.keep_quality_rules(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents below the score go.

    The net is fitted on the labelled documents of the whole table, as those that reached this stage are
    nearly all good ones.
    """
    net = quality_cnn.fit_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_cnn.keep_good(docs, net)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies (five-word shingles, 0.8) stays, that with the smallest doc_id."""
    return simhash.keep_first(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: words in windows that an earlier document has are cut."""
    return substring_dedup.cut_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents as pieces of sequences, with their token ids."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
