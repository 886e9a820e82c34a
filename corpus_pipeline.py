"""A corpus pipeline: quality rules, quality classifier, near-duplicate join, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, in all stages: null counts as empty text, which the quality rules reject (fewer than 20 words); other nulls
never matter but in doc_id: rows without id link with nothing and stay; rows that repeat an id and its text are one document
after near_duplicates; ties of groups go to the smallest id; an empty table gives no rows; further columns of documents
stay as they are, whatever their names, until the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import piece_spans, quality_rules, rule_ensemble, signature_tree, winnowing
from quern.llm.registry import held_out, model_path
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table

LEAST_SCORE = 0.3


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; null and empty texts go."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of LEAST_SCORE or more; the model learns from labelled rows of the whole documents table.
    Without labels of both kinds all scores are alike, and none is below LEAST_SCORE."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(5, 0))
    model = rule_ensemble.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return rule_ensemble.keep_good(docs, model, LEAST_SCORE)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without words or id stay."""
    return signature_tree.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is hit by benchmark windows; an empty benchmark hits none."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of the ids and of the decoded text, by doc_id; null and empty texts have no ids."""
    return piece_spans.encode(docs, model_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), check_spans=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier, the near-duplicate join and the encoding have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows lie in the shared checkpoint folder, the last stage's input until
    the folder is cleared, earlier ones until the next stage's are written."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
