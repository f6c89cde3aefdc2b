"""A corpus pipeline of five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``, others than those of ``documents`` too.  Between stages the
rows are written as Parquet in the shared folder and read again, so a lost executor repeats one
stage at most; a stage's own tables, and the one before it, are deleted then.

Defined results, at every stage: no documents give none; a null text counts as an empty one
(and stays null in what is kept); rows that repeat a document are judged alike; columns with
other names are kept, whatever they are called; very long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm import bpe, decontaminate, nearcopies, quality, secret_scan
from fieldweave.llm.queries import RANKS
from fieldweave.llm.shared import discard, finished, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fitted trees reject go.

    Null and empty texts have no words, so the base rules reject them.  Without labels, or with
    labels of one class only, there are no trees and the base rules decide alone.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near copies stays.

    Texts without words are one class.  Of rows with one doc_id one stays; rows without a doc_id stay.
    """
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Without a benchmark, and for null or empty texts, nothing is found and all stay.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, span for span as ``op1_secret_scans`` reports them; all documents stay.

    A null text stays null.  ``n_chars`` follows the text where it is a column.
    """
    return secret_scan.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it.  A null or empty text has no ids."""
    return bpe.tokenise(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]
#: Fitted trees, sampling and BPE have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
