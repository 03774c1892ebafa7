"""From raw documents to sampled token sequences: language, quality, near-duplicates, mixture, segmentation.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written and reread before
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import langid, mix, neardup, quality, spm
from tracewright.llm.common import crc_mod, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from the lang column of two thirds of them."""
    model = langid.fit(docs, crc_mod("id", 3) != 1)
    return langid.identify(docs, model).where("lang_accepted").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of four fifths of them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return quality.classify(docs, model, threshold=0.3).where("quality_pred = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return neardup.keep_one(docs, shingle_words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mix.mix(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each row."""
    return spm.encode_samples(docs, k=2, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("segmentation", segmentation),
]

#: Trained classifiers and sampled segmentations have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
