"""Documents to token ids in five stages, each written before the next one reads it.

In every stage but the last all columns stay, whatever their names; null, empty, blank and very
long texts, ties, repeated rows and empty tables have the results that the stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadrift.llm import bpe, decontaminate, lines, near_copies, quality
from cadrift.llm.common import free_name, table
from cadrift.session import cut, cuts, drop_cuts

ORACLE_SQL = None  # a fitted classifier has no SQL; tests/llm compares the stages with brute force


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, at the threshold of its query.

    Null and empty texts have the score of the prior; equal texts have equal scores, so repeated rows
    stay or go together. Without labels all scores are a half and all rows stay.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return quality.score(docs, weights, name).filter(F.col(name) >= 0.3).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in the first document that holds them.

    Null texts stay null. Rows of one id are one document, so repeated rows lose nothing to each other.
    """
    return lines.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: 0.8 of their runs of five words are shared.

    Linked by SimHash fingerprints that are near, verified on the whole texts; prefix filtering then
    finds the links that fingerprints miss. Null, empty and blank texts are one group; rows repeated
    in id and text are one document, of equal ids one row stays.
    """
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts hold none; repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the text they decode to; a null text has no ids."""
    return bpe.encode(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies),
          ("decontaminate", drop_contaminated), ("bpe", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage has written for itself goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = cuts()
        docs = cut(stage(spark, docs, sf_dir))
        drop_cuts(spark, [p for p in cuts()[:-1] if p not in before])
    return docs
