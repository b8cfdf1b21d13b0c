"""A training corpus from ``documents``, in five stages.

Quality classifier -> toxicity -> near duplicates -> secrets -> packing. Each
stage reads what the one before it wrote. Scratch tables that a stage's result
does not read are deleted within the stage; the others stay while the process
lives, so a result can be read at any time after other runs.

Defined cases, in every stage: null texts count as empty (and stay null), repeated
rows are judged alike (the third stage keeps one of them), rows with equal scores
are not told apart, other columns are carried along, and an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import op1_prefix_order_join as join
from kinfold.llm import op2_secret_scan as secrets
from kinfold.llm import op4_co_training as quality
from kinfold.llm import op6_minimum_bin_slack as packing
from kinfold.llm import op8_noisy_channel_toxicity as toxicity
from kinfold.llm.common import stored, table, temporary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    with temporary():
        model = quality.train(stored(quality.views(docs)), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    with temporary():
        model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return join.keep_one(docs, words=5, percent=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    pieces = packing.pieces(docs, packing.vocabulary("word_bpe_49k.json"))
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(small)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", single), ("secrets", masked), ("packing", packed)]

#: Classifiers and tokenizers aren't expressible in SQL; tests/llm has the comparison.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
