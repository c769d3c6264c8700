"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage sees all that its predecessor kept, and returns the columns of documents (the last: its token files' rows).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import materialise, table
from heddle.llm.decontamination import without_contaminated
from heddle.llm.mixing import mixed_rows
from heddle.llm.queries import TOKENIZER
from heddle.llm.shingle_dedup import similar_groups
from heddle.llm.simhash_dedup import one_of_each_group
from heddle.llm.token_output import token_output
from heddle.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones calls toxic go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies have a five-word Jaccard of 0.8 or more: SimHash finds those within its radius, which are then compared, and an
    exact search the rest.
    """
    return one_of_each_group(docs, groups_of=similar_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix to the sources' weights draws them. The next stage orders them by id."""
    return mixed_rows(docs)


def output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of every document, read back."""
    return token_output(docs, public_tokenizers.path(TOKENIZER), end_id=2)


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", output)]

#: The stages learn, hash and draw in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
