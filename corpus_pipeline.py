"""A training-data pipeline of five stages: each takes the documents that the one before kept.

Every stage judges each row by itself where its operator does, so these hold for all: extra columns stay, whatever
their names; an empty table gives an empty table; a text of any length is read whole; results do not depend on the
order or the partitions of the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.llm import chosen_path, fm_toxicity, mixing, secret_markov, wu_manber
from graindeck.llm.common import deleted, read, results_within, shared_dir
from graindeck.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, domain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects (a score of 0.7 or more) go.

    Null and empty texts score the bias, far below that on labels as given, and stay; repeated rows share their fate, by
    their texts; a score of exactly 0.7 (a tie) is a rejection; null ids have no label and are judged like others.
    """
    model = fm_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return fm_toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Null and empty texts are no copies of each other and stay; of repeated rows (equal id and text) and of ties in the
    id one stays for each class; a row with a null id goes if its class has a row with an id.
    """
    return chosen_path.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go.

    Null and empty texts have no words and stay; exactly a twentieth (a tie) is contaminated; repeated rows and rows with
    null ids are each judged by their own text; without benchmark items all stay.
    """
    return wu_manber.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; all documents stay.

    A null text stays null, an empty one empty; spans that overlap or tie are one stretch; repeated rows are each
    redacted.
    """
    return secret_markov.redact(docs, secret_markov.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for the mixture, with their place in the tree and the number of epochs.

    Null and empty texts have no tokens and are not taken; null languages and sources are leaves of their own; rows that
    tie in a leaf's order, repeated ones among them, are taken or left together.
    """
    return mixing.mix(docs, domain(), MIX_WEIGHTS, F.col("total_tokens") * MIX_SHARE, MIX_EPOCHS, MIX_SEED)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]

#: A model trained on samples, near duplicates over any number of links and Markov models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and deleted when the next one is
    there. The last one stays: it is what the returned table reads."""
    docs, before = read(spark, sf_dir, "documents"), None
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES:
            with results_within(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
            docs = spark.read.parquet(f"{home}/{name}")
            if before:
                deleted(spark, f"{home}/{before}")
            before = name
    except BaseException:
        deleted(spark, home)
        raise
    return docs
