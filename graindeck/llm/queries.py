"""Queries of the corpus operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graindeck.llm import chosen_path, crf_langid, fm_toxicity, katz, license_minhash, mixing, risk_rules, rule_ensemble, secret_markov, wu_manber
from graindeck.llm.common import fold, read

#: Weights of the mixture; names that are missing weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 3.0, "d1": 2.0}, "lang": {"en": 4.0, "de": 2.0}, "source": {"src0": 0.5}}
#: Share of all tokens that the mixture takes, the epochs a leaf can give, and the seed of their orders.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 20


def domain() -> Column:
    """The tables have no domains: sources are dealt to four by their number."""
    return F.concat(
        F.lit("d"),
        (
            F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0)).cast("int") % 4
        ).cast("string")
    )


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, read(spark, sf_dir, "labels"))
    out = rule_ensemble.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), domain(), MIX_WEIGHTS, F.col("total_tokens") * MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(read(spark, sf_dir, "documents"))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = crf_langid.predict(docs, crf_langid.fit(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op5_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = fm_toxicity.score(docs, fm_toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_markov.scan(docs, secret_markov.fit(docs))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"))


def op10_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_minhash.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_rule_ensemble, op2_hierarchical_mix, op3_chosen_path_join, op4_crf_language, op5_factorization_toxicity, op6_risk_rules, op7_markov_secrets,
        op8_wu_manber, op9_katz_backoff, op10_license_minhash
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from graindeck.llm import oracle

    return oracle.oracle_sql()
