"""The documents as training data: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswork.llm import bpe, mixing, neardup, pii, queries, samples, toxicity
from presswork.session import scratch, shared_folder


def unused(name: str, docs: DataFrame) -> str:
    """The name, or one like it, that no column of ``docs`` has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_columns(result: DataFrame, docs: DataFrame) -> DataFrame:
    return result.select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted to the labels that are not held out, does not call toxic.

    Without labels of both kinds it calls none toxic, and all stay.
    """
    labels = queries.table(spark, sf_dir, "labels")
    sample = samples.labelled_sample(docs, labels, "toxic", max_rows=queries.TOXIC_ROWS,
                                     allowed=~queries.held_out("doc_id"))
    name = unused("_toxicity", docs)
    scored = toxicity.score(docs, toxicity.train(sample), name=name)
    return keep_columns(scored.filter(F.col(name) < queries.TOXIC_FROM), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near duplicates, one row of each."""
    return neardup.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data."""
    return pii.replace_entities(docs, queries.PII_KEY, count=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source repeated to its target weight, in a global random order."""
    rates = mixing.repetition_rates(docs, queries.MIX_WEIGHTS)
    mixed = mixing.replicate(docs, rates, queries.MIX_SEED, copy=unused("copy_no", docs), order=unused("mix_key", docs))
    return keep_columns(mixed, docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of the text decoded from them."""
    vocabulary = bpe.share(spark, public_tokenizers.path(queries.WORD_VOCABULARY))
    encoded = bpe.encode(docs, vocabulary, decoded="decoded", keep=["doc_id", "lang", "source"])
    return queries.token_digests(encoded).drop("decoded")


STAGES = [
    ("reject_toxic", reject_toxic),
    ("drop_near_duplicates", drop_near_duplicates),
    ("replace_personal_data", replace_personal_data),
    ("mix_sources", mix_sources),
    ("encode_texts", encode_texts),
]

#: No SQL: learned scores, hashed surrogates and merges are checked by brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read from there.

    What a stage itself wrote on the way is removed when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
