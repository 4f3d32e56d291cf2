"""A corpus pipeline over `documents`: each stage calls one training-data operator on what the stage before kept.

toxicity      documents that the nearest labelled examples mark as toxic go
language      documents without a letter go, and those that fit their class worse than held-out texts do
near_dedup    one document of each group of near-duplicates stays (five-word shingles, similarity 0.8)
suffix_dedup  passages of over 50 words that occur twice are cut out, everywhere
packing       what is left is packed into sequences of 4096 tokens
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, minhash, packing, suffix, toxicity
from quillon.llm.common import materialize, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.keep_known(docs, model, langid.least_scores(docs, model))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, 5, 80)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.without_repeats(docs, suffix.PASSAGE, suffix.WORDS)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [
    ("toxicity", toxic_stage),
    ("language", language_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: No SQL states a trained classifier's decisions; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
