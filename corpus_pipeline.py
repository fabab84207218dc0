"""The training-corpus pipeline: each stage calls one operator of ``wordloom.llm`` on what the stage before it kept.

A stage is ``f(spark, docs, sf_dir)``; what it returns is written as Parquet in
the shared folder and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, exact_dedup, language_id, packing, simhash
from wordloom.operators.ranking import materialize
from wordloom.session import table

MIN_LANGUAGE_SHARE = 0.5    # of a text's letters that one language must label


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language labels most letters; text without a letter goes."""
    seen = F.coalesce(~language_id.held_out(), F.lit(True))
    longest = max(map(len, docs.columns))
    language, share = "language".ljust(longest + 1, "_"), "share".ljust(longest + 1, "_")     # names that no column has
    found = language_id.identify(docs, language_id.train(docs.filter(seen)), spans=False, added=(language, share, ""))
    return found.filter((F.col(language) != language_id.UND) & (F.col(share) >= MIN_LANGUAGE_SHARE)).drop(language, share)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays."""
    return simhash.survivors(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence."""
    return packing.pack(docs, added_tokens=True)


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

# Language models, fingerprints and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
