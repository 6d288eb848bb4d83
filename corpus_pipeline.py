"""The corpus pipeline: toxic documents go, then exact and near copies, then sources are mixed and documents packed.

Each stage takes the rows that its predecessor kept and returns rows with the columns of `documents`; the last returns
pieces of token sequences. `STAGES` lists them for callers that write each stage's rows and read them again; `run` does
that in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factflow.cluster import ship
from factflow.llm import exact_dedup, mixing, packing, simhash, toxicity
from factflow.llm.common import stored, table

#: Near copies in this pipeline: words to a shingle.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of op4. Null and empty texts stay."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    ship(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a shingle similarity of 0.8 or more the document with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs, shingle=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: from not at all to three times."""
    ship(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents (repeats included) with their sequence and their place in it."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pareto_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
