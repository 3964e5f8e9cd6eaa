"""A corpus pipeline: toxic documents out, near duplicates to one, secrets redacted, sources mixed, sequences packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; the last returns one row per packed piece. Documents that the mix uses more than once are packed once for each
use. Rows without doc_id pass every stage but are never judged near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotgap.llm import jaccard, mixing, packing, secret_scan, toxicity
from plotgap.llm.base import discard, release, stored, table
from plotgap.llm.queries import MIX, tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more leave."""
    return toxicity.reject(docs, toxicity_model(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates stays, the one of the smallest doc_id."""
    return jaccard.one_each(docs, threshold=0.75)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is used once at least, those of sources below their weight again."""
    return mixing.mixed(docs, **MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first stage applies a fitted model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            discard(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
