"""The corpus pipeline: each stage's output is written as Parquet and read again as the next stage's documents.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go, the rest is repeated to
match the domain weights (no document is dropped by mixing), and the result is encoded into token files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import decontamination, mixing, simhash, tokens, toxicity
from usagelens.llm.shared import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("near_dedup", simhash.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("tokens", tokens.stage),
]

#: The classifiers and the tokenizer have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
