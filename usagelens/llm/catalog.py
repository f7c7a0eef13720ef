"""Registry of the training-data queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import decontamination, fim, mixing, pii, repeats, resampling, sharding, simhash, tokens, topk, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_tokens": tokens.op4_tokens,
    "op5_urls": urls.op5_urls,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_simhash": simhash.op9_simhash,
    "op10_topk": topk.op10_topk,
    "op11_repeats": repeats.op11_repeats,
    "op12_resampling": resampling.op12_resampling,
    "op13_fim": fim.op13_fim,
}

ORACLE: dict[str, str] = {
    "op6_warc": warc.ORACLE,
    "op10_topk": topk.ORACLE,
    "op12_resampling": resampling.ORACLE,
    "op13_fim": fim.ORACLE,
}
