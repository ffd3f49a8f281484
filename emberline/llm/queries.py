"""Registry of the corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import (
    op01_divergence,
    op02_chat,
    op03_suffix,
    op04_langid,
    op05_mix,
    op06_bpe,
    op07_minhash,
    op08_quality,
    op09_crosspolytope,
    op10_toxicity,
    op11_runs,
    op12_search,
    op13_lloyd,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op01_divergence.query,
    "op2_perspectives": op02_chat.query,
    "op3_suffix_dedup": op03_suffix.query,
    "op4_langid": op04_langid.query,
    "op5_mix": op05_mix.query,
    "op6_bpe": op06_bpe.query,
    "op7_minhash": op07_minhash.query,
    "op8_quality": op08_quality.query,
    "op9_crosspolytope": op09_crosspolytope.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_runs": op11_runs.query,
    "op12_search": op12_search.query,
    "op13_lloyd": op13_lloyd.query,
}
ORACLES: dict[str, str] = {
    "op1_divergence": op01_divergence.ORACLE,
    "op2_perspectives": op02_chat.ORACLE,
    "op5_mix": op05_mix.ORACLE,
    "op13_lloyd": op13_lloyd.ORACLE,
}
