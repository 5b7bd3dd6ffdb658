"""Query of token counts over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.token_counts import count_tokens
from sievemark.sources.tables import spread


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
