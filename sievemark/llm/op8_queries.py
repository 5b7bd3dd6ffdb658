"""Query of media columns over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.matroska import media_columns
from sievemark.sources.tables import spread


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), with_file=False).drop("media")


QUERIES = {"op8_media_columns": op8_media_columns}
ORACLES: dict[str, str] = {}
