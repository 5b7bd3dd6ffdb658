"""Query of HTML extraction over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.html_text import extract


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict[str, str] = {}
