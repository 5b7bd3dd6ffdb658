"""Query of URL filters over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.url_filters import judge

# The rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))
    return spark.range(1).select(F.inline(rows))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules(spark))


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLES = {
    "op4_url_filters": r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
seen AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM seen LEFT JOIN fits ON seen.r = fits.r AND k = 1
""",
}
