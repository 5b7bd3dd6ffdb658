"""Query of mixing sources over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.mixing import EPOCHS, SEED, mix

DOMAINS = ("web", "books", "code", "forum")
#: Target weights of domains, and of languages within a domain; the sources of a language weigh the same.
WEIGHTS = {"domain": {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
#: The budget as a share of all tokens.
SHARE = 0.6


def domain() -> Column:
    """Sources have no domain in the tables; each is put in one by its name."""
    names = F.array(*map(F.lit, DOMAINS))
    return F.when(F.col("source").isNotNull(), F.element_at(names, (F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long") % len(DOMAINS) + 1).cast("int")))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", domain())
    return mix(documents, SHARE, WEIGHTS).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


QUERIES = {"op2_mixing_sources": op2_mixing_sources}


def _level(depth: int) -> str:
    """CTEs that share a budget among the children of one level: full ones in the order of supply / weight, the rest at one level."""
    names = ("domain", "lang", "source")
    own, parent = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
    weights = WEIGHTS.get(names[depth])
    weight = f"CASE {names[depth]} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items())} ELSE 0 END" if weights else "1.0::DOUBLE"
    budget = f"(SELECT {SHARE} * sum(n_tokens) FROM rows)" if not depth else f"(SELECT budget FROM b{depth - 1} y WHERE {' AND '.join(f'y.{n} IS NOT DISTINCT FROM x.{n}' for n in names[:depth])})"
    by = f"PARTITION BY {parent} " if depth else ""
    return f"""
c{depth} AS (SELECT *, {budget} AS given, {weight} AS weight FROM (SELECT {own}, sum(supply) AS supply FROM usable GROUP BY {own}) x),
l{depth} AS (SELECT *, greatest(0, given - coalesce(sum(supply) OVER ({by}ORDER BY supply / weight, {names[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by}ORDER BY supply / weight, {names[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c{depth}),
b{depth} AS (SELECT {own}, least(supply, coalesce(max(CASE WHEN level * weight < supply THEN level END) OVER ({by}) * weight, supply)) AS budget FROM l{depth})"""


ORACLES = {
    "op2_mixing_sources": f"""
WITH rows AS (SELECT doc_id, lang, source, CASE WHEN source IS NOT NULL THEN ([{", ".join(f"'{d}'" for d in DOMAINS)}])[('0x' || substr(md5(source), 1, 8))::BIGINT % {len(DOMAINS)} + 1] END AS domain, ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS n_tokens FROM documents),
usable AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE * {EPOCHS} AS supply, sum(n_tokens) AS size FROM rows WHERE domain IN ({", ".join(f"'{k}'" for k in WEIGHTS["domain"])}) AND lang IN ({", ".join(f"'{k}'" for k in WEIGHTS["lang"])}) GROUP BY ALL HAVING sum(n_tokens) > 0),
{",".join(_level(d) for d in range(3))},
plan AS (SELECT domain, lang, source, least(floor(budget / size), {EPOCHS})::BIGINT AS whole, budget, size FROM b2 JOIN usable USING (domain, lang, source) WHERE budget > 0),
placed AS (SELECT rows.*, whole, CASE WHEN whole >= {EPOCHS} THEN 0 ELSE budget - whole * size END AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{SEED}:' || whole || ':' || doc_id), 1, 15))::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM rows JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range((whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT))::INT AS epoch, n_tokens FROM placed
""",
}
