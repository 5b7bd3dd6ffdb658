"""Query of secret scans over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.secret_scan import IDENTIFIERS, KINDS, PATTERNS, SCOPE, SECRETS, scan
from sievemark.sources.tables import spread


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op9_secret_scans": op9_secret_scans}


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kept = {"assign": f"length(regexp_extract(m, {quoted(PATTERNS['assign'])}, 1)) >= 6", "weak": "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"}
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {r} AS rank, g[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT doc_id, g, p, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {quoted(PATTERNS[k])}) AS g, string_split_regex(coalesce(text, ''), {quoted(PATTERNS[k])}) AS p FROM documents))"
        for r, k in enumerate(KINDS)
    )
    near = lambda kinds: f"EXISTS (SELECT 1 FROM parts x WHERE x.doc_id = parts.doc_id AND x.kind IN ({', '.join(map(quoted, kinds))}) AND (x.b <= parts.a AND parts.a - x.b <= {SCOPE} OR x.a >= parts.b AND x.a - parts.b <= {SCOPE}))"
    text = lambda where: f"string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FILTER ({where})"
    return f"""
WITH found AS (SELECT doc_id, kind, rank, a::BIGINT AS a, (a + length(m))::BIGINT AS b FROM ({each}) WHERE CASE kind WHEN 'assign' THEN {kept["assign"]} WHEN 'weak' THEN {kept["weak"]} ELSE true END),
parts AS (SELECT * FROM found WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM found y WHERE y.doc_id = found.doc_id AND y.rank < 3 AND y.a < found.b AND y.b > found.a)),
kept AS (SELECT * FROM parts WHERE rank < 3 OR kind = 'weak' AND {near(IDENTIFIERS)} OR kind = 'ident' AND {near(SECRETS)} OR kind = 'endpoint' AND {near(IDENTIFIERS)} AND {near(SECRETS)}),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {text("rank < 3")} AS base, {text("true")} AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN sums USING (doc_id)
"""


ORACLES = {"op9_secret_scans": _oracle()}
