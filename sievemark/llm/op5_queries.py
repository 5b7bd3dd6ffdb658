"""Query of language identification over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.language_id import LONGEST, SMOOTH, UND, Model, predict, train
from sievemark.sources.tables import spread

FOLDS = 5


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def learn(documents: DataFrame) -> Model:
    """From the rows that are not held out."""
    return train(documents.where(fold() != 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "lang")
    found = predict(documents.select("doc_id", "text"), learn(documents))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


QUERIES = {"op5_language_id": op5_language_id}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


#: The remainder of a text's CRC-32.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {FOLDS}"
_GRAMS = ", ".join(f"list_transform(CASE WHEN length(w) + {2 if k > 1 else 0} >= {k} THEN range(1, length(w) + {2 if k > 1 else 0} - {k} + 2) ELSE [] END, lambda i: {{'k': {k}, 'g': substr({"'^' || w || '$'" if k > 1 else 'w'}, i, {k})}})" for k in range(1, LONGEST + 1))

# The same on tables of at most MAX_ROWS rows and MAX_BYTES bytes a language, of which every row is learned from.
ORACLES = {
    "op5_language_id": f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, text, lang, coalesce({_CRC} = 0, false) AS held FROM documents),
words AS MATERIALIZED (SELECT d, w, count(*) AS n FROM (SELECT d, lower(unnest(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'))) AS w FROM docs) GROUP BY ALL),
taught AS MATERIALIZED (SELECT lang, w, sum(n) AS n FROM words JOIN docs USING (d) WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held GROUP BY ALL),
langs AS (SELECT DISTINCT lang FROM taught),
vocabulary AS MATERIALIZED (SELECT DISTINCT w FROM taught),
sizes AS (SELECT lang, sum(n) + {SMOOTH} * (SELECT count(*) FROM vocabulary) AS size FROM taught GROUP BY lang),
scored AS (SELECT w, lang, ln((coalesce(n, 0) + {SMOOTH})::DOUBLE / size) AS s FROM vocabulary CROSS JOIN sizes LEFT JOIN taught USING (w, lang)),
grams AS MATERIALIZED (SELECT lang, g, sum(n) AS n FROM (SELECT lang, n, unnest(flatten([{_GRAMS}])).g AS g FROM taught) GROUP BY ALL),
parts AS MATERIALIZED (SELECT DISTINCT g FROM grams),
gram_sizes AS (SELECT lang, sum(n) + {SMOOTH} * (SELECT count(*) FROM parts) AS size FROM grams GROUP BY lang),
fresh AS MATERIALIZED (SELECT w, unnest(flatten([{_GRAMS}])) AS x FROM (SELECT DISTINCT w FROM words ANTI JOIN vocabulary USING (w) WHERE regexp_matches(w, '\\p{{L}}'))),
known AS (SELECT w, x.k AS k, x.g AS g FROM fresh WHERE x.g IN (SELECT g FROM parts)),
longest AS (SELECT w, max(k) AS k FROM known GROUP BY w),
backed AS (SELECT w, gram_sizes.lang AS lang, avg(ln((coalesce(n, 0) + {SMOOTH})::DOUBLE / size)) AS s FROM known JOIN longest USING (w, k) CROSS JOIN gram_sizes LEFT JOIN grams ON grams.g = known.g AND grams.lang = gram_sizes.lang GROUP BY ALL),
lettered AS (SELECT d, w, n FROM words WHERE regexp_matches(w, '\\p{{L}}')),
sums AS (SELECT d, lang, sum(n * coalesce(a.s, b.s, 0)) AS s FROM lettered CROSS JOIN langs LEFT JOIN scored a USING (w, lang) LEFT JOIN backed b USING (w, lang) GROUP BY d, lang),
best AS (SELECT d, arg_min(lang, (-s, lang)) AS lang_pred, max(s) AS top, list(s) AS all_s FROM sums GROUP BY d)
SELECT doc_id, held AS held_out, coalesce(lang_pred, '{UND}') AS lang_pred, coalesce(round(1 / list_sum(list_transform(all_s, lambda x: exp(x - top))), 6), 0) AS score FROM docs LEFT JOIN best USING (d)
"""
}
