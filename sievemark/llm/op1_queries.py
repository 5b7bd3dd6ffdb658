"""Query of benchmark decontamination over `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.decontaminate import GRAM, K1, LEAST_OVERLAP, LEAST_SCORE, LONGER, SHORT, B, contaminated
from sievemark.sources.tables import spread


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}

_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '')"
_ANSWER = r"(?is)^(.*?\S)\s*(?:\banswer\s*:|\ba\s*:|\?\s+)\s*(\S.*)$"
_SENTENCE = r"(?s)^(.*[.!?])\s+(\S.*)$"
_PARTS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
_grams = lambda words, n: f"list_distinct(list_transform(range(1, greatest(len({words}) - {n} + 2, 1)), lambda i: array_to_string(({words})[i:i + {n} - 1], ' ')))"


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sizes, n = [], SHORT
    for _ in range(12):
        sizes.append(f"WHEN len(w) <= {n} THEN {n}")
        n *= LONGER
    return f"""
WITH items AS (SELECT item_id::BIGINT AS item_id, text, {_WORDS.format("text")} AS w, row_number() OVER () AS item FROM benchmark WHERE text IS NOT NULL),
mean AS (SELECT greatest(1.0, avg(len(w))) AS mean, count(*) AS total FROM items),
split AS (SELECT *, regexp_extract(text, {quoted(_ANSWER)}, 1) AS q1, regexp_extract(text, {quoted(_ANSWER)}, 2) AS a1, regexp_extract(rtrim(text), {quoted(_SENTENCE)}, 1) AS q2, regexp_extract(rtrim(text), {quoted(_SENTENCE)}, 2) AS a2, {_PARTS.format("text")} AS p FROM items),
chosen AS (SELECT *, CASE WHEN regexp_matches(text, {quoted(_ANSWER)}) THEN q1 ELSE q2 END AS qq, CASE WHEN regexp_matches(text, {quoted(_ANSWER)}) THEN a1 ELSE a2 END AS aa, greatest(1, len(p) - greatest(1, len(p) // 4)) AS cut FROM split),
halves AS (SELECT item, item_id, w, CASE {" ".join(sizes)} END AS step, CASE WHEN fits THEN qq ELSE array_to_string(p[1:cut], ' ') END AS q, CASE WHEN fits THEN aa WHEN len(p) > cut THEN array_to_string(p[cut + 1:], ' ') ELSE text END AS a FROM (SELECT *, aa <> '' AND len({_PARTS.format("aa")}) >= 3 AS fits FROM chosen) WHERE len(w) > 0),
parts AS (SELECT item, item_id, step, w, {_WORDS.format("q")} AS q, {_WORDS.format("a")} AS a FROM halves),
grams AS (SELECT item, item_id, step, least({GRAM}, len(q)) AS nq, least({GRAM}, len(a)) AS na, {_grams("q", f"least({GRAM}, len(q))")} AS gq, {_grams("a", f"least({GRAM}, len(a))")} AS ga FROM parts),
tf AS (SELECT item, step, len(w) AS size, x, count(*) AS tf FROM (SELECT item, step, w, unnest(w) AS x FROM parts) GROUP BY ALL),
df AS (SELECT x, count(*) AS df FROM tf GROUP BY x),
raw AS (SELECT item, step, x, ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean)) AS s FROM tf JOIN df USING (x), mean),
impact AS (SELECT item, step, x, s / sum(s) OVER (PARTITION BY item) AS s FROM raw),
d AS (SELECT doc_id::BIGINT AS doc_id, row_number() OVER () AS d, {_WORDS.format("text")} AS w FROM documents),
places AS (SELECT d, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
passages AS (SELECT DISTINCT d, step, i // step + k AS p, x FROM places, (SELECT DISTINCT step FROM parts), range(2) AS r(k) WHERE x IN (SELECT x FROM df)),
found AS (SELECT d, item, step, p, round(sum(s), 9) AS score FROM passages JOIN impact USING (step, x) GROUP BY d, item, step, p HAVING sum(s) >= {LEAST_SCORE} - 1e-9),
near AS (SELECT found.*, doc_id, item_id, greatest(0, (p - 1) * step) AS a, least(len(w), (p + 1) * step) AS b, w[(greatest(0, greatest(0, (p - 1) * step) - step) + 1):least(len(w), least(len(w), (p + 1) * step) + step)] AS n, nq, na, gq, ga FROM found JOIN d USING (d) JOIN grams USING (item, step)),
shares AS (SELECT *, CASE WHEN nq = 0 THEN 1 ELSE len(list_intersect(gq, {_grams("n", "nq")}))::DOUBLE / len(gq) END AS qo, CASE WHEN na = 0 THEN 1 ELSE len(list_intersect(ga, {_grams("n", "na")}))::DOUBLE / len(ga) END AS ao FROM near),
best AS (SELECT *, row_number() OVER (PARTITION BY d, item ORDER BY least(qo, ao) DESC, score DESC, qo DESC, ao DESC, a DESC, b - a DESC) AS k FROM shares)
SELECT doc_id, item_id, round(score, 6) AS score, round(qo, 6) AS question_overlap, round(ao, 6) AS answer_overlap, a::BIGINT AS first_word, (b - a)::BIGINT AS n_words FROM best WHERE k = 1 AND least(qo, ao) >= {LEAST_OVERLAP}"""


ORACLES = {"op1_benchmark_decontamination": _oracle()}
