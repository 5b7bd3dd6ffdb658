"""Queries of pipelines, anonymization and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.text import regex_spans, severity_of, severity_rank
from sievemark.operators import anonymize as A
from sievemark.operators import metrics as M
from sievemark.operators import quota as U
from sievemark.operators import scanners as S
from sievemark.plans import shield as P
from sievemark.plans import sql as Q
from sievemark.plans.scan_queries import _IPV4, _LUHN, SECRETS_KEPT, _pii_sql, big, probed, six
from sievemark.sources.shared import shared_dir
from sievemark.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


T = "t"

# Pipelines

_TOKENS = "CASE WHEN ceil(strlen(t) / 4.0) <= 500 THEN 0.0 ELSE 1.0 END::DOUBLE"
_REFUSAL = Q.peak(f"list_concat(list_concat({Q.scored_hits(L.REFUSAL_DIRECT)}, CASE WHEN {Q.any_hit(L.REFUSAL_CUES)} THEN {Q.scored_hits(L.REFUSAL_SAFETY)} ELSE [] END), {Q.scored_hits(L.REFUSAL_CAPABILITY)})")
_BIAS = Q.peak(Q.scored_hits([x for k in ("gender", "racial", "age", "religious") for x in L.BIAS[k]]))
_RISKS = f", risks AS (SELECT doc_id, lang, {_TOKENS} AS a, {_REFUSAL} AS b, {_BIAS} AS c FROM probed)"


def _small_shield(sequential: bool) -> P.Shield:
    return P.Shield({"token_limit": lambda t: S.token_limit(t, 500), "no_refusal": S.no_refusal, "bias": S.bias}, sequential, 0.9)


@query("pipeline_short_circuit", Q.over_probed("SELECT doc_id, CASE WHEN a >= 0.9 THEN 1 WHEN b >= 0.9 THEN 2 ELSE 3 END::BIGINT AS ran, round(CASE WHEN a >= 0.9 THEN a WHEN b >= 0.9 THEN greatest(a, b) ELSE greatest(a, b, c) END, 6) AS risk FROM risks", _RISKS))
def pipeline_short_circuit(spark, sf_dir):
    out = _small_shield(True).scan(probed(spark, sf_dir), T)
    return out.select("doc_id", big(F.size("results")).alias("ran"), six(F.col("verdict.risk_score")).alias("risk"))


@query("combine_results", Q.over_probed("SELECT doc_id, a = 0 AND b < 0.7 AND c < 0.6 AS is_valid, round(greatest(a, b, c), 6) AS risk, ((a > 0)::INT + (b >= 0.7)::INT + (c >= 0.6)::INT)::BIGINT AS factors FROM risks", _RISKS))
def combine_results(spark, sf_dir):
    out = _small_shield(False).scan(probed(spark, sf_dir), T)
    return out.select("doc_id", "verdict.is_valid", six(F.col("verdict.risk_score")).alias("risk"), big(F.size("verdict.risk_factors")).alias("factors"))


_INJECTIONS = [(p, 0.95) for p in L.OVERRIDE] + [(p, 0.8) for p in L.ROLEPLAY] + [(p, 0.75) for p in L.CONTEXT] + [(p, 0.9) for p in L.EXTRACTION]
_ZERO, _DIRECTION = "".join(L.ZERO_WIDTH), "".join(L.DIRECTIONS)
_COUNT = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')))"
_STANDARD = f""", secrets AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
injected AS (SELECT doc_id, n + d + CASE WHEN n + d > 0 AND spread THEN 1 ELSE 0 END AS k, s + d * 0.7::DOUBLE + CASE WHEN n + d > 0 AND spread THEN 0.6::DOUBLE ELSE 0 END AS s FROM (SELECT doc_id, len(f) AS n, {Q.summed('f')} AS s, d, spread FROM (SELECT doc_id, {Q.scored_hits(_INJECTIONS)} AS f, CASE WHEN (contains(t, '```') OR contains(t, '---') OR contains(t, '===')) AND (contains(lower(t), 'ignore') OR contains(lower(t), 'system')) THEN 1 ELSE 0 END AS d, (length(t) - length(replace(t, chr(10), '')) > 10 OR (length(t) - length(replace(t, ' ', '')))::DOUBLE / strlen(t) > 0.5) AS spread FROM probed))),
toxic AS (SELECT doc_id, greatest(CASE WHEN i > 0 THEN least(0.9, 0.6 + i * 0.1) ELSE 0 END, CASE WHEN th THEN 0.9 ELSE 0 END, CASE WHEN h > 0 THEN least(0.95, 0.7 + h * 0.1) ELSE 0 END)::DOUBLE AS r FROM (SELECT doc_id, len({Q.hits(L.INSULTS)}) AS i, {Q.any_hit(L.THREATS)} AS th, len({Q.hits(L.HATE)}) AS h FROM probed)),
hidden AS (SELECT doc_id, t, z + c + d AS n, CASE WHEN z + c + d = 0 THEN 0 ELSE least(1.0, (z + c + d)::DOUBLE / strlen(t) * 0.7 + (z + c * 0.9 + d * 0.7)::DOUBLE / (z + c + d) * 0.3) END AS r FROM (SELECT doc_id, t, {_COUNT(_ZERO)} AS z, {_COUNT('\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{80}-\\x{9F}')} AS c, {_COUNT(_DIRECTION)} AS d FROM probed)),
all_ AS (SELECT doc_id, coalesce(secrets.n, 0) AS found, toxic.r AS tox, CASE WHEN k = 0 THEN 0 ELSE s / k END AS inj, k, hidden.r AS hid, hidden.n AS h, ceil(strlen(t) / 4.0) AS tokens FROM hidden JOIN toxic USING (doc_id) JOIN injected USING (doc_id) LEFT JOIN secrets USING (doc_id)),
risks_ AS (SELECT *, greatest(CASE WHEN found > 0 THEN 1 ELSE 0 END, tox, inj, hid, CASE WHEN tokens > 4096 THEN least(1.0, tokens / 4096) ELSE 0 END)::DOUBLE AS risk FROM all_)"""


@query("shield_standard", Q.over_probed("SELECT doc_id, found = 0 AND round(tox, 6) < 0.7 AND inj < 0.7 AND hid < 0.1 AND tokens <= 4096 AS is_valid, round(risk, 6) AS risk, CASE WHEN risk >= 0.9 THEN 'critical' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'medium' WHEN risk > 0 THEN 'low' ELSE 'none' END AS severity, (found + k + h)::BIGINT AS entities FROM risks_", SECRETS_KEPT + _STANDARD).replace("WITH probed", "WITH RECURSIVE probed", 1))
def shield_standard(spark, sf_dir):
    """Flagship: the standard preset over every document."""
    out = P.Shield.preset("standard").scan(probed(spark, sf_dir), T)
    return out.select("doc_id", "verdict.is_valid", six(F.col("verdict.risk_score")).alias("risk"), severity_of(F.col("verdict.risk_score")).alias("severity"), big(F.size("verdict.entities")).alias("entities"))


@query("severity_histogram", Q.over_probed("SELECT severity, severity_rank, count(*) AS n FROM (SELECT CASE WHEN b >= 0.9 THEN 'critical' WHEN b >= 0.7 THEN 'high' WHEN b >= 0.4 THEN 'medium' WHEN b > 0 THEN 'low' ELSE 'none' END AS severity, CASE WHEN b >= 0.9 THEN 4 WHEN b >= 0.7 THEN 3 WHEN b >= 0.4 THEN 2 WHEN b > 0 THEN 1 ELSE 0 END AS severity_rank FROM risks) GROUP BY ALL", _RISKS))
def severity_histogram(spark, sf_dir):
    rows = probed(spark, sf_dir).select(severity_of(S.no_refusal(F.col(T))["risk_score"]).alias("severity"))
    return rows.groupBy("severity", severity_rank(F.col("severity")).alias("severity_rank")).agg(F.count("*").alias("n"))


_POLICY = [("en", "audit", 0.2), ("de", "block", 0.5), ("fr", "modify", 0.95)]
_POLICY_SQL = ", rules(lang, action, adjustment) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _POLICY) + ")"


def _rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


@query("policy_apply", Q.over_probed("SELECT doc_id, round(greatest(b, coalesce(adjustment, 0)), 6) AS risk, b < 0.7 AND coalesce(action, 'allow') <> 'block' AS is_valid, coalesce(action, 'allow') AS action FROM risks LEFT JOIN rules USING (lang)", _RISKS + _POLICY_SQL))
def policy_apply(spark, sf_dir):
    found = S.no_refusal(F.col(T))
    docs = probed(spark, sf_dir).select("doc_id", "lang", found["risk_score"].alias("r"), found["is_valid"].alias("v"))
    met = docs.join(F.broadcast(_rows(spark, ["lang", "action", "adjustment"], _POLICY)), "lang", "left")
    risk, valid = P.apply_policy(F.col("r"), F.col("v"), F.col("action"), F.col("adjustment"))
    return met.select("doc_id", six(risk).alias("risk"), valid.alias("is_valid"), F.coalesce("action", F.lit("allow")).alias("action"))


_PATTERNS = [("Acme", True), ("ACME", True), ("BOMB", False), ("jailbreak", False)]


@query("pattern_rules_theta_join", Q.over_probed("SELECT pattern, count(*) AS docs FROM probed JOIN rules ON CASE WHEN cs THEN contains(t, pattern) ELSE contains(lower(t), lower(pattern)) END GROUP BY pattern", ", rules(pattern, cs) AS (VALUES " + ", ".join(f"('{p}', {str(c).lower()})" for p, c in _PATTERNS) + ")"))
def pattern_rules_theta_join(spark, sf_dir):
    rules = F.broadcast(_rows(spark, ["pattern", "cs"], _PATTERNS))
    fits = F.when(F.col("cs"), F.contains(F.col(T), F.col("pattern"))).otherwise(F.contains(F.lower(T), F.lower("pattern")))
    return probed(spark, sf_dir).join(rules, fits).groupBy("pattern").agg(F.count("*").alias("docs"))


@query("pattern_rules_blocked", Q.over_probed("SELECT doc_id, contains(t, 'Acme') OR contains(t, 'ACME') OR contains(lower(t), 'bomb') OR contains(lower(t), 'jailbreak') AS blocked FROM probed"))
def pattern_rules_blocked(spark, sf_dir):
    rules = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("case_sensitive")) for p, c in _PATTERNS))
    return probed(spark, sf_dir).select("doc_id", P.blocked(F.col(T), rules).alias("blocked"))


@query("threshold_join", Q.over_probed("SELECT doc_id, scanner, round(score, 6) AS score, score >= coalesce(threshold, 0.5) AS over FROM (SELECT doc_id, 'toxicity' AS scanner, b AS score FROM risks UNION ALL SELECT doc_id, 'other', c FROM risks) LEFT JOIN (VALUES ('toxicity', 0.7::DOUBLE), ('pii', 0.85::DOUBLE)) AS x(scanner, threshold) USING (scanner)", _RISKS))
def threshold_join(spark, sf_dir):
    scores = F.array(F.struct(F.lit("toxicity").alias("scanner"), S.no_refusal(F.col(T))["risk_score"].alias("score")), F.struct(F.lit("other").alias("scanner"), S.bias(F.col(T))["risk_score"].alias("score")))
    each = probed(spark, sf_dir).select("doc_id", F.inline(scores))
    return each.select("doc_id", "scanner", six(F.col("score")).alias("score"), (F.col("score") >= P.threshold_of(F.col("scanner"))).alias("over"))


@query("hooks_adjust", Q.over_probed("SELECT doc_id, round(CASE WHEN contains(t, 'RSA PRIVATE') THEN 1.0 ELSE least(1.0, greatest(0.0, b + CASE WHEN lang = 'en' THEN 0.15 ELSE 0 END - CASE WHEN strlen(t) > 3000 THEN 0.3 ELSE 0 END)) END::DOUBLE, 6) AS risk FROM (SELECT probed.*, b FROM probed JOIN risks USING (doc_id))", _RISKS))
def hooks_adjust(spark, sf_dir):
    t = F.col(T)
    adjust = F.when(F.col("lang") == "en", 0.15).otherwise(0.0) - F.when(F.octet_length(t) > 3000, 0.3).otherwise(0.0)
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), S.no_refusal(t)["risk_score"] + adjust))
    return probed(spark, sf_dir).select("doc_id", six(P.post_hooks(base, F.lit(True), [P.Hook(F.contains(t, F.lit("RSA PRIVATE")), "reject")])["risk_score"]).alias("risk"))


@query("request_validation", "SELECT doc_id, CASE WHEN length(text) < 1 THEN 'prompt is empty' WHEN length(text) > 100000 THEN 'prompt is too long' WHEN doc_id % 23 > 20 THEN 'too many scanners' WHEN NOT doc_id % 103 BETWEEN 1 AND 100 THEN 'batch size out of range' WHEN NOT doc_id % 12 BETWEEN 1 AND 10 THEN 'concurrency out of range' END AS error FROM documents")
def request_validation(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", P.request_error(F.col("text"), i % 23, i % 103, i % 12).alias("error"))


@query("dedupe_entities", Q.over_probed("SELECT kind AS entity_type, count(*) AS n FROM pii WHERE kind IN ('ssn', 'email') GROUP BY kind", _pii_sql(["ssn", "email"])))
def dedupe_entities(spark, sf_dir):
    once, again = S.pii_spans(F.col(T), ["ssn", "email"]), S.pii_spans(F.col(T), ["email", "ssn"])
    rows = probed(spark, sf_dir).select(F.explode(P.merged_spans(F.concat(once, again))).alias("s"))
    return rows.groupBy("s.entity_type").agg(F.count("*").alias("n"))


@query("weighted_risk", "SELECT doc_id, round(least(1.0, (CASE quality WHEN 1 THEN 0.25 ELSE 0.5 END * 0.8 + CASE toxic WHEN 1 THEN 1.0 ELSE 0 END * 0.9) / 2)::DOUBLE, 6) AS risk FROM labels")
def weighted_risk(spark, sf_dir):
    levels = F.array(F.when(F.col("quality") == 1, "low").otherwise("medium"), F.when(F.col("toxic") == 1, "critical").otherwise("none"))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(P.weighted_risk(levels, F.array(F.lit(0.8), F.lit(0.9))), 6).alias("risk"))


@query("batch_rollup", Q.over_probed("SELECT lang, bool_and(b < 0.7) AS is_valid, round(max(b), 6) AS risk, count(*) FILTER (b >= 0.7) AS failed, count(*) AS n FROM risks GROUP BY lang", _RISKS))
def batch_rollup(spark, sf_dir):
    found = S.no_refusal(F.col(T))
    rows = probed(spark, sf_dir).select("lang", found["is_valid"].alias("v"), found["risk_score"].alias("r"))
    return rows.groupBy("lang").agg(F.bool_and("v").alias("is_valid"), F.round(F.max("r"), 6).alias("risk"), F.count_if(~F.col("v")).alias("failed"), F.count("*").alias("n"))


@query("scan_once_per_text", "SELECT source, count(*) AS n, count(DISTINCT text) AS texts, sum(ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def scan_once_per_text(spark, sf_dir):
    docs = M.once_per_text(table(spark, sf_dir, "documents").select("source", "text"), "text", lambda t: big(S.token_limit(t)["metadata"]["token_count"]))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.sum("scanned").alias("tokens"))


# Anonymization

_TWO = ("ssn", "email")
_NUMBERED = ", spans AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k.upper()}' AS kind, unnest(m) AS m, generate_subscripts(m, 1)::BIGINT AS i FROM (SELECT doc_id, {Q.matches(p)} AS m FROM probed)" for k, p, _ in L.SENSITIVE if k in _TWO) + "), vault AS (SELECT doc_id::VARCHAR AS session_id, '[' || kind || '_' || i || ']' AS placeholder, kind AS entity_type, m AS original_value, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (doc_id % 120) AS ts FROM spans)"


def _span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.concat(*(regex_spans(F.col(T), p, k.upper(), c) for k, p, c in L.SENSITIVE if k in _TWO))
    rows = probed(spark, sf_dir).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")
    return A.placeholders(rows, "doc_id")


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id") % 120)
    rows = _span_rows(spark, sf_dir).withColumn("ts", ts)
    return rows.select(F.col("doc_id").cast("string").alias("session_id"), "placeholder", "entity_type", F.col("text").alias("original_value"), "ts", (F.col("ts") + F.make_dt_interval(secs=F.lit(A.TTL_SECONDS))).alias("expires_at"))


@query("anonymize_placeholders", Q.over_probed("SELECT doc_id, kind AS entity_type, m AS original_value, '[' || kind || '_' || i || ']' AS placeholder FROM spans", _NUMBERED))
def anonymize_placeholders(spark, sf_dir):
    return _span_rows(spark, sf_dir).select("doc_id", "entity_type", F.col("text").alias("original_value"), "placeholder")


_VALID = {"SSN": "regexp_extract(m, '([0-9]+)', 1)::INT NOT IN (0, 666) AND split_part(m, '-', 1)::INT < 900 AND split_part(m, '-', 2)::INT <> 0 AND split_part(m, '-', 3)::INT <> 0", "CREDIT_CARD": f"(SELECT {_LUHN} FROM (SELECT regexp_replace(m, '[^0-9]', '', 'g') AS d))", "IP_ADDRESS": _IPV4}


@query("anonymize_text", Q.over_probed(f"SELECT doc_id, coalesce(x.t, probed.t) AS anonymized, coalesce(n, 0) AS n FROM probed LEFT JOIN {Q.spliced(chr(39) + '[' + chr(39) + ' || kind || ' + chr(39) + '_' + chr(39) + ' || number || ' + chr(39) + ']' + chr(39))} x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) USING (doc_id)", ", " + Q.surest(Q.spans([(k, p, c, "") for k, p, c in L.ANONYMIZED], _VALID))).replace("WITH probed", "WITH RECURSIVE probed", 1))
def anonymize_text(spark, sf_dir):
    out = A.anonymize(probed(spark, sf_dir), "doc_id", T)
    return out.select("doc_id", "anonymized", big(F.size("mappings")).alias("n"))


@query("deanonymize_roundtrip", Q.over_probed("SELECT doc_id, sha256(t) AS restored, length(t) AS n_chars FROM probed"))
def deanonymize_roundtrip(spark, sf_dir):
    out = A.anonymize(probed(spark, sf_dir), "doc_id", T)
    restored = A.restore(F.col("anonymized"), F.col("mappings"))
    return out.select("doc_id", F.sha2(restored, 256).alias("restored"), big(F.length(restored)).alias("n_chars"))


_NOW = "2024-01-01 01:30:00"


@query("vault_active_mappings", Q.over_probed(f"SELECT session_id, placeholder, entity_type, original_value FROM vault WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '{_NOW}'", _NUMBERED))
def vault_active_mappings(spark, sf_dir):
    return A.active(_vault(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz")).select("session_id", "placeholder", "entity_type", "original_value")


@query("vault_expired_antijoin", Q.over_probed(f"SELECT session_id, count(*) AS n FROM vault WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '{_NOW}' GROUP BY session_id", _NUMBERED))
def vault_expired_antijoin(spark, sf_dir):
    rows = _vault(spark, sf_dir)
    gone = rows.join(A.active(rows, F.lit(_NOW).cast("timestamp_ntz")), ["session_id", "placeholder"], "left_anti")
    return gone.groupBy("session_id").agg(F.count("*").alias("n"))


@query("session_list_distinct", Q.over_probed("SELECT DISTINCT session_id FROM vault", _NUMBERED))
def session_list_distinct(spark, sf_dir):
    return _vault(spark, sf_dir).select("session_id").distinct()


@query("audit_log", Q.over_probed("SELECT 'anonymize' AS event_type, left(session_id, 8) || '****' AS session_id, count(*) AS entities, min(ts) AS ts FROM vault GROUP BY vault.session_id", _NUMBERED))
def audit_log(spark, sf_dir):
    return A.audited(_vault(spark, sf_dir))


_TAG = "CASE {n} % 5 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'I-ORG' ELSE 'O' END"


@query("bio_decode_islands", f"WITH w AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1)::BIGINT AS pos FROM (SELECT doc_id, {Q.words('text')} AS w FROM documents)), t AS (SELECT *, {_TAG.format(n='length(token)')} AS tag, 0.8::DOUBLE + 0.02 * (length(token) % 10) AS c FROM w), k AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE substr(tag, 3) END AS kind FROM t), b AS (SELECT *, CASE WHEN kind IS NOT NULL AND (tag LIKE 'B-%' OR NOT coalesce(lag(kind) OVER o = kind, false)) THEN 1 ELSE 0 END AS begins FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), i AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b), e AS (SELECT doc_id, island, min(kind) AS entity_type, count(*) AS tokens, round(avg(c), 6) AS confidence FROM i WHERE kind IS NOT NULL GROUP BY doc_id, island) SELECT entity_type, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM e WHERE confidence >= 0.85 GROUP BY entity_type")
def bio_decode_islands(spark, sf_dir):
    """Tokens stay in their row's array; only counts are shuffled."""
    n = lambda w: F.length(w)
    tag = lambda w: F.when(n(w) % 5 == 0, "B-PER").when(n(w) % 5 == 1, "I-PER").when(n(w) % 5 == 2, "I-ORG").otherwise("O")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    tokens = F.transform(words, lambda w, i: F.struct(w.alias("token"), tag(w).alias("tag"), i.alias("start"), (i + 1).alias("end"), ((n(w) % 10) * 0.02 + 0.8).alias("confidence")))
    found = spread(table(spark, sf_dir, "documents")).select(F.explode(A.bio_rows(tokens, 0.0)).alias("e")).select("e.entity_type", F.round("e.confidence", 6).alias("confidence"), "e.n")
    return found.where("confidence >= 0.85").groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(big(F.col("n"))).alias("tokens"))


# Metrics


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("scanner", F.get_json_object("props", "$.k"))


_SCANNER = "json_extract_string(props, '$.k')"


@query("metrics_1min_rollup", f"SELECT date_trunc('minute', ts) AS bucket, user_id % 10 AS tenant, event_type, {_SCANNER} AS scanner, round(avg(value), 6) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS n FROM events GROUP BY 1, 2, 3, 4")
def metrics_1min_rollup(spark, sf_dir):
    rows = M.rollup(events(spark, sf_dir).withColumn("tenant", F.col("user_id") % 10), "1 minute", ["tenant", "event_type", "scanner"])
    return rows.withColumn("avg_value", F.round("avg_value", 6))


@query("retention_filter", "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY event_type")
def retention_filter(spark, sf_dir):
    return M.retained(events(spark, sf_dir), "10 days").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


_SLIDING = "SELECT s AS start, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * k FOR k IN range(6)]) AS x(s) GROUP BY s"


@query("error_rate_alert", f"SELECT start, bad, n, round(bad::DOUBLE / n, 6) AS ratio, bad::DOUBLE / n > 0.1 AS breach FROM ({_SLIDING})")
def error_rate_alert(spark, sf_dir):
    rows = M.breaches(events(spark, sf_dir), F.col("event_type") == "error", "6 hours", "1 hour", 0.1)
    return rows.withColumn("ratio", F.round("ratio", 6))


@query("alert_hold", "SELECT tenant, start, breach, coalesce(min(breach::INT) OVER w = 1 AND count(*) OVER w = 3, false) AS firing FROM (SELECT user_id % 3 AS tenant, date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) > 0.1 AS breach FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY tenant ORDER BY start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def alert_hold(spark, sf_dir):
    hourly = events(spark, sf_dir).groupBy((F.col("user_id") % 3).alias("tenant"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg((F.count_if(F.col("event_type") == "error") / F.count("*") > 0.1).alias("breach"))
    return M.held(hourly, ["tenant"], 3).select("tenant", "start", "breach", "firing")


_ALERTS = [("error_count", ">", 60.0), ("total", ">=", 300.0), ("error_count", "!=", 0.0), ("total", "<", 320.0)]


@query("threshold_rules", "SELECT day, metric, op, threshold, CASE op WHEN '>' THEN v > threshold WHEN '<' THEN v < threshold WHEN '>=' THEN v >= threshold WHEN '!=' THEN v <> threshold END AS fires FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1) d, (VALUES " + ", ".join(f"('{m}', '{o}', {t}::DOUBLE)" for m, o, t in _ALERTS) + ") AS r(metric, op, threshold), LATERAL (SELECT CASE metric WHEN 'total' THEN n ELSE e END AS v)")
def threshold_rules(spark, sf_dir):
    daily = events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    met = daily.join(F.broadcast(_rows(spark, ["metric", "op", "threshold"], _ALERTS)))
    value = F.when(F.col("metric") == "total", F.col("n")).otherwise(F.col("e"))
    return met.select("day", "metric", "op", "threshold", M.compare(value, F.col("op"), F.col("threshold")).alias("fires"))


_BOUNDS = [1.0, 5.0, 10.0, 20.0, 40.0, 80.0]


@query("latency_histogram_quantile", "WITH b(le, low) AS (VALUES " + ", ".join(f"({b}::DOUBLE, {a}::DOUBLE)" for a, b in zip([0.0, *_BOUNDS], _BOUNDS)) + f", ('inf'::DOUBLE, {_BOUNDS[-1]}::DOUBLE)), h AS (SELECT event_type, le, low, count(*) FILTER (value <= le) AS n, count(*) FILTER (low > 0 AND value <= low) AS below, count(*) AS total FROM events, b GROUP BY ALL) SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (total * 0.95 - below) / (n - below) END::DOUBLE, 6) AS quantile FROM h WHERE n >= total * 0.95 AND below < total * 0.95")
def latency_histogram_quantile(spark, sf_dir):
    hist = M.histogram(events(spark, sf_dir), F.col("value"), ["event_type"], _BOUNDS)
    return M.histogram_quantile(hist, ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("top_scanners", f"SELECT {_SCANNER} AS scanner, count(*) AS n, round(avg((event_type <> 'error')::INT), 6) AS success_rate FROM events GROUP BY 1 ORDER BY n DESC, scanner LIMIT 5")
def top_scanners(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("scanner").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("success_rate"))
    return rows.orderBy(F.desc("n"), "scanner").limit(5)


@query("tenant_range", "SELECT user_id % 10 AS tenant, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id % 10 = 3 GROUP BY 1")
def tenant_range(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-12' and user_id % 10 = 3")
    return rows.groupBy((F.col("user_id") % 10).alias("tenant")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("bench_percentiles", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, " + ", ".join(f"max(value) FILTER (i = floor(n * {q})) AS {k}" for k, q in _SHARES.items()) + ", max(n) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS min, max(value) AS max FROM r GROUP BY event_type")
def bench_percentiles(spark, sf_dir):
    rows = M.index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", _SHARES)
    return rows.withColumns({"mean": F.round("mean", 6), "std_dev": F.round("std_dev", 6)})


_CLAIMS = [("latency", 0.5, 8.0, "10-25x"), ("throughput", 0.1, 12.0, "100x"), ("memory", 1.0, 16.5, ">16x"), ("size", 2.0, 20.0, "10x")]


@query("claim_compare", "SELECT name, round(slow / fast, 6) AS ratio, CASE name WHEN 'latency' THEN slow / fast BETWEEN 10 AND 25 WHEN 'throughput' THEN slow / fast >= 100 WHEN 'memory' THEN slow / fast > 16 ELSE slow / fast >= 10 END AS holds FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b, _ in _CLAIMS) + ") AS c(name, fast, slow)")
def claim_compare(spark, sf_dir):
    rows = _rows(spark, ["name", "fast", "slow", "claim"], _CLAIMS)
    ratio = F.col("slow") / F.col("fast")
    return rows.select("name", F.round(ratio, 6).alias("ratio"), M.claim_holds(ratio, F.col("claim")).alias("holds"))


@query("classifier_eval", f"SELECT tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT toxic = 1 AS y, {Q.any_hit(L.INSULTS + L.HATE + L.THREATS, 'lower(text)')} AS p FROM labels JOIN documents USING (doc_id)))")
def classifier_eval(spark, sf_dir):
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")  # only labelled texts are scanned
    out = M.confusion(met.withColumn("score", S.toxicity(F.col("text"))["risk_score"]), F.col("toxic") == 1, F.col("score") > 0)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query("softmax_argmax", "SELECT vec_id, (len(e) - list_position(list_reverse(e), list_max(e)))::BIGINT AS argmax, round(1 / list_sum(list_transform(e, lambda x: exp(x::DOUBLE - list_max(e)::DOUBLE))), 6) AS top FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def softmax_argmax(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", big(M.argmax_last(e)).alias("argmax"), F.round(F.array_max(M.softmax(e)), 6).alias("top"))


@query("sigmoid_multilabel", "SELECT vec_id, len(list_filter(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE)) >= 0.52)) AS labels FROM embeddings")
def sigmoid_multilabel(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", big(F.size(F.filter(M.sigmoid(F.col("embedding")), lambda p: p >= 0.52))).alias("labels"))


@query("cache_hit_rate", "SELECT event_type, count(*) FILTER (hit) AS hits, count(*) AS n, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS rate FROM (SELECT event_type, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR, false) AS hit FROM events) GROUP BY event_type")
def cache_hit_rate(spark, sf_dir):
    rows = M.cache_hits(table(spark, sf_dir, "events"), "user_id", "2 hours").groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    return rows.withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


@query("concurrency_overlap", "SELECT tenant, max(o)::BIGINT AS most FROM (SELECT tenant, sum(sum(d)) OVER (PARTITION BY tenant ORDER BY ts) AS o FROM (SELECT user_id % 10 AS tenant, ts, 1 AS d FROM events UNION ALL SELECT user_id % 10, ts + INTERVAL 90 MINUTE, -1 FROM events) GROUP BY tenant, ts) GROUP BY tenant")
def concurrency_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 90 minutes")).alias("b"))
    return M.in_flight(rows, ["tenant"], "a", "b")


@query("quota_calendar", "SELECT user_id, count(*) FILTER (k <= 3) AS allowed, count(*) FILTER (k > 3) AS denied FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id")
def quota_calendar(spark, sf_dir):
    rows = U.calendar(table(spark, sf_dir, "events"), "day", 3)
    return rows.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


@query("stream_rollup", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rollup(spark, sf_dir):
    """The roll-up by Structured Streaming; complete mode gives every bucket."""
    from sievemark.streaming.flows import event_stream

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = event_stream(spark, sf_dir, "events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n")
    write = lambda frame, number: frame.write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("log_parse", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, lower(upper(event_type)) AS level FROM events WHERE event_type = 'error'")
def log_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.lower(F.upper("event_type")).alias("level"))


@query("content_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("active_keys", "SELECT c_custkey AS key_id, c_nationkey AS tenant FROM customer WHERE c_acctbal IS NULL OR c_acctbal > 5000")
def active_keys(spark, sf_dir):
    """Customers stand in for API keys, and their balances for the time until a key expires."""
    return table(spark, sf_dir, "customer").where("c_acctbal is null or c_acctbal > 5000").select(F.col("c_custkey").alias("key_id"), F.col("c_nationkey").alias("tenant"))


