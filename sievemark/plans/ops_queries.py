"""Queries of alerts, refreshed roll-ups, caches, quotas and tiers, logs, files, reports, span folds and the vault's upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.spans import current_wins, surest_wins
from sievemark.functions.text import SPANS
from sievemark.operators import anonymize as A
from sievemark.operators import metrics as M
from sievemark.operators import quota as U
from sievemark.plans import reports as R
from sievemark.plans import sql as Q
from sievemark.plans.flow_queries import _NOW, _NUMBERED, _vault
from sievemark.plans.scan_queries import big
from sievemark.sources import tables as IO
from sievemark.sources.shared import shared_dir
from sievemark.sources.tables import table
from sievemark.streaming import flows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return keep


def _rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


# Alerts: the twelve rules, over events that stand in for requests. Windows of six hours, as events are hours apart.

_BOUNDS = (1.0, 5.0, 10.0, 20.0, 40.0, 80.0)
#: name, kind, operator, limit, predicate, hold.
_ALERTS = [
    ("api_down", "absent", "=", 0.0, "event_type <> 'error'", 1),
    ("api_high_error_rate", "ratio", ">", 0.05, "event_type = 'error'", 5),
    ("api_high_latency", "quantile", ">", 60.0, "true", 5),
    ("high_memory_usage", "gauge", ">", 90.0, "event_type = 'purchase'", 5),
    ("high_cpu_usage", "rate", ">", 0.0005, "event_type = 'click'", 5),
    ("low_throughput", "rate", "<", 0.003, "true", 10),
    ("high_rate_limit_rejects", "rate", ">", 0.0002, "event_type = 'error' AND user_id % 2 = 0", 5),
    ("scanner_high_failure_rate", "ratio", ">", 0.10, "event_type = 'error'", 5),
    ("scanner_slow_performance", "quantile", ">", 70.0, "event_type = 'view'", 5),
    ("high_authentication_failures", "rate", ">", 0.0004, "event_type = 'error'", 5),
    ("suspicious_traffic_pattern", "rate", ">", 0.0003, "event_type = 'error' AND user_id % 3 = 0", 5),
    ("high_invalid_input_rate", "ratio", ">", 0.20, "value < 10", 5),
]


def _alert_sql() -> str:
    edges = ", ".join(f"({b}::DOUBLE, {a}::DOUBLE)" for a, b in zip((0.0, *_BOUNDS), _BOUNDS, strict=False)) + f", ('inf'::DOUBLE, {_BOUNDS[-1]}::DOUBLE)"
    parts = []
    for name, kind, op, limit, bad, hold in _ALERTS:
        if kind == "quantile":
            value = f"(SELECT start, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (total * 0.95 - below) / (n - below) END, 9) AS value FROM (SELECT start, le, low, count(*) FILTER (value <= le) AS n, count(*) FILTER (low > 0 AND value <= low) AS below, count(*) AS total FROM w, (VALUES {edges}) AS b(le, low) WHERE {bad} GROUP BY ALL) WHERE n >= total * 0.95 AND below < total * 0.95)"
        else:
            expression = {"ratio": f"count(*) FILTER ({bad}) / count(*)", "rate": f"count(*) FILTER ({bad}) / 21600.0", "gauge": f"max(value) FILTER ({bad})", "absent": f"count(*) FILTER ({bad})"}[kind]
            value = f"(SELECT start, ({expression})::DOUBLE AS value FROM w GROUP BY start)"
        if kind == "absent":
            value = f"(SELECT start, coalesce(value, 0) AS value FROM slides LEFT JOIN {value} USING (start))"
        parts.append(f"SELECT '{name}' AS alert, start, value, value {op} {limit}::DOUBLE AS breach, {hold} AS hold FROM {value} WHERE value IS NOT NULL")
    return f"""
WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, * FROM events, range(6) AS r(k)),
slides AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 1 HOUR)) AS start FROM w),
v AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, row_number() OVER o AS k FROM v WINDOW o AS (PARTITION BY alert ORDER BY start)),
s AS (SELECT *, k - coalesce(max(k) FILTER (NOT breach) OVER (PARTITION BY alert ORDER BY start), 0) AS streak FROM k)
SELECT alert, start::TIMESTAMP AS start, round(value, 6) AS value, breach, streak >= hold AS firing FROM s"""


@query("alert_rules", _alert_sql())
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [M.Alert(name, kind, op, limit, F.expr(bad), hold, buckets=_BOUNDS) for name, kind, op, limit, bad, hold in _ALERTS]
    out = M.alerts(table(spark, sf_dir, "events"), rules, "6 hours", "1 hour")
    return out.select("alert", F.col("start").cast("timestamp_ntz").alias("start"), F.round("value", 6).alias("value"), "breach", "firing")


@query("rollup_refresh", "WITH n AS (SELECT max(ts) - INTERVAL 30 MINUTE AS now FROM events) SELECT date_trunc('minute', ts) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events, n WHERE date_trunc('minute', ts) >= now - INTERVAL 20 HOUR AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= now GROUP BY ALL")
def rollup_refresh(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("interval 30 minutes")).alias("now"))
    rolled = M.rollup(events, "1 minute", ["event_type"]).crossJoin(F.broadcast(now))  # a row
    return M.refreshed(rolled, F.col("now"), oldest="20 hours").select("bucket", "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


# Caches


@query("cache_lru", "WITH r AS (SELECT event_id, user_id % 4 AS cache, user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS p FROM events), b AS (SELECT *, lag(p) OVER (PARTITION BY cache, key ORDER BY p) AS before FROM r) SELECT event_id, cache, key, coalesce((SELECT count(DISTINCT x.key) FROM r x WHERE x.cache = b.cache AND x.p > b.before AND x.p < b.p) < 8 AND before IS NOT NULL, false) AS hit FROM b")
def cache_lru(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("cache"), F.col("user_id").alias("key"))
    return M.lru(requests, "cache", "key", 8, 10 * 365 * 86_400.0)


@query("inference_ratios", "SELECT tenant, round(cache_hits / nullif(total_calls, 0), 6) AS cache_hit_rate, round(h / nullif(total_calls, 0), 6) AS heuristic_filter_rate, round(ms / nullif(total_calls, 0), 6) AS avg_inference_ms, coalesce(round(e / nullif(ml_calls, 0), 6), 0) AS ml_error_rate FROM (SELECT user_id % 7 AS tenant, count(*)::DOUBLE AS total_calls, (count(*) FILTER (event_type <> 'view'))::DOUBLE AS ml_calls, count(*) FILTER (event_type = 'click') AS cache_hits, count(*) FILTER (event_type = 'view') AS h, sum(floor(value))::DOUBLE AS ms, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)")
def inference_ratios(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("tenant")).agg(F.count("*").alias("total_calls"), F.count_if(F.col("event_type") != "view").alias("ml_calls"), kind("click").alias("cache_hits"), kind("view").alias("heuristic_short_circuits"), F.sum(F.floor("value")).alias("total_ms"), kind("error").alias("ml_errors"))
    out = M.inference_ratios(counts)
    return out.select("tenant", *(F.round(c, 6).alias(c) for c in ("cache_hit_rate", "heuristic_filter_rate", "avg_inference_ms", "ml_error_rate")))


# Quotas


_LIMITS = {"hour": 2, "day": 3}
QUOTA_SQL = """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
SELECT user_id, event_id, u, k, u AS hour_begun, 1 AS hour_n, u AS day_begun, 1 AS day_n, true AS allowed, 0::BIGINT AS retry FROM r WHERE k = 1
UNION ALL
SELECT user_id, event_id, u, k, hour_begun, CASE WHEN ok THEN hour_n + 1 ELSE hour_n END, day_begun, CASE WHEN ok THEN day_n + 1 ELSE day_n END, ok,
  CASE WHEN ok THEN 0 ELSE greatest(CASE WHEN hour_n >= 2 THEN hour_begun + 3600000000 - u ELSE 0 END, CASE WHEN day_n >= 3 THEN day_begun + 86400000000 - u ELSE 0 END) END
FROM (SELECT *, hour_n < 2 AND day_n < 3 AS ok FROM (SELECT r.user_id, r.event_id, r.u, r.k, CASE WHEN r.u >= s.hour_begun + 3600000000 THEN r.u ELSE s.hour_begun END AS hour_begun, CASE WHEN r.u >= s.hour_begun + 3600000000 THEN 0 ELSE s.hour_n END AS hour_n, CASE WHEN r.u >= s.day_begun + 86400000000 THEN r.u ELSE s.day_begun END AS day_begun, CASE WHEN r.u >= s.day_begun + 86400000000 THEN 0 ELSE s.day_n END AS day_n FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)))
SELECT user_id, event_id, allowed, CASE WHEN allowed THEN least(2 - hour_n, 3 - day_n) ELSE 0 END::BIGINT AS remaining, retry::BIGINT AS retry_after_us FROM s
"""
query("quota_exact", QUOTA_SQL)(lambda spark, sf_dir: U.exact(table(spark, sf_dir, "events"), _LIMITS))



@query("stream_quota", QUOTA_SQL.replace(", retry::BIGINT AS retry_after_us", ""))
def stream_quota(spark, sf_dir):
    """The exact quota with its counts in the stream's state, into the shared folder."""
    base = f"{shared_dir(spark)}/stream-quota-{uuid.uuid4().hex}"
    flows.run_to_table(flows.quota(flows.event_stream(spark, sf_dir, "events.parquet"), _LIMITS), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("stream_rollup_closed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_rollup_closed(spark, sf_dir):
    """Buckets that no late event can change any more: appended once the watermark, an hour behind, has passed them."""
    base = f"{shared_dir(spark)}/stream-closed-{uuid.uuid4().hex}"
    flows.run_to_table(flows.rolled(flows.event_stream(spark, sf_dir, "events.parquet"), "1 hour"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


_TIER = "(['free', 'pro', 'enterprise'])[user_id % 3 + 1]"
_TIER_ROWS = [(t, w, n) for t, limits in U.TIERS.items() for w, n in limits.items()]


@query("quota_tiers", "WITH limits(tier, w, most) AS (VALUES " + ", ".join(f"('{t}', '{w}', {n})" for t, w, n in _TIER_ROWS) + f") SELECT user_id, tier, bucket, n AS used, most - n AS remaining, n <= most AS allowed FROM (SELECT user_id, {_TIER} AS tier, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY ALL) JOIN limits USING (tier) WHERE w = 'hour'")
def quota_tiers(spark, sf_dir):
    """What is left of each user's hour, by the limits of the user's tier."""
    tier = F.get(F.array(*map(F.lit, U.TIERS)), (F.col("user_id") % 3).cast("int"))
    used = table(spark, sf_dir, "events").groupBy("user_id", tier.alias("tier"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("used"))
    limits = _rows(spark, ["tier", "w", "most"], _TIER_ROWS).where("w = 'hour'")
    met = used.join(F.broadcast(limits), "tier")  # nine literals
    return met.select("user_id", "tier", "bucket", "used", (F.col("most") - F.col("used")).alias("remaining"), (F.col("used") <= F.col("most")).alias("allowed"))


@query("quota_concurrent", "SELECT tenant, tier, most, lim AS \"limit\", most > lim AS over FROM (SELECT tenant, max(o)::BIGINT AS most FROM (SELECT tenant, sum(sum(d)) OVER (PARTITION BY tenant ORDER BY ts) AS o FROM (SELECT user_id % 9 AS tenant, ts, 1 AS d FROM events UNION ALL SELECT user_id % 9, ts + INTERVAL 10 HOUR, -1 FROM events) GROUP BY tenant, ts) GROUP BY tenant) JOIN (SELECT range AS tenant, (['free', 'pro', 'enterprise'])[range % 3 + 1] AS tier FROM range(9)) USING (tenant) JOIN (VALUES " + ", ".join(f"('{t}', {n})" for t, n in U.CONCURRENT.items()) + ") AS l(tier, lim) USING (tier)")
def quota_concurrent(spark, sf_dir):
    tenant = F.col("user_id") % 9
    rows = table(spark, sf_dir, "events").select(tenant.alias("tenant"), F.get(F.array(*map(F.lit, U.CONCURRENT)), (tenant % 3).cast("int")).alias("tier"), F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 10 hours")).alias("b"))
    return M.over_limit(rows, "tenant", "a", "b", "tier", U.CONCURRENT)


# Spans

_LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS i, (l_partkey % 40)::INT AS a, (l_partkey % 40 + l_suppkey % 12 + 1)::INT AS b, (l_linenumber * 7 % 5) / 10.0::DOUBLE AS c, l_returnflag AS kind FROM lineitem"


def _fold_sql(overlaps: str) -> str:
    return f"WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, i, kind, b, c) AS k FROM ({_LINES})), s AS (SELECT doc_id, k, a, b, c, kind, i, false AS closes, NULL::INT AS pa, NULL::INT AS pb, NULL::VARCHAR AS pk FROM x WHERE k = 1 UNION ALL SELECT doc_id, k, CASE WHEN keep THEN a ELSE na END, CASE WHEN keep THEN b ELSE nb END, CASE WHEN keep THEN c ELSE nc END, CASE WHEN keep THEN kind ELSE nk END, ni, NOT o, a, b, kind FROM (SELECT *, o AND nc <= c AS keep FROM (SELECT s.doc_id, n.k, s.a, s.b, s.c, s.kind, n.a AS na, n.b AS nb, n.c AS nc, n.kind AS nk, n.i AS ni, {overlaps} AS o FROM s JOIN x n ON n.doc_id = s.doc_id AND n.k = s.k + 1))), e AS (SELECT doc_id, pa AS a, pb AS b, pk AS kind FROM s WHERE closes UNION ALL SELECT doc_id, a, b, kind FROM s JOIN (SELECT doc_id, max(k) AS k FROM x GROUP BY doc_id) USING (doc_id, k)) SELECT doc_id, kind, a AS start, b AS \"end\", count(*) AS n FROM e GROUP BY ALL"


def _folded(spark: SparkSession, sf_dir: str, fold) -> DataFrame:
    """Line items stand in for spans: places by part and supplier, in the order of their numbers."""
    start = (F.col("l_partkey") % 40).cast("int")
    span = F.struct(F.col("l_linenumber").alias("i"), F.struct(F.col("l_returnflag").alias("entity_type"), F.lit("").alias("text"), start.alias("start"), (start + F.col("l_suppkey") % 12 + 1).cast("int").alias("end"), ((F.col("l_linenumber") * 7 % 5) / 10.0).cast("double").alias("confidence")).alias("s"))
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(span)).alias("x"))
    rows = spans.select("doc_id", F.explode(fold(F.transform("x", lambda e: e["s"]).cast(SPANS))).alias("s"))
    return rows.groupBy("doc_id", F.col("s.entity_type").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.count("*").alias("n"))


query("overlaps_removed", _fold_sql("n.a < s.b"))(lambda spark, sf_dir: _folded(spark, sf_dir, surest_wins))
query("overlaps_resolved", _fold_sql("(n.a < s.b AND s.a < n.b)"))(lambda spark, sf_dir: _folded(spark, sf_dir, current_wins))


# Vault


@query("vault_deleted", Q.over_probed("SELECT session_id, placeholder FROM vault WHERE session_id::BIGINT % 5 <> 0 AND NOT (session_id::BIGINT % 3 = 0 AND placeholder = '[SSN_1]')", _NUMBERED))
def vault_deleted(spark, sf_dir):
    rows = _vault(spark, sf_dir)
    number = F.col("session_id").cast("long")
    return A.without(rows, rows.where(number % 5 == 0), rows.where((number % 3 == 0) & (F.col("placeholder") == "[SSN_1]"))).select("session_id", "placeholder")


@query("vault_cleanup", Q.over_probed(f"SELECT count(*) FILTER (ts + INTERVAL 1 HOUR <= TIMESTAMP '{_NOW}') AS removed, count(*) FILTER (ts + INTERVAL 1 HOUR > TIMESTAMP '{_NOW}') AS kept FROM vault", _NUMBERED))
def vault_cleanup(spark, sf_dir):
    kept, removed = A.cleaned(_vault(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz"))
    return removed.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))  # a row each


# Logs and files


@query("log_lines", "SELECT ts, lower(event_type) AS level, 'api' AS target, value AS latency_ms FROM events")
def log_lines(spark, sf_dir):
    """Events written as JSON log lines, and read again."""
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.upper("event_type").alias("level"), F.lit("api").alias("target"), F.concat(F.lit("done latency_ms="), F.col("value").cast("string")).alias("message")))
    return IO.log_lines(table(spark, sf_dir, "events").select(line.alias("value"))).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "target", "latency_ms")


@query("system_logs", "SELECT date_trunc('second', ts) AS ts, 'host' || user_id % 5 AS hostname, event_type AS program, props AS message FROM events")
def system_logs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 5).cast("string"), F.lit(" "), F.col("event_type"), F.lit(": "), F.col("props"))
    lines = events.select(line.alias("value")).unionByName(events.select(F.lit("no log line").alias("value")))
    return IO.system_logs(lines, 2024).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "hostname", "program", "message")


@query("container_logs", "SELECT 'c' || user_id % 4 AS container_id, 'stdout' AS stream, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1, 2")
def container_logs(spark, sf_dir):
    path = F.concat(F.lit("/var/lib/docker/containers/c"), (F.col("user_id") % 4).cast("string"), F.lit("/x.log"))
    line = F.to_json(F.struct(F.lit("stdout").alias("stream"), F.col("props").alias("log"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")))
    rows = IO.container_logs(table(spark, sf_dir, "events").select(path.alias("path"), line.alias("value")))
    return rows.groupBy("container_id", "stream").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("time_partitions", "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1")
def time_partitions(spark, sf_dir):
    """Events by day in the shared folder; a range reads its days' folders only."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    IO.by_day(table(spark, sf_dir, "events"), path)
    return IO.day_range(spark, path, "2024-01-05", "2024-01-08").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("files_round_trip", "SELECT 'json' AS kind, conv_id::VARCHAR || '-' || turn AS id, text, len(string_split(text, ' '))::BIGINT AS n FROM conversations UNION ALL SELECT 'csv', conv_id::VARCHAR || '-' || turn, role, turn::BIGINT FROM conversations")
def files_round_trip(spark, sf_dir):
    """Prompts as JSON and results as CSV with a header, written to the shared folder and read again."""
    talk = table(spark, sf_dir, "conversations")
    ids = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    IO.write_prompts(talk.select(ids.alias("id"), "text", F.col("role").alias("category"), F.array(F.lit("none")).alias("expected_threats"), big(F.size(F.split("text", " "))).alias("word_count")), f"{base}/prompts")
    half = F.col("turn") % 2 == 0
    for part in (half, ~half):
        IO.append_results(talk.where(part).select(ids.alias("id"), "role", "turn"), f"{base}/results")
    prompts = spark.read.schema("id string, text string, category string, expected_threats array<string>, word_count long").json(f"{base}/prompts")
    results = IO.results(spark, f"{base}/results", "id string, role string, turn long")
    return prompts.select(F.lit("json").alias("kind"), "id", "text", F.col("word_count").alias("n")).unionByName(results.select(F.lit("csv").alias("kind"), "id", F.col("role").alias("text"), F.col("turn").alias("n")))


# Lookups and reports


@query("point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_nationkey")


@query("prompt_mix", "SELECT category, n, true AS sizes_fit, threats FROM (VALUES " + ", ".join(f"('{k}', {int(1000 * share)}::BIGINT, {int(1000 * share) if k in ('secrets', 'injection', 'toxic') else 0}::BIGINT)" for k, (share, _, _) in R.MIX.items()) + ") AS v(category, n, threats)")
def prompt_mix(spark, sf_dir):
    bounds = F.create_map(*(x for k, (_, low, high) in R.MIX.items() for x in (F.lit(k), F.struct(F.lit(low).alias("low"), F.lit(high + 12).alias("high")))))
    rows = R.prompts(spark, 1000).withColumn("b", F.element_at(bounds, F.col("category")))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.bool_and((F.col("word_count") >= F.col("b.low")) & (F.col("word_count") <= F.col("b.high"))).alias("sizes_fit"), F.sum(big(F.size("expected_threats"))).alias("threats"))


@query("bench_targets", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in R.TARGETS.items()) + ") AS v(target_id, query)")
def bench_targets(spark, sf_dir):
    return _rows(spark, ["target_id", "query"], list(R.TARGETS.items())).dropDuplicates(["target_id"])


_FAILED = "event_type = 'error'"


@query("markdown_report", f"""
WITH r AS (SELECT event_type AS target_id, CASE WHEN {_FAILED} THEN 'failed' END AS error, CASE WHEN NOT ({_FAILED}) THEN avg(value) END AS mean_ms, CASE WHEN NOT ({_FAILED}) THEN max(value) END AS p99_ms FROM events GROUP BY event_type),
n AS (SELECT count(*) AS n, count(error) AS bad FROM r)
SELECT 100 AS part, target_id AS name, '| ' || target_id || ' | ' || CASE WHEN error IS NULL THEN 'Passed' ELSE 'Failed' END || ' | ' || coalesce('Error: ' || error, 'Mean: ' || printf('%.2f', mean_ms) || ', P99: ' || printf('%.2f', p99_ms)) || ' |' AS line FROM r
UNION ALL SELECT part, '', line FROM n, LATERAL (SELECT unnest(range(13)) AS part, unnest(['# Benchmark Results', '', '## Summary', '', '- **Total Benchmarks**: ' || n, '- **Successful**: ' || (n - bad), '- **Failed**: ' || bad, '- **Success Rate**: ' || printf('%.1f', (n - bad) * 100.0::DOUBLE / n) || '%', '', '## Results', '', '| Target ID | Status | Key Metrics |', '|-----------|--------|-------------|']) AS line)""")
def markdown_report(spark, sf_dir):
    failed = F.col("event_type") == "error"
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    results = sums.select(F.col("event_type").alias("target_id"), F.when(failed, "failed").alias("error"), F.when(~failed, F.col("mean")).alias("mean_ms"), F.when(~failed, F.col("most")).alias("p99_ms"))
    return R.markdown(results)
