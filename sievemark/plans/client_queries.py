"""Queries of the client's pattern scanners, the line scan, the small shields, hooks, and both sides of an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.operators import patterns as C
from sievemark.operators import scanners as S
from sievemark.plans import shield as P
from sievemark.plans import sql as Q
from sievemark.plans.flow_queries import _RISKS, T
from sievemark.plans.scan_queries import _LUHN, big, probed, six
from sievemark.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = oracle
        return f

    return keep


fix = lambda p: p.replace("(?i:", "(?i)(?:", 1) if p.startswith("(?i:") else p
_SUM = lambda n: f"round(least(1.0, {n})::DOUBLE, 6)"

# Personal data


def _client_pii_sql(kinds: list[str]) -> str:
    parts = []
    for name, kind, severity, pattern in L.CLIENT_PII:
        if kind in kinds:
            each = f"SELECT doc_id, {Q.text(name)} AS type, '{kind}' AS kind, '{severity}' AS severity, unnest({Q.matches(pattern)}) AS m FROM probed"
            if kind == "credit-card":
                each = f"SELECT doc_id, type, kind, severity, m FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({each})) WHERE {_LUHN}"
            elif kind == "ssn":
                each = f"SELECT doc_id, type, kind, severity, m FROM (SELECT *, left(regexp_replace(m, '[^0-9]', '', 'g'), 3)::INT AS area FROM ({each})) WHERE area <> 0 AND area <> 666 AND area < 900"
            parts.append(each)
    return ", pii AS (" + " UNION ALL ".join(parts) + ")"


_ALL_KINDS = list(dict.fromkeys(k for _, k, _, _ in L.CLIENT_PII))
_MASK = "CASE kind WHEN 'email' THEN left(split_part(m, '@', 1), 2) || '***@' || split_part(m, '@', 2) WHEN 'credit-card' THEN '****-****-****-' || right(m, 4) WHEN 'ssn' THEN '***-**-' || right(m, 4) WHEN 'phone' THEN '***-***-' || right(m, 4) ELSE '****' END"


@query("client_pii_masked", Q.over_probed(f"SELECT doc_id, type, {_MASK} AS shown, count(*) AS n FROM pii GROUP BY ALL", _client_pii_sql(_ALL_KINDS)))
def client_pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probed(spark, sf_dir).select("doc_id", F.explode(C.client_pii(F.col(T), _ALL_KINDS)["entities"]).alias("s"))
    return rows.groupBy("doc_id", F.col("s.entity_type").alias("type"), F.col("s.text").alias("shown")).agg(F.count("*").alias("n"))


_WEIGHT = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END"


@query("client_pii_risk", Q.over_probed(f"SELECT doc_id, count(*) AS factors, round(avg({_WEIGHT} * 0.9)::DOUBLE, 6) AS risk, max(severity = 'critical') AS critical FROM (SELECT DISTINCT doc_id, type, severity FROM pii) GROUP BY doc_id", _client_pii_sql(L.CLIENT_PII_DEFAULT)))
def client_pii_risk(spark, sf_dir):
    rows = probed(spark, sf_dir).select("doc_id", C.client_pii(F.col(T)).alias("r")).where("not r.is_valid")
    return rows.select("doc_id", big(F.size("r.factors")).alias("factors"), six(F.col("r.risk_score")).alias("risk"), (F.col("r.severity") == "critical").alias("critical"))


# Injection and toxicity

_N_INJECTION = " + ".join(f"len({Q.matches(fix(p))})" for p in L.INJECTION_PATTERNS)


@query("client_injection", Q.over_probed(f"SELECT doc_id, n, round(least(0.9, 0.5 + 0.1 * n)::DOUBLE, 6) AS confidence, round((0.75 * least(0.9, 0.5 + 0.1 * n))::DOUBLE, 6) AS risk FROM (SELECT doc_id, {_N_INJECTION} AS n FROM probed) WHERE n > 0"))
def client_injection(spark, sf_dir):
    rows = probed(spark, sf_dir).select("doc_id", C.client_injection(F.col(T)).alias("r")).where("not r.is_valid")
    factor = F.get("r.factors", F.lit(0))
    return rows.select("doc_id", big(factor["n"]).alias("n"), six(factor["confidence"]).alias("confidence"), six(F.col("r.risk_score")).alias("risk"))


_ALLOWED, _CUSTOM = ["attack"], ["free", "chess"]
_COUNTS = {c: " + ".join(f"len(list_filter({Q.matches(fix(p))}, lambda m: lower(m) NOT IN ({', '.join(map(Q.text, _ALLOWED))})))" for p in ps) for c, (_, ps) in L.TOXIC_PATTERNS.items()}
_COUNTS["profanity"] += " + len(" + Q.matches(r"(?i)\b(?:free|chess)\b") + ")"


@query("toxic_categories", Q.over_probed("SELECT kind, count(*) AS docs, sum(n)::BIGINT AS n, round(max(least(0.95, 0.6 + 0.05 * n))::DOUBLE, 6) AS peak FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {n} AS n FROM probed" for k, n in _COUNTS.items()) + ") WHERE n > 0 GROUP BY kind"))
def toxic_categories(spark, sf_dir):
    found = C.client_toxicity(F.col(T), list(L.TOXIC_PATTERNS), tuple(_CUSTOM), tuple(_ALLOWED))
    rows = probed(spark, sf_dir).select(F.explode(found["factors"]).alias("f"))
    kind = F.substring_index(F.substring_index("f.description", " content", 1), "Detected ", -1)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("docs"), F.sum(big(F.col("f.n"))).alias("n"), F.round(F.max("f.confidence"), 6).alias("peak"))


@query("client_merged", Q.over_probed(f"SELECT doc_id, i = 0 AND p IS NULL AS is_valid, round(greatest(CASE WHEN i > 0 THEN 0.75 * least(0.9, 0.5 + 0.1 * i) ELSE 0 END, coalesce(p, 0))::DOUBLE, 6) AS risk, (i + coalesce(e, 0))::BIGINT AS entities FROM (SELECT doc_id, {_N_INJECTION} AS i FROM probed) LEFT JOIN (SELECT doc_id, avg({_WEIGHT} * 0.9) AS p FROM (SELECT DISTINCT doc_id, type, severity FROM pii) GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS e FROM pii GROUP BY doc_id) USING (doc_id)", _client_pii_sql(["email", "ssn"])))
def client_merged(spark, sf_dir):
    t = F.col(T)
    rows = probed(spark, sf_dir).select("doc_id", C.client_injection(t).alias("a"), C.client_pii(t, ["email", "ssn"], False).alias("b"), t)
    both = C.merged(t, [F.col("a"), F.col("b"), F.col("b")])
    return rows.select("doc_id", both["is_valid"].alias("is_valid"), six(both["risk_score"]).alias("risk"), big(F.size(both["entities"])).alias("entities"))


# Line scan


def _finding_sql() -> str:
    each = []
    for category, kind, severity, pattern, first, shown in C.LINE_FAMILIES:
        p = Q.text(fix(pattern))
        name = f"'{category}' AS category, {Q.text(kind)} AS type, '{severity}' AS severity"
        if first:
            show = f"left(m, {shown}) || CASE WHEN length(m) > {shown} THEN '...' ELSE '' END" if shown else "m"
            each.append(f"SELECT doc_id, line, {name}, strpos(l, m) AS col, {show} AS match FROM (SELECT *, regexp_extract(l, {p}) AS m FROM lines WHERE regexp_matches(l, {p}))")
        else:
            place = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) + 1"
            each.append(f"SELECT doc_id, line, {name}, ({place})::BIGINT AS col, left(g[i], {shown}) || '****' AS match FROM (SELECT doc_id, line, g, s, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, line, regexp_extract_all(l, {p}) AS g, string_split_regex(l, {p}) AS s FROM lines))")
    return f", lines AS (SELECT doc_id, generate_subscripts(p, 1)::BIGINT AS line, unnest(p) AS l FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM probed)), found AS ({' UNION ALL '.join(each)})"


def _findings(spark: SparkSession, sf_dir: str, categories: list[str] | None = None) -> DataFrame:
    return C.line_findings(probed(spark, sf_dir).select("doc_id", T), T, categories).withColumnRenamed("column", "col")


query("line_scan_findings", Q.over_probed("SELECT * FROM found", _finding_sql()))(_findings)
query("line_scan_filtered", Q.over_probed("SELECT * FROM found WHERE category IN ('pii', 'toxicity')", _finding_sql()))(lambda spark, sf_dir: _findings(spark, sf_dir, ["pii", "toxicity"]))


@query("line_scan_summary_rollup", Q.over_probed("SELECT category, severity, count(*) AS n, count(DISTINCT doc_id) AS files FROM found GROUP BY ROLLUP (category, severity)", _finding_sql()))
def line_scan_summary_rollup(spark, sf_dir):
    """Files are made distinct where they are found, so that the roll-up counts small rows."""
    by_file = _findings(spark, sf_dir).groupBy("doc_id", "category", "severity").agg(F.count("*").alias("c"))
    return by_file.rollup("category", "severity").agg(F.sum("c").alias("n"), F.countDistinct("doc_id").alias("files"))


@query("line_scan_summary", Q.over_probed("SELECT count(*) AS total_issues, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c.replace('-', '_')}" for c in ("prompt-injection", "secret", "pii", "toxicity")) + ", " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("low", "medium", "high", "critical")) + " FROM found", _finding_sql()))
def line_scan_summary(spark, sf_dir):
    return C.summary(_findings(spark, sf_dir))


@query("line_scan_gate", Q.over_probed("SELECT level, count(*) FILTER (CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END >= k) AS failing, count(*) FILTER (CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END >= k) > 0 AS fails FROM found, (VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) AS v(level, k) GROUP BY level", _finding_sql()))
def line_scan_gate(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    counts = rows.agg(*(F.count_if(C.fails(F.col("severity"), s)).alias(s) for s in ("low", "medium", "high", "critical")))
    levels = F.array(*(F.struct(F.lit(s).alias("level"), F.col(s).alias("failing")) for s in ("low", "medium", "high", "critical")))
    return counts.select(F.inline(levels)).withColumn("fails", F.col("failing") > 0)


# Small shields

_CORE_SECRETS = " + ".join(f"len({Q.matches(p)})" for _, p in L.CORE_SECRETS)
_CORE_HIT = " OR ".join(f"regexp_matches(t, {Q.text(fix(p))})" for p in L.CORE_INJECTION)


@query("core_shield", Q.over_probed(f"SELECT doc_id, NOT i AND n = 0 AS is_valid, CASE WHEN n > 0 THEN 1.0 WHEN i THEN 0.9 ELSE 0 END::DOUBLE AS risk, i::BIGINT + (n > 0)::BIGINT AS detections, n AS secrets FROM (SELECT doc_id, {_CORE_HIT} AS i, {_CORE_SECRETS} AS n FROM probed)"))
def core_shield(spark, sf_dir):
    rows = probed(spark, sf_dir).select("doc_id", C.core_shield(F.col(T)).alias("r"))
    return rows.select("doc_id", "r.is_valid", F.col("r.risk_score").alias("risk"), big(F.col("r.detections")).alias("detections"), big(F.size("r.secrets")).alias("secrets"))


@query("browser_checks", Q.over_probed("SELECT doc_id, contains(lower(t), 'ignore previous instructions') AS injection, contains(t, '@') AND contains(t, '.') AS email, length(t) - length(regexp_replace(t, '\\p{N}', '', 'g')) >= 10 AS phone, " + Q.any_hit(["hate", "kill", "destroy"]) + " AS toxic FROM probed"))
def browser_checks(spark, sf_dir):
    return probed(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in C.browser_checks(F.col(T)).items()))


# Shields over both sides, batches, hooks, lists

_TALK = "talk AS (SELECT y.conv_id, y.turn, x.text AS p, y.text AS t FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND y.role = 'assistant')"


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spread(table(spark, sf_dir, "conversations"))
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output")).join(asked, ["conv_id", "turn"])


@query("shield_both_sides", f"WITH {_TALK} SELECT conv_id, turn, ceil(strlen(p) / 4.0) <= 12 AS prompt_valid, round(greatest(r, b), 6) AS output_risk, r < 0.7 AND b < 0.6 AS output_valid FROM (SELECT *, {Q.peak(Q.scored_hits([x for k in ('gender', 'racial', 'age', 'religious') for x in L.BIAS[k]]))} AS b, {Q.peak(f'list_concat(list_concat({Q.scored_hits(L.REFUSAL_DIRECT)}, CASE WHEN {Q.any_hit(L.REFUSAL_CUES)} THEN {Q.scored_hits(L.REFUSAL_SAFETY)} ELSE [] END), {Q.scored_hits(L.REFUSAL_CAPABILITY)})')} AS r FROM talk)")
def shield_both_sides(spark, sf_dir):
    inputs = P.Shield({"token_limit": lambda t: S.token_limit(t, 12)})
    outputs = P.Shield({"no_refusal": S.no_refusal, "bias": S.bias})
    out = P.scan_both(_exchanges(spark, sf_dir), inputs, outputs)
    return out.select("conv_id", "turn", F.col("prompt_verdict.is_valid").alias("prompt_valid"), six(F.col("output_verdict.risk_score")).alias("output_risk"), F.col("output_verdict.is_valid").alias("output_valid"))


@query("batch_guard", "SELECT doc_id // 64 AS batch, count(*) AS n, 'batch size ' || count(*) || ' exceeds maximum 50' AS error FROM documents GROUP BY 1 HAVING count(*) > 50")
def batch_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 64").alias("batch"))
    return P.Shield.preset("strict").batch_errors(docs, "batch")


_LISTED = [("Acme", True), ("CHESS", False)]


@query("allowed_patterns", Q.over_probed("SELECT doc_id, contains(t, 'Acme') OR contains(lower(t), 'chess') AS allowed, true AS open FROM probed"))
def allowed_patterns(spark, sf_dir):
    rules = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("case_sensitive")) for p, c in _LISTED))
    none = F.filter(rules, lambda r: F.lit(False))
    return probed(spark, sf_dir).select("doc_id", P.allowed(F.col(T), rules).alias("allowed"), P.allowed(F.col(T), none).alias("open"))


_BOMB, _LONG, _JAIL = "contains(lower(t), 'bomb')", "strlen(t) > 3000", "contains(t, 'jailbreak')"


@query("hooks_pre", Q.over_probed(f"SELECT doc_id, CASE WHEN {_BOMB} THEN 'rejected' WHEN {_LONG} THEN 'approved' WHEN {_JAIL} THEN 'rejected' WHEN lang IN ('en', 'de') THEN 'modify' ELSE 'continue' END AS decision, CASE WHEN {_BOMB} THEN 'violent' WHEN {_LONG} THEN 'long' WHEN {_JAIL} THEN 'Hook error (blocked): broken' ELSE '' END AS reason, CASE WHEN {_BOMB} OR {_LONG} OR {_JAIL} THEN 0 WHEN lang = 'de' THEN 0.2 WHEN lang = 'en' THEN 0.1 ELSE 0 END::DOUBLE AS adjustment FROM probed"))
def hooks_pre(spark, sf_dir):
    t = F.col(T)
    hooks = [
        P.Hook(F.col("lang") == "en", "adjust", 0.1), P.Hook(F.contains(F.lower(t), F.lit("bomb")), "reject", reason="violent"), P.Hook(F.lit(True), "reject", enabled=False), P.Hook(F.octet_length(t) > 3000, "approve", reason="long"),
        P.Hook(F.contains(t, F.lit("jailbreak")), "error", reason="broken", fallback="block"), P.Hook(F.lit(True), "error", reason="passed over"), P.Hook(F.col("lang") == "de", "adjust", 0.2),
    ]
    return probed(spark, sf_dir).select("doc_id", P.pre_hooks(hooks).alias("h")).select("doc_id", "h.*")


_KEY = "contains(t, 'RSA PRIVATE')"


@query("hooks_post", Q.over_probed(f"SELECT doc_id, round(CASE WHEN {_KEY} OR blocked THEN 1 WHEN {_JAIL} THEN a ELSE c END::DOUBLE, 6) AS risk, CASE WHEN {_KEY} OR blocked THEN false ELSE b < 0.7 END AS is_valid, CASE WHEN blocked THEN 'de' WHEN {_KEY} THEN 'secret' WHEN {_JAIL} THEN 'known' END AS override FROM (SELECT *, CASE WHEN {_LONG} THEN greatest(0.0, a - 0.3) ELSE a END AS c FROM (SELECT probed.*, b, lang = 'de' AND b >= 0.7 AS blocked, CASE WHEN lang = 'en' THEN least(1.0, b + 0.15) ELSE b END AS a FROM probed JOIN (SELECT doc_id, b FROM risks) USING (doc_id)))", _RISKS))
def hooks_post(spark, sf_dir):
    t = F.col(T)
    risk = S.no_refusal(t)["risk_score"]
    action = F.when((F.col("lang") == "de") & (risk >= 0.7), "block").otherwise("allow")
    hooks = [
        P.policy_pre_check(action, "de"), P.config_threshold(risk, 0.5), P.Hook(F.col("lang") == "en", "adjust", 0.15), P.Hook(F.contains(t, F.lit("RSA PRIVATE")), "reject", reason="secret"),
        P.Hook(F.contains(t, F.lit("jailbreak")), "approve", reason="known"), P.Hook(F.octet_length(t) > 3000, "adjust", -0.3),
    ]
    out = probed(spark, sf_dir).select("doc_id", P.post_hooks(risk, risk < 0.7, hooks).alias("h"))
    return out.select("doc_id", six(F.col("h.risk_score")).alias("risk"), "h.is_valid", "h.override")


@query("shield_once_per_text", Q.over_probed("SELECT source, count(*) AS n, count(*) FILTER (ceil(strlen(text) / 4.0) > 500) AS invalid FROM documents GROUP BY source"))
def shield_once_per_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("source", "text")
    out = P.Shield({"token_limit": lambda t: S.token_limit(t, 500)}).scan_once(docs)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("verdict.is_valid")).alias("invalid"))
