"""Queries of the scanners over `documents`, `conversations` and `pages`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.spans import first_wins, splice
from sievemark.functions.text import any_of, ascii_bounds, count_class, entropy, hits, ipv4, luhn, regex_spans
from sievemark.operators import scanners as S
from sievemark.plans import sql as Q
from sievemark.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a sentence added by doc_id, so that every scanner has something to find."""
    docs = spread(table(spark, sf_dir, "documents"))
    probe = F.element_at(F.array(*map(F.lit, L.PROBES)), (F.col("doc_id") % len(L.PROBES) + 1).cast("int"))
    return docs.select("doc_id", "lang", F.concat("text", F.lit(" "), probe).alias("t"))


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def of_probed(name: str, columns: Callable[[Column], dict[str, Column]], oracle: str) -> None:
    """A query that projects columns, made from the text, of each probed document."""
    QUERIES[name] = lambda spark, sf_dir: probed(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in columns(F.col("t")).items()))
    ORACLES[name] = Q.over_probed(oracle)


def pick(result: Column, **parts: Callable[[Column], Column]) -> dict[str, Column]:
    return {k: f(result) for k, f in parts.items()}


def count_of(result: Column) -> Column:
    return big(F.size(result["entities"]))


big = lambda c: c.cast("long")
six = lambda c: F.round(c.cast("double"), 6)


# PII


def _pii_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.pii_spans(F.col("t"), [k for k, _, _ in L.SENSITIVE if k not in ("person",)])
    return probed(spark, sf_dir).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


_LUHN = "(len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) * 2 > 9 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0)"
_IPV4 = "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS INT) <= 255)) = 4"


def _pii_sql(kinds: list[str]) -> str:
    parts = []
    for kind, pattern, _ in L.SENSITIVE:
        if kind in kinds:
            each = f"SELECT doc_id, '{kind}' AS kind, unnest({Q.matches(pattern)}) AS m FROM probed"
            if kind == "credit_card":
                each = f"SELECT doc_id, kind, m FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({each})) WHERE {_LUHN}"
            elif kind == "ip_address":
                each = f"SELECT * FROM ({each}) WHERE {_IPV4}"
            parts.append(each)
    return ", pii AS (" + " UNION ALL ".join(parts) + ")"


_PII_KINDS = [k for k, _, _ in L.SENSITIVE if k != "person"]


@query("pii_entity_counts", Q.over_probed("SELECT kind AS entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(strlen(m))::BIGINT AS n_bytes FROM pii GROUP BY kind", _pii_sql(_PII_KINDS)))
def pii_entity_counts(spark, sf_dir):
    rows = _pii_rows(spark, sf_dir)
    return rows.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


@query("pii_flagged_docs", Q.over_probed("SELECT doc_id, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM pii GROUP BY doc_id", _pii_sql(L.SENSITIVE_DEFAULT)))
def pii_flagged_docs(spark, sf_dir):
    found = S.pii_spans(F.col("t"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["entity_type"]))), ",")
    return probed(spark, sf_dir).select("doc_id", big(F.size(found)).alias("n"), kinds.alias("kinds")).where("n > 0")


_EMAIL = L.SENSITIVE[0][1]
of_probed("pii_redacted_text", lambda t: {"n": big(F.size(regex_spans(t, _EMAIL))), "redacted": splice(t, first_wins(regex_spans(t, _EMAIL)), lambda s, i: F.lit("[REDACTED]"))}, f"SELECT doc_id, len({Q.matches(_EMAIL)}) AS n, regexp_replace(t, {Q.text(_EMAIL)}, '[REDACTED]', 'g') AS redacted FROM probed")


@query("pii_offsets", Q.over_probed(f"SELECT doc_id, i, g[i + 1] AS m, (list_sum(list_transform(p[1:i + 1], lambda x: strlen(x))) + coalesce(list_sum(list_transform(g[1:i], lambda x: strlen(x))), 0))::BIGINT AS start FROM (SELECT doc_id, g, p, unnest(range(len(g))) AS i FROM (SELECT doc_id, {Q.matches(L.SENSITIVE[3][1])} AS g, string_split_regex(t, {Q.text(L.SENSITIVE[3][1])}) AS p FROM probed))"))
def pii_offsets(spark, sf_dir):
    each = probed(spark, sf_dir).select("doc_id", F.posexplode(regex_spans(F.col("t"), L.SENSITIVE[3][1])).alias("i", "s"))
    return each.select("doc_id", big(F.col("i")).alias("i"), F.col("s.text").alias("m"), big(F.col("s.start")).alias("start"))


_CARD = L.SENSITIVE[2][1]


@query("luhn_valid_cards", Q.over_probed(f"SELECT doc_id, m, d, coalesce({_LUHN}, false) AS valid FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest({Q.matches(_CARD)}) AS m FROM probed))"))
def luhn_valid_cards(spark, sf_dir):
    each = probed(spark, sf_dir).select("doc_id", F.explode(regex_spans(F.col("t"), _CARD)).alias("s")).select("doc_id", F.col("s.text").alias("m"))
    return each.select("doc_id", "m", F.regexp_replace("m", "[^0-9]", "").alias("d"), luhn(F.col("m")).alias("valid"))


@query("ipv4_valid", Q.over_probed(f"SELECT doc_id, m, {_IPV4} AS valid FROM (SELECT doc_id, unnest({Q.matches(L.SENSITIVE[4][1])}) AS m FROM probed)"))
def ipv4_valid(spark, sf_dir):
    each = probed(spark, sf_dir).select("doc_id", F.explode(regex_spans(F.col("t"), L.SENSITIVE[4][1])).alias("s")).select("doc_id", F.col("s.text").alias("m"))
    return each.select("doc_id", "m", ipv4(F.col("m")).alias("valid"))


# Word and phrase scanners

_BANNED = ["idiot", "bomb", "free", "this"]
of_probed("ban_substrings", lambda t: pick(S.ban_substrings(t, _BANNED, redact=True), n=count_of, is_valid=lambda r: r["is_valid"], risk=lambda r: r["risk_score"]), f"SELECT doc_id, len({Q.matches(any_of(_BANNED), 'lower(t)')}) AS n, len({Q.matches(any_of(_BANNED), 'lower(t)')}) = 0 AS is_valid, CASE WHEN len({Q.matches(any_of(_BANNED), 'lower(t)')}) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS risk FROM probed")
of_probed("ban_substrings_word", lambda t: pick(S.ban_substrings(t, ["idiot", "fool", "the"], whole_words=True), n=count_of, is_valid=lambda r: r["is_valid"]), "SELECT doc_id, len(w) AS n, len(w) = 0 AS is_valid FROM (SELECT doc_id, list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: w IN ('idiot', 'fool', 'the')) AS w FROM probed)")
of_probed("ban_competitors_redact", lambda t: pick(S.ban_competitors(t, ["Acme Tools", "Main Street"]), sanitized=lambda r: r["sanitized_text"], is_valid=lambda r: r["is_valid"]), "SELECT doc_id, regexp_replace(t, '(?i)\\b(Acme Tools|Main Street)\\b', '[COMPETITOR]', 'g') AS sanitized, NOT regexp_matches(t, '(?i)\\b(Acme Tools|Main Street)\\b') AS is_valid FROM probed")


@query("ban_code_signals", Q.over_probed("SELECT doc_id, " + ", ".join(f"len({Q.matches(p)}) AS n_{k}" for k, p, _ in L.CODE_PATTERNS) + f", len({Q.hits(L.CODE_KEYWORDS)}) AS n_keyword FROM probed"))
def ban_code_signals(spark, sf_dir):
    return probed(spark, sf_dir).select("doc_id", *(big(F.size(regex_spans(F.col("t"), p))).alias(f"n_{k}") for k, p, _ in L.CODE_PATTERNS), big(F.size(hits(F.lower(F.col("t")), L.CODE_KEYWORDS))).alias("n_keyword"))


_KEYWORD = "SELECT doc_id, 100 AS rank, i, 'keyword' AS kind, 0.7::DOUBLE AS c, k AS m, strlen(string_split(lower(t), k)[1])::BIGINT AS a FROM (SELECT doc_id, t, unnest(f) AS k, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, t, " + Q.hits(L.CODE_KEYWORDS) + " AS f FROM probed))"
_CODE_SPANS = Q.spans([(k, p, c, "") for k, p, c in L.CODE_PATTERNS]).replace("length(x)", "strlen(x)").replace("a + length(m)", "a + strlen(m)").replace("FROM (SELECT doc_id, 0 AS rank", f"FROM ({_KEYWORD} UNION ALL SELECT doc_id, 0 AS rank", 1)
_CODE_KEPT = f""", x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, rank, i) AS k FROM {_CODE_SPANS}),
s AS (SELECT doc_id, k, b AS upto, b - a AS covered, c, true AS fits FROM x WHERE k = 1 UNION ALL SELECT s.doc_id, n.k, CASE WHEN n.a >= s.upto THEN n.b ELSE s.upto END, n.b - n.a, n.c, n.a >= s.upto FROM s JOIN x n ON n.doc_id = s.doc_id AND n.k = s.k + 1),
code AS (SELECT doc_id, sum(covered) AS covered, avg(c) AS sure, count(*) AS n FROM s WHERE fits GROUP BY doc_id)"""


@query("ban_code_risk", Q.over_probed("SELECT doc_id, round(CASE WHEN r < 0.5 THEN 0 ELSE r END::DOUBLE, 6) AS risk, r < 0.5 AS is_valid, n AS spans FROM (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE least(1.0, covered / strlen(t) * 0.6 + sure * 0.4) END AS r FROM probed LEFT JOIN code USING (doc_id))", _CODE_KEPT).replace("WITH probed", "WITH RECURSIVE probed", 1))
def ban_code_risk(spark, sf_dir):
    code = S.ban_code(F.col("t"))
    return probed(spark, sf_dir).select("doc_id", six(code["risk_score"]).alias("risk"), code["is_valid"].alias("is_valid"), big(F.size(code["entities"])).alias("spans"))


of_probed("token_limit", lambda t: pick(S.token_limit(t, 500), tokens=lambda r: big(r["metadata"]["token_count"]), is_valid=lambda r: r["is_valid"], risk=lambda r: r["risk_score"], overflow=lambda r: big(r["metadata"]["overflow"])), "SELECT doc_id, n AS tokens, n <= 500 AS is_valid, CASE WHEN n <= 500 THEN 0.0 ELSE least(1.0, n / 500.0) END::DOUBLE AS risk, greatest(n - 500, 0)::BIGINT AS overflow FROM (SELECT doc_id, ceil(strlen(t) / 4.0)::BIGINT AS n FROM probed)")

_INVISIBLE = "".join([*L.ZERO_WIDTH, *L.DIRECTIONS])
of_probed("invisible_text_clean", lambda t: pick(S.invisible_text(t), n=count_of, clean=lambda r: r["sanitized_text"]), f"SELECT doc_id, length(t) - length(regexp_replace(t, '[{_INVISIBLE}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS n, regexp_replace(t, '[{_INVISIBLE}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS clean FROM probed")

_RULES = [("order", "[A-Z]{2}[0-9]{4}", 0.4), ("mail", _EMAIL, 0.6), ("ssn", L.SENSITIVE[3][1], 0.9)]
of_probed("regex_scanner_max_risk", lambda t: pick(S.regex_scan(t, _RULES), risk=lambda r: r["risk_score"], matches=count_of), "SELECT doc_id, greatest(" + ", ".join(f"CASE WHEN len({Q.matches(p)}) > 0 THEN {r} ELSE 0.0 END" for _, p, r in _RULES) + ")::DOUBLE AS risk, " + " + ".join(f"len({Q.matches(p)})" for _, p, _ in _RULES) + " AS matches FROM probed")

of_probed("gibberish_signals", lambda t: pick(S.gibberish_parts(t), keyboard=lambda p: six(p["keyboard"]), vowels=lambda p: six(p["vowels"])), f"SELECT doc_id, round(least(1.0, len({Q.hits(L.KEYBOARD)}) / 5.0)::DOUBLE, 6) AS keyboard, round(CASE WHEN r < 0.15 OR r > 0.6 THEN least(1.0, abs(r - 0.4) / 0.4) ELSE 0.0 END::DOUBLE, 6) AS vowels FROM (SELECT doc_id, t, length(regexp_replace(lower(t), '[^aeiou]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(lower(t), '[^\\p{{L}}]', '', 'g')), 0) AS r FROM probed)")


_ALPHA = "regexp_replace(lower(t), '[^\\p{L}]', '', 'g')"
_GIBBERISH = f"""
, chars AS (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, string_split(t, '') AS c FROM probed)),
runs AS (SELECT doc_id, sum((n - 2) * (n - 1) / 2 * 0.2) AS repeated FROM (SELECT doc_id, count(*)::DOUBLE AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM chars) GROUP BY doc_id, c, g) WHERE n >= 3 GROUP BY doc_id),
parts AS (SELECT doc_id, t, {_ALPHA} AS a, list_transform({Q.words()}, lambda w: regexp_replace(lower(w), '[^\\p{{L}}]', '', 'g')) AS w FROM probed),
signs AS (SELECT doc_id, strlen(t) AS size, least(1.0, coalesce(list_sum(list_transform(map_values(list_histogram(string_split(a, ''))), lambda n: -(n::DOUBLE / length(a)) * log2(n::DOUBLE / length(a)))), 0) / 4.7) AS even, length(regexp_replace(a, '[^aeiou]', '', 'g'))::DOUBLE / nullif(length(a), 0) AS r, least(1.0, len({Q.hits(L.KEYBOARD)}) / 5.0) AS keyboard, coalesce(len(list_filter(w, lambda x: strlen(x) >= 2 AND (regexp_matches(x, '[^aeiou]{{5,}}') OR strlen(x) > 3 AND NOT regexp_matches(x, '[aeiou]'))))::DOUBLE / nullif(len(w), 0), 0) AS odd FROM parts)"""


@query("gibberish_score", Q.over_probed("SELECT doc_id, round(CASE WHEN size < 10 THEN 0 ELSE (CASE WHEN even > 0.85 THEN (even - 0.85) / 0.15 ELSE 0 END * 2 + least(1.0, coalesce(repeated, 0) / size) * 1.5 + CASE WHEN r < 0.15 OR r > 0.6 THEN least(1.0, abs(r - 0.4) / 0.4) ELSE 0 END * 1.5 + keyboard * 2 + odd * 1.5) / 8.5 END::DOUBLE, 6) AS score FROM signs LEFT JOIN runs USING (doc_id)", _GIBBERISH))
def gibberish_score(spark, sf_dir):
    return probed(spark, sf_dir).select("doc_id", six(S.gibberish(F.col("t"))["risk_score"]).alias("score"))


of_probed("char_entropy", lambda t: pick(F.regexp_replace(F.lower(t), r"[^\p{L}]", ""), bits=lambda a: F.round(entropy(a, F.length(a)), 6)), "SELECT doc_id, round(coalesce(list_sum(list_transform(map_values(h), lambda n: -(n::DOUBLE / k) * log2(n::DOUBLE / k))), 0), 6) AS bits FROM (SELECT doc_id, length(a) AS k, list_histogram(string_split(a, '')) AS h FROM (SELECT doc_id, regexp_replace(lower(t), '[^\\p{L}]', '', 'g') AS a FROM probed))")

_lat = {k: f"len({Q.hits(v)})" for k, v in L.LATIN_WORDS.items()}
of_probed("language_detect", lambda t: {"code": S.detect_language(t)[0], "latin": big(count_class(t, S.SCRIPTS["latin"])), "letters": big(count_class(t, r"\p{L}"))}, "SELECT doc_id, CASE WHEN letters = 0 THEN 'unknown' WHEN latin > letters // 2 THEN CASE WHEN m < 2 THEN 'en' " + " ".join(f"WHEN n_{k} = m THEN '{k}'" for k in _lat) + " END ELSE 'unknown' END AS code, latin, letters FROM (SELECT *, greatest(" + ", ".join(f"n_{k}" for k in _lat) + ") AS m FROM (SELECT doc_id, length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS latin, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS letters, " + ", ".join(f"{v} AS n_{k}" for k, v in _lat.items()) + " FROM probed))")


@query("secrets_by_type", Q.over_probed("SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (" + " UNION ALL ".join(f"SELECT doc_id, {Q.text(k)} AS kind, unnest({Q.matches(p.replace('(?i:', '(?i)(?:'))}) AS m FROM probed" for k, p in L.SECRETS[:-1]) + ") GROUP BY kind"))
def secrets_by_type(spark, sf_dir):
    each = F.concat(*(regex_spans(F.col("t"), p, k) for k, p in L.SECRETS[:-1]))
    rows = probed(spark, sf_dir).select("doc_id", F.explode(each).alias("s")).select("doc_id", F.col("s.entity_type").alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("secrets_high_entropy", Q.over_probed(f"SELECT doc_id, m, round(list_sum(list_transform(map_values(h), lambda n: -(n::DOUBLE / length(m)) * log2(n::DOUBLE / length(m)))), 6) AS bits FROM (SELECT doc_id, m, list_histogram(string_split(m, '')) AS h FROM (SELECT doc_id, unnest({Q.matches(L.SECRETS[-1][1])}) AS m FROM probed)) WHERE list_sum(list_transform(map_values(h), lambda n: -(n::DOUBLE / length(m)) * log2(n::DOUBLE / length(m)))) >= 3"))
def secrets_high_entropy(spark, sf_dir):
    each = probed(spark, sf_dir).select("doc_id", F.explode(regex_spans(F.col("t"), L.SECRETS[-1][1])).alias("s")).select("doc_id", F.col("s.text").alias("m"))
    each = each.withColumn("raw", entropy(F.col("m"), F.length("m"))).where("raw >= 3")
    return each.select("doc_id", "m", F.round("raw", 6).alias("bits"))


_ENTROPY = "list_sum(list_transform(map_values(list_histogram(string_split(m, ''))), lambda n: -(n::DOUBLE / length(m)) * log2(n::DOUBLE / length(m)))) >= 3"
SECRETS_KEPT = ", " + Q.surest(Q.spans([(k, p, 0.95, "") for k, p in L.SECRETS[:-1]] + [(*L.SECRETS[-1], 0.8, "")], {L.SECRETS[-1][0]: _ENTROPY}))


@query("secrets_redacted", Q.over_probed(f"SELECT doc_id, x.t AS sanitized, types FROM {Q.spliced(chr(39) + '[REDACTED]' + chr(39))} x JOIN (SELECT doc_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM kept GROUP BY doc_id) USING (doc_id)", SECRETS_KEPT).replace("WITH probed", "WITH RECURSIVE probed", 1))
def secrets_redacted(spark, sf_dir):
    found = S.secrets(F.col("t"))
    return probed(spark, sf_dir).select("doc_id", found["sanitized_text"].alias("sanitized"), found["metadata"]["types"].alias("types")).where("types <> ''")


_INJ = [(p, 0.95) for p in L.OVERRIDE] + [(p, 0.8) for p in L.ROLEPLAY] + [(p, 0.75) for p in L.CONTEXT] + [(p, 0.9) for p in L.EXTRACTION]
of_probed("prompt_injection_score", lambda t: pick(S.prompt_injection(t), indicators=count_of, score=lambda r: six(r["risk_score"]), is_valid=lambda r: r["is_valid"]), f"SELECT doc_id, k AS indicators, round(CASE WHEN k = 0 THEN 0.0 ELSE s / k END::DOUBLE, 6) AS score, CASE WHEN k = 0 THEN true ELSE s / k < 0.7 END AS is_valid FROM (SELECT doc_id, n + d + o AS k, s + d * 0.7::DOUBLE + o * 0.6::DOUBLE AS s FROM (SELECT *, CASE WHEN n + d > 0 AND spread THEN 1 ELSE 0 END AS o FROM (SELECT doc_id, len(f) AS n, {Q.summed('f')} AS s, d, spread FROM (SELECT doc_id, {Q.scored_hits(_INJ)} AS f, CASE WHEN (contains(t, '```') OR contains(t, '---') OR contains(t, '===')) AND (contains(lower(t), 'ignore') OR contains(lower(t), 'system')) THEN 1 ELSE 0 END AS d, (length(t) - length(replace(t, chr(10), '')) > 10 OR (length(t) - length(replace(t, ' ', '')))::DOUBLE / strlen(t) > 0.5) AS spread FROM probed))))")

of_probed("toxicity_score", lambda t: {**{k: six(v) for k, v in S.toxicity_parts(t, severe=True).items()}, "score": six(F.greatest(*S.toxicity_parts(t).values()))}, "SELECT *, greatest(insult, threat, identity_hate) AS score FROM (SELECT doc_id, round(CASE WHEN i > 0 THEN least(0.9, 0.6 + i * 0.1) ELSE 0 END::DOUBLE, 6) AS insult, CASE WHEN th THEN 0.9 ELSE 0 END::DOUBLE AS threat, round(CASE WHEN h > 0 THEN least(0.95, 0.7 + h * 0.1) ELSE 0 END::DOUBLE, 6) AS identity_hate, CASE WHEN sv THEN 0.95 ELSE 0 END::DOUBLE AS severe_toxic FROM (SELECT doc_id, " + f"len({Q.hits(L.INSULTS)}) AS i, {Q.any_hit(L.THREATS)} AS th, len({Q.hits(L.HATE)}) AS h, {Q.any_hit(L.SEVERE)} AS sv FROM probed))")

_count = lambda ws: f"len(list_filter(w, lambda x: list_contains({Q.names(ws)}, x)))"
of_probed("sentiment", lambda t: {"kind": S.sentiment_of(t)[0], "confidence": six(S.sentiment_of(t)[1])}, f"SELECT doc_id, kind, round(CASE kind WHEN 'positive' THEN 0.7 + 0.3 * u / (u + d) WHEN 'negative' THEN 0.7 + 0.3 * d / (u + d) ELSE 0.6 END::DOUBLE, 6) AS confidence FROM (SELECT *, CASE WHEN u + d = 0 THEN 'neutral' WHEN u::DOUBLE / (u + d) > 0.6 THEN 'positive' WHEN d::DOUBLE / (u + d) > 0.6 THEN 'negative' ELSE 'neutral' END AS kind FROM (SELECT doc_id, CASE WHEN x > 0 THEN n ELSE p END AS u, CASE WHEN x > 0 THEN p ELSE n END AS d FROM (SELECT doc_id, {_count(L.POSITIVE)} AS p, {_count(L.NEGATIVE)} AS n, {_count(L.NEGATIONS)} AS x FROM (SELECT doc_id, {Q.words('lower(t)')} AS w FROM probed))))")

of_probed("no_refusal", lambda t: pick(S.refusal_hits(t, "strict"), n=lambda f: big(F.size(f)), score=lambda f: six(S.peak(f))), f"SELECT doc_id, len(f) + a AS n, round(greatest({Q.peak('f')}, a * 0.7::DOUBLE), 6) AS score FROM (SELECT doc_id, list_concat(list_concat({Q.scored_hits(L.REFUSAL_DIRECT)}, CASE WHEN {Q.any_hit(L.REFUSAL_CUES)} THEN {Q.scored_hits(L.REFUSAL_SAFETY)} ELSE [] END), {Q.scored_hits(L.REFUSAL_CAPABILITY)}) AS f, CASE WHEN {Q.any_hit(['sorry', 'apologize'])} AND {Q.any_hit(['cannot', chr(99) + 'an' + chr(39) + 't', 'unable'])} THEN 1 ELSE 0 END AS a FROM probed)")


_KEY = "list_distinct(list_filter(list_transform(string_split_regex(lower({0}), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: strlen(w) >= 3 AND NOT list_contains(" + Q.names(L.STOP_WORDS) + ", w)))"


@query("relevance_jaccard", f"SELECT conv_id, turn, round(CASE WHEN g THEN s * 0.5 ELSE s END, 6) AS score, g AS generic FROM (SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.5 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS s, CASE WHEN len({Q.words('t')}) < 10 AND k = 0 THEN 0.6 ELSE k END > 0.7 AS g FROM (SELECT y.conv_id, y.turn, y.text AS t, {_KEY.format('x.text')} AS a, {_KEY.format('y.text')} AS b, {Q.peak(Q.scored_hits(L.GENERIC, 'lower(y.text)'))} AS k FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND y.role = 'assistant'))")
def relevance_jaccard(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    met = talk.where("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"])
    score, generic = S.relevance_score(F.col("prompt"), F.col("text"))
    return met.select("conv_id", "turn", F.round(score, 6).alias("score"), generic.alias("generic"))


of_probed("ban_topics_density", lambda t: {k: six(v) for k, v in S.topic_scores(t).items()}, "SELECT doc_id, " + ", ".join(f"round(least(1.0, len({Q.matches(any_of(ws), 'lower(t)')})::DOUBLE / greatest(len({Q.words()}), 1) * 10), 6) AS {k}" for k, ws in L.TOPICS.items()) + " FROM probed")


@query("bias_by_type", Q.over_probed("SELECT kind, count(*) AS n, round(max(c), 6) AS peak FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest({Q.scored_hits(v)}).c AS c FROM probed" for k, v in L.BIAS.items()) + ") GROUP BY kind"))
def bias_by_type(spark, sf_dir):
    rows = probed(spark, sf_dir).select(F.explode(S.bias_hits(F.col("t"), tuple(L.BIAS))).alias("x"))
    return rows.groupBy(F.col("x.type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.max("x.c"), 6).alias("peak"))


def _url_sql(u: str) -> str:
    low = f"lower({u})"
    ends = " OR ".join(f"ends_with({low}, '{e}')" for e in L.DANGEROUS_ENDINGS)
    return f"greatest(CASE WHEN {Q.any_hit(L.SUSPICIOUS_TLDS, low)} THEN 0.75 ELSE 0 END, CASE WHEN regexp_matches({low}, 'https?://(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') THEN 0.8 ELSE 0 END, CASE WHEN length({u}) - length(replace({u}, '%', '')) > 5 THEN 0.7 ELSE 0 END, CASE WHEN contains({low}, 'xn--') THEN 0.75 ELSE 0 END, CASE WHEN contains({u}, '@') THEN 0.85 ELSE 0 END, CASE WHEN len({Q.hits(L.PHISHING, low)}) >= 2 THEN 0.8 ELSE 0 END, CASE WHEN length({u}) - length(replace({u}, '.', '')) > 5 THEN 0.7 ELSE 0 END, CASE WHEN {ends} THEN 0.85 ELSE 0 END, CASE WHEN {Q.any_hit(L.SHORTENERS, low)} THEN 0.6 ELSE 0 END)::DOUBLE"


@query("malicious_urls", f"SELECT page_id, u AS url, {_url_sql('u')} AS risk FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/login/verify.exe' WHEN 2 THEN '?to=a@bit.ly' ELSE '.com' END AS u FROM pages UNION ALL SELECT page_id, unnest({Q.matches(L.URL, 'html')}) FROM pages)")
def malicious_urls(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    end = F.element_at(F.array(*map(F.lit, ["", "/login/verify.exe", "?to=a@bit.ly", ".com"])), (F.col("page_id") % 4 + 1).cast("int"))
    urls = pages.select("page_id", F.concat("url", end).alias("url")).unionByName(pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(L.URL), F.lit(0))).alias("url")))
    return urls.select("page_id", "url", S.url_risk(F.col("url")).alias("risk"))


@query("url_reachability", "SELECT page_id, len(u) AS urls, len(list_filter(u, lambda x: regexp_matches(x, '^https?://[^/?#]+'))) AS well_formed FROM (SELECT page_id, list_slice(regexp_extract_all(html || ' ' || url, 'https?://[^\\s<>\"]+'), 1, 10) AS u FROM pages)")
def url_reachability(spark, sf_dir):
    found = S.url_hosts(F.concat("html", F.lit(" "), "url"))
    return table(spark, sf_dir, "pages").select("page_id", big(F.size(found)).alias("urls"), big(F.size(F.filter(found, lambda u: u["well_formed"]))).alias("well_formed"))


of_probed("reading_time", lambda t: pick(S.reading_time(t), seconds=lambda r: big(r["metadata"]["seconds"]), is_valid=lambda r: r["is_valid"], risk=lambda r: r["risk_score"]), f"SELECT doc_id, s AS seconds, s BETWEEN 5 AND 300 AS is_valid, CASE WHEN s < 5 THEN 0.7 WHEN s > 300 THEN 0.8 ELSE 0 END::DOUBLE AS risk FROM (SELECT doc_id, trunc(len({Q.words()}) / 200.0::DOUBLE * 60)::BIGINT AS s FROM probed)")

_FACT = L.HEDGING + L.SPECULATION + L.UNCERTAINTY
of_probed("factuality_score", lambda t: {"score": F.round(S.factuality_score(t), 6)}, f"SELECT doc_id, round(greatest(0.0, 1 - coalesce(list_sum(list_transform(range(len(f)), lambda i: f[i + 1].c * pow(0.8, i))), 0))::DOUBLE, 6) AS score FROM (SELECT doc_id, {Q.scored_hits(_FACT)} AS f FROM probed)")

_DENY = [("secret|password", "high"), ("bomb", "critical"), ("learn", "low")]
_any = "regexp_matches(t, '(?i)(secret|password|bomb|learn)')"
of_probed("regex_output_deny", lambda t: pick(S.regex_output(t, _DENY), is_valid=lambda r: r["is_valid"], risk=lambda r: r["risk_score"]), f"SELECT doc_id, NOT {_any} AS is_valid, CASE WHEN {_any} THEN 0.9 ELSE 0 END::DOUBLE AS risk FROM probed")
of_probed("regex_output_allow", lambda t: pick(S.regex_output(t, _DENY, deny=False), is_valid=lambda r: r["is_valid"], risk=lambda r: r["risk_score"]), f"SELECT doc_id, {_any} AS is_valid, CASE WHEN {_any} THEN 0 ELSE 0.8 END::DOUBLE AS risk FROM probed")

of_probed("pii_mask", lambda t: {"masked": F.regexp_replace(t, ascii_bounds(r"\b([A-Za-z0-9]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"), "$1***@$2")}, "SELECT doc_id, regexp_replace(t, '\\b([A-Za-z0-9]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', '\\1***@\\2', 'g') AS masked FROM probed")
