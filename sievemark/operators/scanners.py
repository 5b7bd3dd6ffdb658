"""Scanners: each makes a result struct from a text column, and nothing but built-in functions runs per row.

Every function takes the text (output scanners that need it also the prompt) and its settings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.spans import first_wins, splice, surest_wins
from sievemark.functions.text import SPANS, any_of, ascii_bounds, count_class, count_of, entropy, factor, graded, has_any, hits, ipv4, let, luhn, pairs, regex_spans, result, scored_hits, strings, total, words

EDGE = r"[\p{L}\p{N}]"


def _phrase_spans(found: Column, text: Column, kind: str) -> Column:
    """Hits that stand for the whole text."""
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("entity_type"), x["p"].alias("text"), F.lit(0).alias("start"), F.octet_length(text).alias("end"), x["c"].alias("confidence")))


def peak(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda x: x["c"])), F.lit(0.0))


# Input scanners


def ban_substrings(text: Column, substrings: list[str], case_sensitive: bool = False, whole_words: bool = False, redact: bool = False) -> Column:
    if not substrings:
        raise ValueError("no substrings")
    pattern = f"(?:{any_of(substrings)})"
    if whole_words:
        pattern = f"(?<!{EDGE}){pattern}(?!{EDGE})"
    if not case_sensitive:
        pattern = f"(?iu){pattern}"
    def made(found: Column) -> Column:
        valid = F.size(found) == 0
        masked = splice(text, found, lambda s, i: F.repeat(F.lit("*"), s["end"] - s["start"])) if redact else text
        meta = {"matches_count": F.size(found), "patterns_matched": F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: F.lower(s["text"])))), ",")}
        return result("BanSubstrings", text, valid, F.when(valid, 0.0).otherwise(1.0), masked, found, factor("banned_content", "Banned substrings", F.lit("high"), F.lit(1.0)), meta)

    return let(regex_spans(text, pattern, "banned_substring"), made)


def ban_competitors(text: Column, names: list[str], redact: bool = True, whole_words: bool = True) -> Column:
    if not names:
        raise ValueError("no competitors")
    pattern = f"(?:{any_of(names)})"
    pattern = f"(?iu)(?<!{EDGE}){pattern}(?!{EDGE})" if whole_words else f"(?iu){pattern}"
    def made(found: Column) -> Column:
        valid = F.size(found) == 0
        masked = F.regexp_replace(text, pattern, "[COMPETITOR]") if redact else text
        return result("BanCompetitors", text, valid, F.when(valid, 0.0).otherwise(1.0), masked, found, factor("competitor_mention", "Competitors", F.lit("high"), F.lit(1.0)), {"matches_count": F.size(found)})

    return let(regex_spans(text, pattern, "competitor_mention"), made)


def code_spans(text: Column) -> Column:
    lowered = F.lower(text)
    parts = [regex_spans(text, p, kind, c) for kind, p, c in L.CODE_PATTERNS]
    before = lambda k: F.octet_length(F.call_function("substring_index", lowered, k, F.lit(1)))
    keywords = F.transform(hits(lowered, L.CODE_KEYWORDS), lambda k: F.struct(F.lit("keyword").alias("entity_type"), k.alias("text"), before(k).alias("start"), (before(k) + F.octet_length(k)).alias("end"), F.lit(0.7).alias("confidence")))
    return first_wins(F.concat(*parts, keywords.cast(SPANS)))


def ban_code(text: Column, threshold: float = 0.5, redact: bool = False) -> Column:
    def made(found: Column) -> Column:
        covered = total(F.transform(found, lambda s: (s["end"] - s["start"]).cast("double")))
        density = F.coalesce(F.try_divide(covered, F.octet_length(text)), F.lit(0.0))
        sure = F.coalesce(F.try_divide(total(F.transform(found, lambda s: s["confidence"])), F.size(found)), F.lit(0.0))
        risk = F.when(F.size(found) == 0, 0.0).otherwise(F.least(F.lit(1.0), density * 0.6 + sure * 0.4))
        masked = splice(text, found, lambda s, i: F.lit("[REDACTED CODE]")) if redact else text
        valid = risk < threshold
        return result("BanCode", text, valid, F.when(valid, 0.0).otherwise(risk), F.when(valid, text).otherwise(masked), found, factor("code_detected", "Code", graded(risk, (0.8, "high"), (0.5, "medium")), risk), {"blocks": F.size(found)})

    return let(code_spans(text), made)


def token_limit(text: Column, limit: int = 4096) -> Column:
    if limit <= 0:
        raise ValueError("limit must be positive")
    n = F.ceil(F.octet_length(text) / 4)
    valid = n <= limit
    risk = F.when(valid, 0.0).otherwise(F.least(F.lit(1.0), n / limit))
    return result("TokenLimit", text, valid, risk, None, None, factor("token_limit_exceeded", "Too many tokens", F.lit("medium"), risk), {"token_count": n, "limit": F.lit(limit), "overflow": F.greatest(n - limit, F.lit(0))})


ZERO_WIDTH = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in L.ZERO_WIDTH) + "]"
DIRECTION = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in L.DIRECTIONS) + "]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


def invisible_text(text: Column, threshold: float = 0.1, remove: bool = True) -> Column:
    def made(found: Column) -> Column:
        n = F.size(found)
        sure = F.coalesce(F.try_divide(total(F.transform(found, lambda s: s["confidence"])), n), F.lit(0.0))
        risk = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(n, F.octet_length(text)), F.lit(0.0)) * 0.7 + sure * 0.3))
        names = F.create_map(*(F.lit(x) for kv in {**L.ZERO_WIDTH, **L.DIRECTIONS}.items() for x in kv))
        named = F.transform(found, lambda s: s.withField("text", F.concat(F.lit("["), F.coalesce(F.element_at(names, s["text"]), F.concat(F.lit("U+"), F.lpad(F.hex(F.unhex(F.hex(F.encode(s["text"], "UTF-16BE")))), 4, "0"))), F.lit("]"))))
        clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), CONTROL, ""), DIRECTION, "") if remove else text
        valid = risk < threshold
        return result("InvisibleText", text, valid, risk, clean, named, factor("invisible_text", "Invisible characters", graded(risk, (0.7, "high"), (0.4, "medium")), risk), {"count": n})

    return let(F.concat(regex_spans(text, ZERO_WIDTH, "zero_width", 1.0), regex_spans(text, CONTROL, "control", 0.9), regex_spans(text, DIRECTION, "direction", 0.7)), made)


def regex_scan(text: Column, patterns: list[tuple[str, str, float]], redact: bool = False) -> Column:
    """patterns: (name, pattern, risk)."""
    if not patterns:
        raise ValueError("no patterns")
    def made(found: Column) -> Column:
        risk = F.coalesce(F.array_max(F.transform(found, lambda s: s["confidence"])), F.lit(0.0))
        valid = F.size(found) == 0
        masked = splice(text, first_wins(found), lambda s, i: F.repeat(F.lit("*"), s["end"] - s["start"])) if redact else text
        return result("Regex", text, valid, risk, masked, found, factor("regex_match", "Patterns", graded(risk, (0.7, "high"), other="medium"), risk), {"matches": F.size(found)})

    return let(F.concat(*(regex_spans(text, p, name, risk) for name, p, risk in patterns)), made)


def gibberish_parts(text: Column) -> dict[str, Column]:
    """Scores (entropy, repetition, vowels, keyboard, words) of a text, each 0 to 1."""
    lowered, size = F.lower(text), F.octet_length(text)
    alpha = F.regexp_replace(lowered, r"[^\p{L}]+", "")
    even = F.least(F.lit(1.0), entropy(alpha, F.length(alpha)) / 4.7)
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{2,}"), F.lit(0))
    repeated = total(F.transform(runs, lambda r: (F.length(r) - 2) * (F.length(r) - 1) / 2 * 0.2))
    vowels = F.length(F.regexp_replace(alpha, "[^aeiou]", ""))
    ratio = F.try_divide(vowels, F.length(alpha))
    tokens = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", ""))
    odd = F.filter(tokens, lambda w: (F.octet_length(w) >= 2) & (F.rlike(w, F.lit("[^aeiou]{5,}")) | (F.octet_length(w) > 3) & ~F.rlike(w, F.lit("[aeiou]"))))
    return {
        "entropy": F.when(even > 0.85, (even - 0.85) / 0.15).otherwise(0.0),
        "repetition": F.least(F.lit(1.0), F.coalesce(F.try_divide(repeated, size), F.lit(0.0))),
        "vowels": F.when((ratio < 0.15) | (ratio > 0.6), F.least(F.lit(1.0), F.abs(ratio - 0.4) / 0.4)).otherwise(0.0),
        "keyboard": F.least(F.lit(1.0), F.size(hits(lowered, L.KEYBOARD)) / 5),
        "words": F.coalesce(F.try_divide(F.size(odd), F.size(tokens)), F.lit(0.0)),
    }


GIBBERISH_WEIGHTS = {"entropy": 2.0, "repetition": 1.5, "vowels": 1.5, "keyboard": 2.0, "words": 1.5}


def gibberish(text: Column, threshold: float = 0.7) -> Column:
    return let(F.struct(*(v.alias(k) for k, v in gibberish_parts(text).items())), lambda p: _gibberish(text, {k: p[k] for k in GIBBERISH_WEIGHTS}, threshold))


def _gibberish(text: Column, parts: dict[str, Column], threshold: float) -> Column:
    score = sum((parts[k] * w for k, w in GIBBERISH_WEIGHTS.items()), F.lit(0.0)) / sum(GIBBERISH_WEIGHTS.values())
    score = F.when(F.octet_length(text) < 10, 0.0).otherwise(score)
    valid = score < threshold
    return result("Gibberish", text, valid, score, None, None, factor("gibberish", "Gibberish", graded(score, (0.8, "high"), (0.6, "medium")), score), {k: F.when(v > 0.1, F.round(v, 6)).otherwise(F.lit(None)) for k, v in parts.items()})


SCRIPTS = {"latin": "[A-Za-zÀ-ÖØ-öø-ÿ]", "ru": "[А-яЁё]", "ar": r"[\x{600}-\x{6FF}&&\p{L}]", "zh": r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}&&\p{L}]", "hi": r"[\x{900}-\x{97F}&&\p{L}]"}


def detect_language(text: Column) -> tuple[Column, Column]:
    """(code, confidence) by script, and for Latin script by common words."""
    letters = count_class(text, r"\p{L}")
    n = {k: count_class(text, p) for k, p in SCRIPTS.items()}
    half, third = F.floor(letters / 2), F.floor(letters / 3)
    lowered = F.lower(text)
    counts = {k: F.size(hits(lowered, v)) for k, v in L.LATIN_WORDS.items()}
    most = F.greatest(*counts.values())
    latin = F.when(most < 2, "en")
    for k, v in counts.items():
        latin = latin.when(v == most, k)
    code = F.when(letters == 0, "unknown").when(n["ru"] > half, "ru").when(n["ar"] > half, "ar").when(n["zh"] > third, "zh").when(n["hi"] > half, "hi").when(n["latin"] > half, latin).otherwise("unknown")
    share = {k: F.try_divide(v, letters) for k, v in n.items()}
    sure = F.when(letters == 0, 0.0).when(n["ru"] > half, share["ru"]).when(n["ar"] > half, share["ar"]).when(n["zh"] > third, share["zh"]).when(n["hi"] > half, share["hi"]).when(n["latin"] > half, share["latin"]).otherwise(0.3)
    return code, sure.cast("double")


def language(text: Column, allowed: tuple[str, ...] = ("en",), blocked: tuple[str, ...] = (), least: float = 0.7, min_length: int = 10) -> Column:
    code, sure = detect_language(text)
    short, unsure = F.octet_length(text) < min_length, sure < least
    bad = code.isin(*blocked) if blocked else F.lit(False)
    if allowed:
        bad = bad | ~code.isin(*allowed)
    valid = short | unsure | ~bad
    risk = F.when(short, 0.0).when(unsure, sure * 0.5).when(bad, 1.0).otherwise(0.0)
    return result("Language", text, valid, risk, None, None, factor("language_not_allowed", "Language", F.lit("high"), risk), {"language": F.when(short | unsure, "unknown").otherwise(code), "confidence": F.round(sure, 6)})


def secret_spans(text: Column, least_entropy: float = 3.0) -> Column:
    """Credentials by shape; tokens that are only long must also have enough entropy."""
    parts = [regex_spans(text, p, kind, 0.95) for kind, p in L.SECRETS[:-1]]
    generic = F.filter(regex_spans(text, L.SECRETS[-1][1], L.SECRETS[-1][0], 0.8), lambda s: entropy(s["text"], F.length(s["text"])) >= least_entropy)
    return surest_wins(F.concat(*parts, generic))


def secrets(text: Column, least_entropy: float = 3.0) -> Column:
    def made(found: Column) -> Column:
        valid = F.size(found) == 0
        return result("Secrets", text, valid, F.when(valid, 0.0).otherwise(1.0), splice(text, found, lambda s, i: F.lit("[REDACTED]")), found, factor("secret", "Secrets", F.lit("critical"), F.lit(1.0)), {"types": F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["entity_type"]))), ",")})

    return let(secret_spans(text, least_entropy), made)


def injection_hits(text: Column) -> Column:
    """(p, c) of the signs found, in the order in which they are looked for."""
    lowered = F.lower(text)
    phrases = [(p, 0.95) for p in L.OVERRIDE] + [(p, 0.8) for p in L.ROLEPLAY] + [(p, 0.75) for p in L.CONTEXT] + [(p, 0.9) for p in L.EXTRACTION]
    fenced = has_any(text, ["```", "---", "==="]) & has_any(lowered, ["ignore", "system"])
    found = F.concat(scored_hits(lowered, phrases), F.when(fenced, pairs([("delimiter_attack", 0.7)])).otherwise(pairs([]).cast("array<struct<p:string,c:double>>")))
    spread = (count_of(text, "\n") > 10) | (F.coalesce(F.try_divide(count_of(text, " "), F.octet_length(text)), F.lit(0.0)) > 0.5)
    return F.when(spread & (F.size(found) > 0), F.concat(found, pairs([("obfuscation", 0.6)]))).otherwise(found)


def prompt_injection(text: Column, threshold: float = 0.7) -> Column:
    def made(found: Column) -> Column:
        score = F.least(F.lit(1.0), F.coalesce(F.try_divide(total(F.transform(found, lambda x: x["c"])), F.size(found)), F.lit(0.0)))
        valid = score < threshold
        return result("PromptInjection", text, valid, score, None, _phrase_spans(found, text, "prompt_injection"), factor("prompt_injection", "Injection", graded(score, (0.9, "critical"), (0.7, "high"), other="medium"), score), {"indicators": F.size(found)})

    return let(injection_hits(text), made)


def toxicity_parts(text: Column, severe: bool = False) -> dict[str, Column]:
    """Scores by category. severe: also the list that has lost its asterisks and is in most ordinary text."""
    lowered = F.lower(text)
    insults, hate = F.size(hits(lowered, L.INSULTS)), F.size(hits(lowered, L.HATE))
    out = {
        "insult": F.when(insults > 0, F.least(F.lit(0.9), insults * 0.1 + 0.6)).otherwise(0.0),
        "threat": F.when(has_any(lowered, L.THREATS), 0.9).otherwise(0.0),
        "identity_hate": F.when(hate > 0, F.least(F.lit(0.95), hate * 0.1 + 0.7)).otherwise(0.0),
    }
    if severe:
        out["severe_toxic"] = F.when(has_any(lowered, L.SEVERE), 0.95).otherwise(0.0)
    return out


def toxicity(text: Column, threshold: float = 0.7, severe: bool = False) -> Column:
    parts = toxicity_parts(text, severe)
    score = F.greatest(*parts.values())
    valid = F.round(score, 6) < threshold
    return result("Toxicity", text, valid, score, None, None, factor("toxicity", "Toxic language", graded(score, (0.9, "critical"), (0.7, "high"), other="medium"), score), parts)


def sentiment_of(text: Column) -> tuple[Column, Column]:
    tokens = words(F.lower(text))
    among = lambda listed: F.size(F.filter(tokens, lambda w: F.array_contains(strings(listed), w)))
    n = {"up": among(L.POSITIVE), "down": among(L.NEGATIVE), "not": among(L.NEGATIONS)}
    up, down = F.when(n["not"] > 0, n["down"]).otherwise(n["up"]), F.when(n["not"] > 0, n["up"]).otherwise(n["down"])
    good = F.coalesce(F.try_divide(up, up + down), F.lit(0.0))
    bad = F.coalesce(F.try_divide(down, up + down), F.lit(0.0))
    kind = F.when(up + down == 0, "neutral").when(good > 0.6, "positive").when(bad > 0.6, "negative").otherwise("neutral")
    sure = F.when(kind == "positive", good * 0.3 + 0.7).when(kind == "negative", bad * 0.3 + 0.7).otherwise(0.6)
    return kind, sure


def sentiment(text: Column, allowed: tuple[str, ...] = ("positive", "neutral")) -> Column:
    kind, sure = sentiment_of(text)
    valid = kind.isin(*allowed)
    risk = F.when(valid, 0.0).otherwise(sure)
    return result("Sentiment", text, valid, risk, None, None, factor("sentiment", kind, F.lit("medium"), risk), {"sentiment": kind, "confidence": F.round(sure, 6)})


# Output scanners


def refusal_hits(text: Column, sensitivity: str = "medium") -> Column:
    lowered = F.lower(text)
    none = pairs([]).cast("array<struct<p:string,c:double>>")
    parts = [scored_hits(lowered, L.REFUSAL_DIRECT), F.when(has_any(lowered, L.REFUSAL_CUES), scored_hits(lowered, L.REFUSAL_SAFETY)).otherwise(none)]
    if sensitivity != "loose":
        parts.append(scored_hits(lowered, L.REFUSAL_CAPABILITY))
    if sensitivity == "strict":
        sorry = has_any(lowered, ["sorry", "apologize"]) & has_any(lowered, ["cannot", "can't", "unable"])
        parts.append(F.when(sorry, pairs([("apology_refusal", 0.7)])).otherwise(none))
    return F.concat(*parts)


def no_refusal(text: Column, threshold: float = 0.7, sensitivity: str = "medium") -> Column:
    def made(found: Column) -> Column:
        score = peak(found)
        valid = score < threshold
        return result("NoRefusal", text, valid, score, None, _phrase_spans(found, text, "refusal"), factor("refusal", "Refusal", graded(score, (0.9, "high"), (0.7, "medium")), score), {"matches": F.size(found)})

    return let(refusal_hits(text, sensitivity), made)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three bytes or more that say something."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(strings(L.STOP_WORDS), w)))


def relevance_score(prompt: Column, text: Column) -> tuple[Column, Column]:
    """(score, whether the answer is generic)."""
    a, b = keywords(prompt), keywords(text)
    jaccard = F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    base = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(jaccard)
    best = peak(scored_hits(F.lower(text), L.GENERIC))
    generic = F.when((F.size(words(text)) < 10) & (best == 0), 0.6).otherwise(best) > 0.7
    return F.when(generic, base * 0.5).otherwise(base), generic


def relevance(prompt: Column, text: Column, threshold: float = 0.5) -> Column:
    score, generic = relevance_score(prompt, text)
    valid = (score >= threshold) & ~generic
    level = F.when((score < 0.2) | generic, "high").when(score < 0.4, "medium").otherwise("low")
    return result("Relevance", text, valid, 1 - score, None, None, factor("irrelevant", "Relevance", level, 1 - score), {"score": F.round(score, 6), "generic": generic})


def pii_needs(text: Column, kind: str) -> Column | None:
    """What a text must have for a match of a PII pattern."""
    low = kind.lower()
    if low == "email":
        return F.contains(text, F.lit("@"))
    if low == "url":
        return F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))
    digits = {"phone": 3, "credit_card": 4, "ssn": 4, "ip_address": 1, "date_of_birth": 4, "bank_account": 8, "driver_license": 7, "passport": 7, "medical_record": 6, "postal_code": 5, "address": 1}
    return F.rlike(text, F.lit(f"[0-9]{{{digits[low]}}}")) if low in digits else None


def pii_spans(text: Column, types: list[str] | None = None) -> Column:
    """PII by type, in the order of types; numbers are validated. Overlaps are not resolved."""
    kept = {"credit_card": lambda s: luhn(s["text"]), "ip_address": lambda s: ipv4(s["text"])}
    parts = []
    for kind, pattern, confidence in L.SENSITIVE:
        if kind in (types or L.SENSITIVE_DEFAULT):
            spans = regex_spans(text, pattern, kind, confidence, pii_needs(text, kind))
            parts.append(F.filter(spans, kept[kind]) if kind in kept else spans)
    return F.concat(*parts)


def sensitive(text: Column, types: list[str] | None = None, redact: bool = False) -> Column:
    def made(found: Column) -> Column:
        none = F.size(found) == 0
        if redact:
            return result("Sensitive", text, F.lit(True), F.when(none, 0.0).otherwise(0.9), splice(text, first_wins(found), lambda s, i: F.lit("[REDACTED]")), found, None, {"count": F.size(found)})
        grave = F.exists(found, lambda s: s["entity_type"].isin("credit_card", "ssn"))
        level = F.when(grave | (F.size(found) > 3), "high").when(F.size(found) > 1, "medium").otherwise("low")
        return result("Sensitive", text, none, F.when(none, 0.0).otherwise(0.9), None, found, factor("sensitive_data", "PII", level, F.lit(0.9)), {"count": F.size(found)})

    return let(pii_spans(text, types), made)


def topic_scores(text: Column, topics: dict[str, list[str]] | None = None) -> dict[str, Column]:
    lowered, n = F.lower(text), F.greatest(F.size(words(text)), F.lit(1))
    return {name: F.least(F.lit(1.0), F.regexp_count(lowered, F.lit(any_of(ws))) / n * 10) for name, ws in (topics or L.TOPICS).items()}


def ban_topics(text: Column, topics: dict[str, list[str]] | None = None, threshold: float = 0.6) -> Column:
    scores = topic_scores(text, topics)
    risk = F.greatest(*scores.values(), F.lit(0.0))
    valid = risk < threshold
    return result("BanTopics", text, valid, risk, None, None, factor("banned_topic", "Topics", F.lit("high"), risk), {k: F.round(v, 6) for k, v in scores.items()})


def bias_hits(text: Column, types: tuple[str, ...] = ("gender", "racial", "age", "religious")) -> Column:
    """(type, p, c) of the phrases found."""
    rows = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(p).alias("p"), F.lit(float(c)).alias("c")) for t in types for p, c in L.BIAS[t]))
    return let(F.lower(text), lambda low: F.filter(rows, lambda x: F.contains(low, x["p"])))


def bias(text: Column, types: tuple[str, ...] = ("gender", "racial", "age", "religious"), threshold: float = 0.6) -> Column:
    def made(found: Column) -> Column:
        score = peak(found)
        valid = score < threshold
        spans = F.transform(found, lambda x: F.struct(F.concat(x["type"], F.lit("_bias")).alias("entity_type"), x["p"].alias("text"), F.lit(0).alias("start"), F.octet_length(text).alias("end"), x["c"].alias("confidence")))
        return result("Bias", text, valid, score, None, spans, factor("bias", "Bias", graded(score, (0.85, "high"), (0.7, "medium")), score), {"matches": F.size(found)})

    return let(bias_hits(text, types), made)


def url_risk(url: Column, blocked: tuple[str, ...] = ()) -> Column:
    low = F.lower(url)
    ends = F.lit(False)
    for e in L.DANGEROUS_ENDINGS:
        ends = ends | F.endswith(low, F.lit(e))
    checks = [
        (has_any(low, L.SUSPICIOUS_TLDS), 0.75),
        (F.rlike(low, F.lit(r"https?://(?:[0-9]{1,3}\.){3}[0-9]{1,3}")), 0.80),
        (count_of(url, "%") > 5, 0.70),
        (F.contains(low, F.lit("xn--")), 0.75),
        (F.contains(url, F.lit("@")), 0.85),
        (F.size(hits(low, L.PHISHING)) >= 2, 0.80),
        (count_of(low, ".") > 5, 0.70),
        (ends, 0.85),
        (has_any(low, L.SHORTENERS), 0.60),
    ]
    if blocked:
        checks.append((has_any(low, [b.lower() for b in blocked]), 0.95))
    return F.greatest(*(F.when(test, c).otherwise(0.0) for test, c in checks))


def url_threats(text: Column, threshold: float = 0.6, blocked: tuple[str, ...] = ()) -> Column:
    spans = F.transform(regex_spans(text, L.URL, "malicious_url"), lambda s: s.withField("confidence", url_risk(s["text"], blocked)))
    return F.filter(spans, lambda s: s["confidence"] >= threshold)


def malicious_urls(text: Column, threshold: float = 0.6, blocked: tuple[str, ...] = ()) -> Column:
    def made(found: Column) -> Column:
        score = F.coalesce(F.array_max(F.transform(found, lambda s: s["confidence"])), F.lit(0.0))
        valid = F.size(found) == 0
        return result("MaliciousURLs", text, valid, score, None, found, factor("malicious_url", "URLs", graded(score, (0.85, "high"), (0.7, "medium")), score), {"urls": F.size(found)})

    return let(url_threats(text, threshold, blocked), made)


def reading_seconds(text: Column, wpm: float = 200.0) -> Column:
    return (F.size(words(text)) / wpm * 60).cast("int")


def reading_time(text: Column, least: int = 5, most: int = 300, wpm: float = 200.0) -> Column:
    if most <= least or wpm <= 0:
        raise ValueError("most must exceed least and wpm be positive")
    def made(seconds: Column) -> Column:
        short, long = seconds < least, seconds > most
        risk = F.when(short, 0.7).when(long, 0.8).otherwise(0.0)
        marks = F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1))
        return result("ReadingTime", text, ~(short | long), risk, None, None, factor("reading_time", "Reading time", F.when(short, "low").otherwise("medium"), risk), {"seconds": seconds, "sentences": marks, "characters": F.length(F.regexp_replace(text, r"\s", ""))})

    return let(reading_seconds(text, wpm), made)


def factuality_score(text: Column) -> Column:
    """1 less the penalties, each weighing 0.8 of the one before."""
    found = scored_hits(F.lower(text), L.HEDGING + L.SPECULATION + L.UNCERTAINTY)
    weighed = F.transform(found, lambda x, i: x["c"] * F.pow(F.lit(0.8), i))
    return F.greatest(F.lit(0.0), 1 - total(weighed))


def factuality(text: Column, threshold: float = 0.5) -> Column:
    def made(score: Column) -> Column:
        valid = score >= threshold
        level = F.when(score < 0.3, "high").when(score < 0.5, "medium").otherwise("low")
        return result("Factuality", text, valid, 1 - score, None, None, factor("low_confidence", "Hedging", level, 1 - score), {"score": F.round(score, 6)})

    return let(factuality_score(text), made)


def url_hosts(text: Column, most: int = 10) -> Column:
    """(url, whether it has a host) of the first URLs; nothing is fetched."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit(L.HTTP_URL), F.lit(0)), 1, most), lambda u: F.struct(u.alias("url"), F.try_parse_url(u, F.lit("HOST")).isNotNull().alias("well_formed")))


def url_reachability(text: Column, most: int = 10) -> Column:
    def made(found: Column) -> Column:
        bad = F.size(F.filter(found, lambda u: ~u["well_formed"]))
        risk = F.coalesce(F.try_divide(bad, F.size(found)), F.lit(0.0))
        level = F.when(risk >= 1, "high").when(risk > 0.5, "medium").otherwise("low")
        return result("URLReachability", text, bad == 0, risk, None, None, factor("unreachable_url", "URLs", level, risk), {"urls": F.size(found), "unreachable": bad})

    return let(url_hosts(text, most), made)


def regex_output(text: Column, patterns: list[tuple[str, str]], deny: bool = True) -> Column:
    """Deny: any pattern makes the text invalid. Allow: none does."""
    any_match = F.lit(False)
    for p, _ in patterns:
        any_match = any_match | F.rlike(text, F.lit(f"(?i){ascii_bounds(p)}"))
    if deny:
        level = F.lit("low")
        for p, name in patterns:
            rank = {"low": 0, "medium": 1, "high": 2, "critical": 3}
            level = F.when(F.rlike(text, F.lit(f"(?i){ascii_bounds(p)}")) & (F.lit(rank[name]) > F.element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), level)), name).otherwise(level)
        return result("RegexOutput", text, ~any_match, F.when(any_match, 0.9).otherwise(0.0), None, None, factor("regex_deny", "Denied pattern", level, F.lit(0.9)))
    return result("RegexOutput", text, any_match, F.when(any_match, 0.0).otherwise(0.8), None, None, factor("regex_allow", "No allowed pattern", F.lit("medium"), F.lit(0.8)))


