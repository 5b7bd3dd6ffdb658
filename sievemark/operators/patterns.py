"""Pattern scanners of the client, the line scan of files, and the small checks of the core shield and the browser build.

Each is one expression over a text column. Entities are spans with byte offsets; factors carry a severity and a confidence, and
the risk of a result is the mean of severity weight times confidence, at most 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.text import SEVERITIES, SPANS, has_any, let, luhn, regex_spans, severity_rank, total
from sievemark.operators.scanners import pii_needs

_FACTORS = "array<struct<category:string,description:string,severity:string,confidence:double,n:int>>"


def _with_factors(text: Column, entities: Column, factors_of) -> Column:
    """struct(is_valid, risk_score, severity, entities, factors); factors_of(entities) may hold some of no matches, which go."""

    def made(found: Column) -> Column:
        def graded(factors: Column) -> Column:
            weight = total(F.transform(factors, lambda f: severity_rank(f["severity"]) * 0.25 * f["confidence"]))
            risk = F.least(F.lit(1.0), F.coalesce(F.try_divide(weight, F.size(factors)), F.lit(0.0)))
            worst = F.coalesce(F.array_max(F.transform(factors, lambda f: severity_rank(f["severity"]))), F.lit(0))
            names = F.array(*map(F.lit, SEVERITIES))
            return F.struct((F.size(factors) == 0).alias("is_valid"), risk.alias("risk_score"), F.get(names, worst).alias("severity"), found.cast(SPANS).alias("entities"), factors.cast(_FACTORS).alias("factors"))

        return let(F.filter(factors_of(found), lambda f: f["n"] > 0), graded)

    return let(entities, made)


def _factor(category: str, description: str, severity: str, confidence: Column, n: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(description).alias("description"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence"), n.alias("n"))


def mask(value: Column, kind: str) -> Column:
    """What is shown of personal data: an e-mail's first two characters and domain, the last four of a number, or nothing."""
    if kind == "email":
        return F.concat(F.substring(F.substring_index(value, "@", 1), 1, 2), F.lit("***@"), F.get(F.split(value, "@"), F.lit(1)))
    last = F.right(value, F.lit(4))
    return {"credit-card": F.concat(F.lit("****-****-****-"), last), "ssn": F.concat(F.lit("***-**-"), last), "phone": F.concat(F.lit("***-***-"), last)}.get(kind, F.lit("****"))


def _plausible(value: Column, kind: str) -> Column | None:
    number = F.regexp_replace(value, "[^0-9]", "")
    if kind == "credit-card":
        return luhn(number)
    if kind == "ssn":
        area = F.substring(number, 1, 3).try_cast("int")
        return F.coalesce((F.length(number) == 9) & (area != 0) & (area != 666) & (area < 900), F.lit(False))
    return None


def _needs(text: Column, name: str, kind: str) -> Column | None:
    if name == "International Phone Number":
        return F.contains(text, F.lit("+"))
    return pii_needs(text, {"credit-card": "credit_card", "drivers-license": "driver_license"}.get(kind, kind)) if kind != "ip-address" else None


def client_pii(text: Column, kinds: list[str] | None = None, redact: bool = True) -> Column:
    """Personal data by 15 patterns, numbers validated; entity_type is the pattern's type. redact: entities show masked text."""
    chosen = [p for p in L.CLIENT_PII if p[1] in (kinds or L.CLIENT_PII_DEFAULT)]
    parts = []
    for name, kind, _, pattern in chosen:
        spans = regex_spans(text, pattern, name, L.CLIENT_CONFIDENCE.get(kind, L.CLIENT_OTHER_CONFIDENCE), _needs(text, name, kind))
        if kind in ("credit-card", "ssn"):
            spans = F.filter(spans, lambda s: _plausible(s["text"], kind))
        parts.append(F.transform(spans, lambda s: s.withField("text", mask(s["text"], kind))) if redact else spans)

    def factors(found: Column) -> Column:
        return F.array(*(_factor("pii", f"Detected {name}", severity, F.lit(0.9), F.size(F.filter(found, lambda s: s["entity_type"] == name))) for name, _, severity, _ in chosen))

    return _with_factors(text, F.concat(*parts), factors)


def client_injection(text: Column, jailbreaks: bool = True, role_play: bool = True, custom: tuple[str, ...] = ()) -> Column:
    """Prompt injection by 25 patterns and custom ones; one factor, the surer the more matches."""
    chosen = [*L.INJECTION_PATTERNS, *(f"(?i:{p})" for p in custom)]
    if not jailbreaks:
        chosen = [p for p in chosen if "jailbreak" not in p and "DAN" not in p]
    if not role_play:
        chosen = [p for p in chosen if "pretend" not in p and "roleplay" not in p and r"act\s+as" not in p]
    entities = F.concat(*(regex_spans(text, p, "prompt_injection", 0.9) for p in chosen))
    return _with_factors(text, entities, lambda found: F.array(_factor("prompt-injection", "Detected prompt injection", "high", F.least(F.lit(0.9), F.size(found) * 0.1 + 0.5), F.size(found))))


def client_toxicity(text: Column, categories: list[str] | None = None, custom: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> Column:
    """Toxic words by category. custom words are profanity; a match that equals an allowed word does not count."""
    groups = [(c, severity, patterns) for c, (severity, patterns) in L.TOXIC_PATTERNS.items() if c in (categories or L.TOXIC_DEFAULT)]
    if custom:
        groups.append(("profanity", "medium", [r"(?i:\b(?:" + "|".join(map(re.escape, custom)) + r")\b)"]))
    parts = [regex_spans(text, p, f"toxicity:{c}", 0.8) for c, _, patterns in groups for p in patterns]
    entities = F.concat(*parts)
    if allowed:
        entities = F.filter(entities, lambda s: ~F.lower(s["text"]).isin(*(a.lower() for a in allowed)))
    first = {}
    for c, severity, _ in groups:
        first.setdefault(c, severity)

    def factors(found: Column) -> Column:
        out = []
        for c, severity in first.items():
            n = F.size(F.filter(found, lambda s: s["entity_type"] == f"toxicity:{c}"))
            out.append(_factor("toxicity", f"Detected {c} content", severity, F.least(F.lit(0.95), n * 0.05 + 0.6), n))
        return F.array(*out)

    return _with_factors(text, entities, factors)


def merged(text: Column, results: list[Column], sanitized: list[Column] | None = None) -> Column:
    """One result of several: valid without factors, the highest risk and severity, entities once per place and type, the last sanitized text that differs."""
    entities = F.flatten(F.array(*(r["entities"] for r in results)))

    def once(found: Column) -> Column:
        keys = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["end"], s["entity_type"]))
        return let(keys(found), lambda k: F.filter(found, lambda s, i: F.array_position(k, F.struct(s["start"], s["end"], s["entity_type"])) == i + 1))

    clean = text
    for s in sanitized or []:
        clean = F.when(s != text, s).otherwise(clean)
    rank = F.greatest(*(severity_rank(r["severity"]) for r in results), F.lit(0))
    return F.struct(
        F.forall(F.array(*(r["factors"] for r in results)), lambda f: F.size(f) == 0).alias("is_valid"),
        F.greatest(*(r["risk_score"] for r in results), F.lit(0.0)).alias("risk_score"),
        F.get(F.array(*map(F.lit, SEVERITIES)), rank).alias("severity"),
        clean.alias("sanitized_text"), let(entities, once).alias("entities"), F.flatten(F.array(*(r["factors"] for r in results))).alias("factors"),
    )


# Line scan


def secret_severity(kind: str) -> str:
    if "Private Key" in kind or "AWS" in kind:
        return "critical"
    return "high" if "API Key" in kind or "Token" in kind else "medium"


#: (category, type, severity, pattern, whether only a line's first match counts, characters of the match that are shown).
LINE_FAMILIES = [
    *(("prompt-injection", "Prompt Injection Attempt", "high", p, True, 50) for p in L.LINE_INJECTION),
    *(("secret", kind, secret_severity(kind), p, False, 20) for kind, p in L.SECRETS[:-1]),
    *(("pii", kind, severity, p, False, 4) for kind, severity, p in L.LINE_PII),
    *(("toxicity", "Potentially Toxic Content", "medium", p, True, 0) for p in L.LINE_TOXIC),
]


def within_lines(pattern: str) -> str:
    """The pattern with white space that ends at the line."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out, i = out + (r"\t\x0B\f\r " if inside and not negated else r"\s" if inside else r"[\t\x0B\f\r ]"), i + 2
        elif two.startswith("\\"):
            out, i = out + two, i + 2
        else:
            if pattern[i] == "[" and not inside:
                inside, negated = True, pattern[i + 1] == "^"
            elif pattern[i] == "]":
                inside = False
            out, i = out + pattern[i], i + 1
    return out


def line_findings(df: DataFrame, text: str = "text", categories: list[str] | None = None) -> DataFrame:
    """Findings of the line scan as rows: the other columns of df, line and column (from 1, characters), type, category, severity, match.

    Patterns run over whole texts, and places are counted for what they find. A line's first match of injection and toxicity stands
    where its words stand first in the line.
    """
    t = F.col(text)
    parts = []
    for category, kind, severity, pattern, first, shown in LINE_FAMILIES:
        if categories and category not in categories:
            continue
        needs = pii_needs(t, "email" if kind == "Email" else "ssn") if category == "pii" else None
        spans = regex_spans(t, within_lines(pattern), kind, 1.0, needs)

        def placed(s: Column) -> Column:
            before = F.decode(F.substring(F.encode(t, "UTF-8"), F.lit(1), s["start"]), "UTF-8")
            size = F.length(s["text"])
            text_of = s["text"] if not shown else F.concat(F.substring(s["text"], 1, shown), F.when(size > shown, "...").otherwise("") if first else F.lit("****"))
            return let(before, lambda b: F.struct((F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"), (F.length(F.substring_index(b, "\n", -1)) + 1).cast("long").alias("at"), s["entity_type"].alias("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), text_of.alias("match"), s["text"].alias("found"), F.lit(first).alias("first")))

        found = F.transform(spans, placed)
        if first:
            found = let(found, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["line"] != F.get(a, i - 1)["line"])))
        parts.append(found)
    rows = df.withColumn("_f", F.explode(F.concat(*parts)))
    line = F.get(F.split(t, "\n"), (F.col("_f.line") - 1).cast("int"))
    column = F.when(F.col("_f.first"), F.call_function("locate", F.col("_f.found"), line).cast("long")).otherwise(F.col("_f.at"))
    return rows.select(*(c for c in df.columns if c != text), F.col("_f.line").alias("line"), column.alias("column"), "_f.type", "_f.category", "_f.severity", "_f.match")


def summary(findings: DataFrame, files: int | None = None) -> DataFrame:
    """One row: issues in all, by category and by severity."""
    counts = {"total_issues": F.count("*")} | {f"n_{c.replace('-', '_')}": F.count_if(F.col("category") == c) for c in ("prompt-injection", "secret", "pii", "toxicity")} | {f"n_{s}": F.count_if(F.col("severity") == s) for s in SEVERITIES[1:]}
    out = findings.agg(*(c.alias(n) for n, c in counts.items()))
    return out.withColumn("total_files", F.lit(files).cast("long")) if files is not None else out


def fails(severity: Column, fail_on: str) -> Column:
    """Whether a finding is as severe as the level that fails the scan."""
    return severity_rank(severity) >= SEVERITIES.index(fail_on)


# The core shield and the browser build


def core_shield(text: Column, scanners: tuple[str, ...] = ("prompt-injection", "secrets")) -> Column:
    """struct(is_valid, risk_score, detections, secrets) of the small shield: six injection patterns and three kinds of secrets."""
    injected = F.lit(False)
    for p in L.CORE_INJECTION:
        injected = injected | F.rlike(text, F.lit(p))
    injected = injected if "prompt-injection" in scanners else F.lit(False)
    secrets = F.concat(*(regex_spans(text, p, kind, 0.8) for kind, p in L.CORE_SECRETS)) if "secrets" in scanners else F.array().cast(SPANS)

    def made(found: Column) -> Column:
        n = injected.cast("int") + (F.size(found) > 0).cast("int")
        return F.struct((n == 0).alias("is_valid"), F.when(F.size(found) > 0, 1.0).when(injected, 0.9).otherwise(0.0).alias("risk_score"), n.alias("detections"), found.alias("secrets"))

    return let(secrets, made)


def browser_checks(text: Column) -> dict[str, Column]:
    """Trivial predicates: an at sign and a dot, ten digits, three words, one phrase."""
    digits = F.length(text) - F.length(F.regexp_replace(text, r"\p{N}+", ""))
    return {
        "injection": F.contains(F.lower(text), F.lit("ignore previous instructions")),
        "email": F.contains(text, F.lit("@")) & F.contains(text, F.lit(".")),
        "phone": digits >= 10,
        "toxic": has_any(F.lower(text), ["hate", "kill", "destroy"]),
    }
