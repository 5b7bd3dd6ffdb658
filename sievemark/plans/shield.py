"""Pipelines of scanners: presets, combining, short circuit, policy, thresholds, hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.text import FACTORS, SPANS, let, strings
from sievemark.operators import scanners as S
from sievemark.operators.metrics import once_per_text

Scanner = Callable[[Column], Column]

#: Scanners that need no settings, by name.
INPUT: dict[str, Scanner] = {"ban_code": S.ban_code, "token_limit": S.token_limit, "invisible_text": S.invisible_text, "gibberish": S.gibberish, "language": S.language, "secrets": S.secrets, "prompt_injection": S.prompt_injection, "toxicity": S.toxicity, "sentiment": S.sentiment}
OUTPUT: dict[str, Scanner] = {"no_refusal": S.no_refusal, "sensitive": S.sensitive, "ban_topics": S.ban_topics, "bias": S.bias, "malicious_urls": S.malicious_urls, "reading_time": S.reading_time, "factuality": S.factuality, "url_reachability": S.url_reachability}


@dataclass(frozen=True)
class Settings:
    """How a shield runs. Spark runs the scanners of a row in one projection, so max_concurrent and tracing only describe; caching scans each text once."""

    sequential: bool = False
    max_concurrent: int = 4
    short_circuit: float | None = 0.9
    timeout_ms: int | None = 30_000
    tracing: bool = True
    caching: bool = False
    cache_seconds: int = 300
    max_batch: int = 100


# Settings by purpose, and presets.
SETTINGS = {
    "default": Settings(),
    "development": Settings(True, 1, None, 60_000, True, False, 0, 10),
    "production": Settings(False, 8, 0.95, 10_000, True, True, 300, 100),
    "high_throughput": Settings(False, 16, 0.9, 5_000, False, True, 600, 500),
}


@dataclass(frozen=True)
class Preset:
    """A named choice of scanners, in the order in which they run; those that need settings of their own (words, names, a prompt) are not in it."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    settings: Settings


PRESETS = {
    "strict": Preset(
        ("ban_code", "secrets", "toxicity", "prompt_injection", "invisible_text", "gibberish", "language", "token_limit", "sentiment"),
        ("sensitive", "no_refusal", "bias", "malicious_urls", "factuality", "url_reachability"),
        Settings(True, 1, 0.7, 60_000, True, False, 0, 50),
    ),
    "standard": Preset(("secrets", "toxicity", "prompt_injection", "invisible_text", "token_limit"), ("sensitive", "malicious_urls", "no_refusal"), Settings(False, 4, 0.9, 30_000, True, True, 300, 100)),
    "permissive": Preset(("secrets", "invisible_text"), ("sensitive",), Settings(False, 8, None, 10_000, False, True, 600, 200)),
}


def until_risk(results: Column, limit: float) -> Column:
    """The results up to the first whose risk reaches the limit."""
    stops = F.transform(results, lambda r: r["risk_score"] >= limit)
    first = F.array_position(stops, F.lit(True))
    return F.when(first > 0, F.slice(results, F.lit(1), first.cast("int"))).otherwise(results)


def combine(results: Column, text: Column) -> Column:
    """One result: all valid, the highest risk, all entities and factors, later metadata over earlier, the first sanitized text."""
    nothing = F.size(results) == 0
    return F.struct(
        F.lit("combined").alias("scanner"),
        F.when(nothing, F.lit("")).otherwise(F.get(results, F.lit(0))["sanitized_text"]).alias("sanitized_text"),
        F.forall(results, lambda r: r["is_valid"]).alias("is_valid"),
        F.coalesce(F.array_max(F.transform(results, lambda r: r["risk_score"])), F.lit(0.0)).alias("risk_score"),
        F.flatten(F.transform(results, lambda r: r["entities"])).cast(SPANS).alias("entities"),
        F.flatten(F.transform(results, lambda r: r["risk_factors"])).cast(FACTORS).alias("risk_factors"),
        F.aggregate(results, F.create_map().cast("map<string,string>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(r["metadata"], k)), r["metadata"])).alias("metadata"),
    )


@dataclass
class Shield:
    """Runs scanners over a text column of any DataFrame; each scanner is one expression, and nothing is shuffled."""

    scanners: dict[str, Scanner] = field(default_factory=dict)
    sequential: bool = False
    short_circuit: float | None = None
    max_batch: int = Settings.max_batch

    @staticmethod
    def preset(name: str, output: bool = False) -> Shield:
        p = PRESETS[name]
        table, names = (OUTPUT, p.outputs) if output else (INPUT, p.inputs)
        return Shield({n: table[n] for n in names}, p.settings.sequential, p.settings.short_circuit, p.settings.max_batch)

    def with_scanner(self, name: str, scanner: Scanner) -> Shield:
        return replace(self, scanners={**self.scanners, name: scanner})

    def with_settings(self, settings: Settings) -> Shield:
        return replace(self, sequential=settings.sequential, short_circuit=settings.short_circuit, max_batch=settings.max_batch).checked()

    def with_short_circuit(self, limit: float | None) -> Shield:
        """Limits are kept within 0 and 1."""
        return replace(self, short_circuit=None if limit is None else min(1.0, max(0.0, limit)))

    def checked(self) -> Shield:
        """Refuses what could not run."""
        if not self.scanners:
            raise ValueError("a shield needs a scanner")
        if self.max_batch < 1:
            raise ValueError("a batch has a row at least")
        return self.with_short_circuit(self.short_circuit)

    def results(self, text: Column) -> Column:
        found = F.array(*(s(text) for s in self.checked().scanners.values()))
        # Only a sequential run can stop early.
        return let(found, lambda r: until_risk(r, self.short_circuit)) if self.sequential and self.short_circuit is not None else found

    def scan(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds `results` and `verdict`."""
        return df.withColumn("results", self.results(F.col(text))).withColumn("verdict", let(F.col("results"), lambda r: combine(r, F.col(text))))

    def verdict(self, text: Column) -> Column:
        return let(self.results(text), lambda r: combine(r, text))

    def scan_once(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds `verdict`; each distinct text is scanned once, which pays where many rows have the same."""
        return once_per_text(df, text, self.verdict).withColumnRenamed("scanned", "verdict")

    def batch_errors(self, df: DataFrame, batch: str) -> DataFrame:
        """(batch, n, error) of the batches of more rows than may be scanned at once."""
        sizes = df.groupBy(batch).agg(F.count("*").alias("n")).where(F.col("n") > self.max_batch)
        return sizes.withColumn("error", F.concat(F.lit("batch size "), F.col("n").cast("string"), F.lit(f" exceeds maximum {self.max_batch}")))


def scan_both(df: DataFrame, inputs: Shield, outputs: Shield, prompt: str = "prompt", output: str = "output") -> DataFrame:
    """Adds prompt_verdict and output_verdict: both sides of an exchange in one projection."""
    return df.withColumns({"prompt_verdict": inputs.verdict(F.col(prompt)), "output_verdict": outputs.verdict(F.col(output))})


def sanitize_chain(text: Column, *sanitizers: Scanner) -> Column:
    """Each scanner sanitizes what the one before left."""
    for s in sanitizers:
        text = s(text)["sanitized_text"]
    return text


def threshold_of(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in L.THRESHOLDS.items() for x in kv))
    return F.coalesce(F.element_at(table, name), F.lit(L.DEFAULT_THRESHOLD))


def apply_policy(risk: Column, valid: Column, action: Column, adjustment: Column) -> tuple[Column, Column]:
    """(risk, valid) after a policy's decision: the higher risk, and blocked is invalid."""
    return F.greatest(risk, F.coalesce(adjustment, F.lit(0.0))), valid & (F.coalesce(action, F.lit("allow")) != "block")


def blocked(text: Column, patterns: Column) -> Column:
    """Whether any of the patterns (pattern, case_sensitive) is in the text."""
    return F.exists(patterns, lambda p: F.when(p["case_sensitive"], F.contains(text, p["pattern"])).otherwise(F.contains(F.lower(text), F.lower(p["pattern"]))))


def allowed(text: Column, patterns: Column) -> Column:
    """Whether any of the patterns (pattern, case_sensitive) is in the text; without patterns everything is allowed."""
    return (F.size(patterns) == 0) | blocked(text, patterns)


@dataclass(frozen=True)
class Hook:
    """What is done where the condition holds: adjust by an amount, skip the rest (approve or reject), or an error with its fallback (block, allow, fail or continue)."""

    condition: Column
    kind: str
    amount: float = 0.0
    reason: str = ""
    fallback: str = "continue"
    enabled: bool = True


def pre_hooks(hooks: list[Hook]) -> Column:
    """struct(decision, reason, adjustment): continue, approved, rejected or modify. Approvals and rejections end the run; the last adjustment counts."""
    state = F.struct(F.lit("continue").alias("decision"), F.lit("").alias("reason"), F.lit(0.0).alias("adjustment"))
    for h in hooks:
        if not h.enabled:
            continue
        made = lambda decision, reason="", amount=0.0: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(float(amount)).alias("adjustment"))
        done = {"approve": made("approved", h.reason), "reject": made("rejected", h.reason), "adjust": made("modify", "", h.amount)}.get(h.kind)
        if h.kind == "error":
            done = {"block": made("rejected", f"Hook error (blocked): {h.reason}"), "allow": made("approved", f"Hook error (allowed): {h.reason}"), "fail": F.raise_error(F.lit(h.reason)).cast("struct<decision:string,reason:string,adjustment:double>")}.get(h.fallback)
        if done is not None:
            state = let(state, lambda s: F.when(h.condition & ~s["decision"].isin("approved", "rejected"), done).otherwise(s))
    return state


def post_hooks(risk: Column, valid: Column, hooks: list[Hook]) -> Column:
    """struct(risk_score, is_valid, adjustment, override, ended) after the hooks: an adjusted risk stays within 0 and 1, a rejected one is 1, and a skip or a blocking error ends the run."""
    kinds = "struct<risk_score:double,is_valid:boolean,adjustment:double,override:string,ended:boolean>"
    state = F.struct(risk.cast("double").alias("risk_score"), valid.alias("is_valid"), F.lit(None).cast("double").alias("adjustment"), F.lit(None).cast("string").alias("override"), F.lit(False).alias("ended")).cast(kinds)
    for h in hooks:
        if not h.enabled or h.kind == "error" and h.fallback in ("continue", "allow"):
            continue

        def step(s: Column) -> Column:
            rejects = h.kind in ("reject", "error")
            if h.kind == "error" and h.fallback == "fail":
                changed = F.raise_error(F.lit(h.reason)).cast(kinds)
            elif h.kind == "adjust":
                moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["risk_score"] + h.amount))
                changed = F.struct(moved.alias("risk_score"), s["is_valid"].alias("is_valid"), F.lit(h.amount).alias("adjustment"), s["override"].alias("override"), F.lit(False).alias("ended")).cast(kinds)
            else:
                said = f"Blocked: {h.reason}" if h.kind == "error" else h.reason
                changed = F.struct((F.lit(1.0) if rejects else s["risk_score"]).alias("risk_score"), (F.lit(False) if rejects else s["is_valid"]).alias("is_valid"), s["adjustment"].alias("adjustment"), F.lit(said).alias("override"), F.lit(True).alias("ended")).cast(kinds)
            return F.when(h.condition & ~s["ended"], changed).otherwise(s)

        state = let(state, step)
    return state


def policy_pre_check(action: Column, reason: str = "policy") -> Hook:
    """Rejects what a policy decided to block."""
    return Hook(F.coalesce(action == "block", F.lit(False)), "reject", reason=reason)


def config_threshold(risk: Column, threshold: float) -> Hook:
    """Marks results over a threshold, and changes nothing in them."""
    return Hook(risk >= threshold, "adjust", 0.0)


def request_error(prompt: Column, scanners: Column, batch: Column, concurrency: Column) -> Column:
    """Why a request is refused; null if it isn't."""
    return (
        F.when(F.length(prompt) < 1, "prompt is empty").when(F.length(prompt) > 100_000, "prompt is too long").when(scanners > 20, "too many scanners")
        .when(~batch.between(1, 100), "batch size out of range").when(~concurrency.between(1, 10), "concurrency out of range")
    )


def merge_detections(df: DataFrame, key: str) -> DataFrame:
    """Detections of several scanners once per (key, start, end, type)."""
    return df.dropDuplicates([key, "start", "end", "entity_type"])


def merged_spans(spans: Column) -> Column:
    """The same within a row's spans: the first of each place and type, without a shuffle."""
    key = lambda s: F.struct(s["start"], s["end"], s["entity_type"])
    return let(spans, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda s, i: F.array_position(keys, key(s)) == i + 1)))


def weighted_risk(severities: Column, confidences: Column) -> Column:
    """The mean of severity weight times confidence, at most 1."""
    weights = F.zip_with(severities, confidences, lambda s, c: (F.array_position(strings(["none", "low", "medium", "high", "critical"]), s) - 1) * 0.25 * c)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), F.size(severities)), F.lit(0.0)))
