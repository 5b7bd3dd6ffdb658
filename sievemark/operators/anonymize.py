"""Reversible anonymization: detect, number placeholders, replace, keep mappings, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions import lists as L
from sievemark.functions.spans import splice, surest_wins
from sievemark.functions.text import ipv4, let, luhn, regex_spans, ssn
from sievemark.operators.scanners import pii_needs

TTL_SECONDS = 3600


def entities(text: Column) -> Column:
    """PII spans with overlaps resolved."""
    kept = {"SSN": lambda s: ssn(s["text"]), "CREDIT_CARD": lambda s: luhn(s["text"]), "IP_ADDRESS": lambda s: ipv4(s["text"])}
    parts = []
    for kind, pattern, confidence in L.ANONYMIZED:
        spans = regex_spans(text, pattern, kind, confidence, pii_needs(text, kind))
        parts.append(F.filter(spans, kept[kind]) if kind in kept else spans)
    return surest_wins(F.concat(*parts))


def numbered(spans: Column) -> Column:
    """Spans with `placeholder` [TYPE_n]; n counts a type's spans from 1."""

    def made(spans: Column) -> Column:
        return F.transform(spans, lambda s, i: s.withField("placeholder", F.concat(F.lit("["), s["entity_type"], F.lit("_"), F.size(F.filter(F.slice(spans, F.lit(1), i + 1), lambda k: k["entity_type"] == s["entity_type"])).cast("string"), F.lit("]"))))

    return let(spans, made)


def anonymize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds `anonymized` and `mappings` (spans with placeholders); each row is a session of its own."""
    found = df.withColumn("mappings", numbered(entities(F.col(text))))
    return found.withColumn("anonymized", splice(F.col(text), F.col("mappings"), lambda s, i: s["placeholder"]))


def placeholders(spans: DataFrame, key: str) -> DataFrame:
    """The same numbers for spans that are rows: (key, entity_type, start)."""
    order = Window.partitionBy(key, "entity_type").orderBy("start")
    return spans.withColumn("placeholder", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.row_number().over(order).cast("string"), F.lit("]")))


def vault(anonymized: DataFrame, key: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Mappings as rows: session_id, placeholder, entity_type, original_value, confidence, ts, expires_at."""
    each = anonymized.select(F.col(key).cast("string").alias("session_id"), F.explode("mappings").alias("m"), now.alias("ts"))
    return each.select("session_id", "m.placeholder", "m.entity_type", F.col("m.text").alias("original_value"), "m.confidence", "ts", (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def active(mappings: DataFrame, now: Column) -> DataFrame:
    """Mappings that have not expired; the last write of a key counts."""
    last = Window.partitionBy("session_id", "placeholder").orderBy(F.desc("ts"))
    newest = mappings.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    return newest.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def without(mappings: DataFrame, sessions: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """mappings less whole sessions (session_id) and single ones (session_id, placeholder)."""
    if sessions is not None:
        mappings = mappings.join(sessions.select("session_id").distinct(), "session_id", "left_anti")
    if keys is not None:
        mappings = mappings.join(keys.select("session_id", "placeholder").distinct(), ["session_id", "placeholder"], "left_anti")
    return mappings


def cleaned(mappings: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Mappings that have not expired, and a row with the number of those that go."""
    gone = F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    return mappings.where(~gone), mappings.agg(F.count_if(gone).alias("removed"))


def session(mappings: DataFrame, session_id: str, now: Column) -> DataFrame:
    """A session's active mappings; no rows where it has none."""
    return active(mappings.where(F.col("session_id") == session_id), now)


def restore(text: Column, mappings: Column) -> Column:
    """The text with its placeholders replaced by what they stood for."""
    return F.aggregate(mappings, text, lambda s, m: F.replace(s, m["placeholder"], m["text"]))


def deanonymize(texts: DataFrame, mappings: DataFrame, text: str = "anonymized") -> DataFrame:
    """texts(session_id, …) with `restored` and `restored_count` from rows of mappings."""
    by_session = mappings.groupBy("session_id").agg(F.collect_list(F.struct("placeholder", F.col("original_value").alias("text"))).alias("found"))
    met = texts.join(by_session, "session_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<placeholder:string,text:string>>")))
    met = met.withColumn("found", F.filter("found", lambda m: F.contains(F.col(text), m["placeholder"])))
    return met.withColumn("restored", restore(F.col(text), F.col("found"))).withColumn("restored_count", F.size("found")).drop("found")


def audited(mappings: DataFrame) -> DataFrame:
    """A log row per session and event, with the session id masked."""
    return mappings.groupBy("session_id").agg(F.count("*").alias("entities"), F.min("ts").alias("ts")).select(F.lit("anonymize").alias("event_type"), F.concat(F.left("session_id", F.lit(8)), F.lit("****")).alias("session_id"), "entities", "ts")


def bio_rows(tokens: Column, least: float = 0.85) -> Column:
    """Entities of a row's tokens (token, tag B-X/I-X/O, start, end, confidence) in order: a B, another type or an I alone begins one. Nothing is shuffled.

    Borders are found first, so that an entity is a slice of the tokens and no list grows token by token.
    """

    def made(tokens: Column) -> Column:
        kind = lambda t: F.when(t["tag"] != "O", F.substring(t["tag"], 3, 64))
        begins = lambda t, i: (t["tag"] != "O") & (F.left(t["tag"], F.lit(2)).eqNullSafe(F.lit("B-")) | (i == 0) | ~kind(F.get(tokens, F.greatest(i - 1, F.lit(0)))).eqNullSafe(kind(t)))
        # Where an entity or a gap begins; the last border is the end.
        edges = F.filter(F.transform(tokens, lambda t, i: F.when(begins(t, i) | (t["tag"] == "O"), i)), lambda i: i.isNotNull())

        def cut(edges: Column) -> Column:
            parts = F.transform(edges, lambda a, k: F.slice(tokens, a + 1, F.coalesce(F.get(edges, k + 1), F.size(tokens)) - a))
            entities = F.filter(parts, lambda p: F.get(p, F.lit(0))["tag"] != "O")
            return F.transform(
                entities,
                lambda p: F.struct(
                    kind(F.get(p, F.lit(0))).alias("entity_type"), F.array_min(F.transform(p, lambda t: t["start"])).alias("start"), F.array_max(F.transform(p, lambda t: t["end"])).alias("end"),
                    (F.aggregate(p, F.lit(0.0), lambda s, t: s + t["confidence"]) / F.size(p)).alias("confidence"), F.array_join(F.transform(p, lambda t: t["token"]), " ").alias("text"), F.size(p).alias("n"),
                ),
            )

        return F.filter(let(edges, cut), lambda e: e["confidence"] >= least)

    return F.when(F.size(tokens) > 0, let(tokens, made)).otherwise(F.array().cast("array<struct<entity_type:string,start:int,end:int,confidence:double,text:string,n:int>>"))


def bio_entities(tokens: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Entities from rows (key, pos, token, tag B-X/I-X/O, start, end, confidence): a B, another type or an I alone begins one."""
    order = Window.partitionBy(key).orderBy("pos")
    kind = F.when(F.col("tag") == "O", F.lit(None)).otherwise(F.substring("tag", 3, 64))
    with_kind = tokens.withColumn("kind", kind)
    begins = F.col("kind").isNotNull() & ((F.left("tag", F.lit(2)) == "B-") | ~F.coalesce(F.lag("kind").over(order) == F.col("kind"), F.lit(False)))
    island = with_kind.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(order)).where("kind is not null")
    out = island.groupBy(key, "island").agg(F.first("kind").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), " ").alias("text"))
    return out.where(F.col("confidence") >= least)
