"""Ordered folds over span arrays: overlaps and replacing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.text import SPANS


def by_start(spans: Column) -> Column:
    """Spans by start; those of one start keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def first_wins(spans: Column) -> Column:
    """Drops spans that begin before the last kept one ends."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        fits = s["start"] >= state["end"]
        return F.struct(F.when(fits, s["end"]).otherwise(state["end"]).alias("end"), F.when(fits, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"))

    return F.aggregate(by_start(spans), start, step, lambda st: st["out"])


def surest_wins(spans: Column) -> Column:
    """Of spans that overlap the current one, the one of strictly higher confidence becomes it."""
    ordered = by_start(spans)
    start = F.struct(F.array().cast(SPANS).alias("now"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        none = F.size(state["now"]) == 0
        overlaps = ~none & (s["start"] < F.coalesce(F.get(state["now"], F.lit(0))["end"], F.lit(0)))
        surer = s["confidence"] > F.coalesce(F.get(state["now"], F.lit(0))["confidence"], F.lit(0.0))
        held = F.when(overlaps, F.when(surer, F.array(s)).otherwise(state["now"])).otherwise(F.array(s))
        out = F.when(none | overlaps, state["out"]).otherwise(F.concat(state["out"], state["now"]))
        return F.struct(held.alias("now"), out.alias("out"))

    return F.aggregate(ordered, start, step, lambda st: F.concat(st["out"], st["now"]))


def current_wins(spans: Column) -> Column:
    """Of spans that overlap the one kept last (either begins before the other ends), one of strictly higher confidence takes its place."""
    start = F.struct(F.array().cast(SPANS).alias("now"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        held = F.get(state["now"], F.lit(0))
        none = F.size(state["now"]) == 0
        overlaps = ~none & F.coalesce((held["start"] < s["end"]) & (s["start"] < held["end"]), F.lit(False))
        kept = F.when(overlaps & (s["confidence"] <= held["confidence"]), state["now"]).otherwise(F.array(s))
        return F.struct(kept.alias("now"), F.when(none | overlaps, state["out"]).otherwise(F.concat(state["out"], state["now"])).alias("out"))

    return F.aggregate(by_start(spans), start, step, lambda st: F.concat(st["out"], st["now"]))


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with spans (in order, apart, byte offsets) replaced; replacement(span, index) gives a string."""
    raw = F.encode(text, "UTF-8")
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), replacement(s, i).alias("by")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.decode(F.substring(raw, state["at"] + 1, s["start"] - state["at"]), "UTF-8")
        return F.struct(s["end"].alias("at"), F.concat(state["out"], before, s["by"]).alias("out"))

    ended = F.aggregate(numbered, start, step, lambda st: F.concat(st["out"], F.decode(F.substring(raw, st["at"] + 1, F.greatest(F.octet_length(text) - st["at"], F.lit(0))), "UTF-8")))
    return F.when(F.size(spans) == 0, text).otherwise(ended)
