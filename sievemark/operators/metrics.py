"""Event-time metrics: roll-ups, retention, alerts, histograms, percentiles, caches, inference post-processing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of latency buckets in seconds.
BUCKETS = [0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.000, 2.500, 5.000]


def rollup(events: DataFrame, width: str, keys: list[str], value: str = "value", time: str = "ts") -> DataFrame:
    """Average, extremes and count per time bucket; also over streams with a watermark."""
    out = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *keys, "avg_value", "max_value", "min_value", "n")


def retained(events: DataFrame, interval: str, time: str = "ts") -> DataFrame:
    """Events no older than the interval before the newest."""
    newest = events.agg(F.max(time).alias("newest"))
    return events.join(F.broadcast(newest), F.col(time) >= F.col("newest") - F.expr(f"interval {interval}")).drop("newest")


def breaches(events: DataFrame, bad: Column, width: str, slide: str, limit: float, time: str = "ts") -> DataFrame:
    """Share of bad events per sliding window, and whether it is above the limit."""
    out = events.groupBy(F.window(time, width, slide).alias("w")).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "bad", "n", (F.col("bad") / F.col("n")).alias("ratio"), (F.col("bad") / F.col("n") > limit).alias("breach"))


def held(windows: DataFrame, keys: list[str], periods: int, time: str = "start") -> DataFrame:
    """Adds `firing`: the breach holds over this and the periods before it."""
    recent = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - periods, 0)
    return windows.withColumn("firing", (F.min(F.col("breach").cast("int")).over(recent) == 1) & (F.count("*").over(recent) == periods))


@dataclass(frozen=True)
class Alert:
    """A rule over sliding windows.

    kind: `ratio` (bad events to all), `rate` (bad events a second), `quantile` (of a value, by histogram buckets), `gauge` (the highest value), `absent` (a
    window without any bad event, where other windows have one). It fires when the comparison has held for `hold` windows in a row.
    """

    name: str
    kind: str
    operator: str
    limit: float
    bad: Column
    hold: int = 1
    value: str = "value"
    q: float = 0.95
    buckets: tuple[float, ...] = tuple(BUCKETS)


def alerts(events: DataFrame, rules: list[Alert], width: str = "5 minutes", slide: str = "1 minute", time: str = "ts") -> DataFrame:
    """(alert, start, value, breach, firing) of each rule and window: all rules are sums of one pass over the events."""
    seconds = pd.Timedelta(width).total_seconds()
    sums = [F.count("*").alias("n")]
    for i, r in enumerate(rules):
        v = F.col(r.value)
        sums.append({"gauge": F.max(F.when(r.bad, v)), "quantile": F.array(*(F.count_if(r.bad & (v <= b)) for b in (*r.buckets, float("inf"))))}.get(r.kind, F.count_if(r.bad)).alias(f"s{i}"))
    met = events.groupBy(F.window(time, width, slide).alias("w")).agg(*sums).withColumn("start", F.col("w.start")).drop("w")
    every = met.agg(F.min("start").alias("a"), F.max("start").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(f"interval {slide}"))).alias("start"))
    met = every.join(met.hint("shuffle_merge"), "start", "left")
    values = []
    for i, r in enumerate(rules):
        own = F.col(f"s{i}")
        value = {"ratio": lambda own=own: own / F.col("n"), "rate": lambda own=own: own / seconds, "gauge": lambda own=own: own, "absent": lambda own=own: F.coalesce(own, F.lit(0)), "quantile": lambda own=own, r=r: quantile_of(own, r.buckets, r.q)}[r.kind]()
        values.append(F.struct(F.lit(r.name).alias("alert"), value.cast("double").alias("value"), F.lit(r.operator).alias("operator"), F.lit(float(r.limit)).alias("limit"), F.lit(r.hold).alias("hold")))
    each = met.select("start", F.inline(F.array(*values))).where("value is not null").withColumn("breach", compare(F.col("value"), F.col("operator"), F.col("limit")))
    # A rule has a row a slide; those that hold longest look back furthest.
    order = Window.partitionBy("alert").orderBy("start")
    streak = F.row_number().over(order) - F.coalesce(F.max(F.when(~F.col("breach"), F.col("k"))).over(order), F.lit(0))
    placed = each.withColumn("k", F.row_number().over(order))
    return placed.withColumn("firing", streak >= F.col("hold")).select("alert", "start", "value", "breach", "firing")


def quantile_of(counts: Column, bounds: tuple[float, ...], q: float) -> Column:
    """The quantile from an array of cumulative counts, the last of which is of all: linear in its bucket, and the last finite bound beyond it."""
    total = F.get(counts, F.lit(len(bounds)))
    at = F.array_position(F.transform(counts, lambda n: n >= total * q), F.lit(True)).cast("int") - 1
    edges = F.array(F.lit(0.0), *(F.lit(float(b)) for b in bounds))
    low, below = F.get(edges, at), F.when(at > 0, F.get(counts, at - 1)).otherwise(0)
    inside = low + (F.get(edges, at + 1) - low) * (total * q - below) / (F.get(counts, at) - below)
    return F.when(total > 0, F.when(at == len(bounds), F.lit(float(bounds[-1]))).otherwise(inside))


def refreshed(rollups: DataFrame, now: Column, newest: str = "1 minute", oldest: str = "1 hour", bucket: str = "bucket") -> DataFrame:
    """The buckets that a refresh at `now` makes anew: none older than an hour, and not the newest minute."""
    return rollups.where((F.col(bucket) >= now - F.expr(f"interval {oldest}")) & (F.col(bucket) + F.expr(f"interval {newest}") <= now))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """A rule's comparison, by the rule's own operator."""
    return F.when(operator == ">", value > threshold).when(operator == "<", value < threshold).when(operator == ">=", value >= threshold).when(operator == "<=", value <= threshold).when(operator == "=", value == threshold).when(operator == "!=", value != threshold)


def histogram(df: DataFrame, value: Column, keys: list[str], buckets: list[float] | None = None) -> DataFrame:
    """(keys, le, n): counts up to each bound; the last bound is infinite."""
    bounds = [*(buckets or BUCKETS), float("inf")]
    rows = F.array(*(F.struct(F.lit(b).alias("le"), F.count_if(value <= b).alias("n")) for b in bounds))
    return df.groupBy(*keys).agg(rows.alias("h")).select(*keys, F.explode("h").alias("b")).select(*keys, "b.le", "b.n")


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation in its bucket; beyond the last finite bound that bound."""
    order = Window.partitionBy(*keys).orderBy("le")
    placed = hist.withColumns({"low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(order), F.lit(0)), "total": F.max("n").over(Window.partitionBy(*keys))})
    rank = F.col("total") * q
    hit = placed.where((F.col("n") >= rank) & (F.col("below") < rank))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


#: Bins of a key's values in which ranks are counted first.
RANK_BINS = 4096


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Mean, population deviation, extremes and the value at index floor(n * q) of the sorted values; null and NaN do not count.

    Ranks are counted in two levels: a key's range of values is cut into RANK_BINS, sums of the bins tell which hold a wanted
    rank, and only values of those are ranked, from counts of distinct ones.
    """
    rows = df.where(~F.isnan(F.col(value).cast("double")) & F.col(value).isNotNull())
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("min"), F.max(value).alias("max"))
    width = F.col("max").cast("double") - F.col("min").cast("double")
    scaled = F.floor((F.col(value).cast("double") - F.col("min").cast("double")) / width * RANK_BINS)
    binned = rows.join(sums.select(*keys, "min", "max"), keys).withColumn("bin", F.when(width > 0, F.least(scaled, F.lit(RANK_BINS - 1))).otherwise(0))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto))
    wanted = {k: F.least(F.floor(F.col("n") * q), F.col("n") - 1) for k, q in shares.items()}
    ranks = bins.join(sums.select(*keys, "n"), keys).select(*keys, "bin", (F.col("upto") - F.col("c")).alias("before"), "upto", F.explode(F.array(*(F.struct(F.lit(k).alias("share"), x.alias("rank")) for k, x in wanted.items()))).alias("w"))
    ranks = ranks.where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("upto"))).select(*keys, "bin", "before", "w.share", "w.rank")
    counts = binned.join(ranks.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", value).agg(F.count("*").alias("c"))
    inner = Window.partitionBy(*keys, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("inside", F.sum("c").over(inner))
    found = ranks.join(ranked, [*keys, "bin"]).where(F.col("before") + F.col("inside") > F.col("rank"))
    picks = [F.min(F.when(F.col("share") == k, F.col(value))).alias(k) for k in shares]
    return found.groupBy(*keys).agg(*picks).join(sums, keys)


def claim_holds(actual: Column, claimed: Column) -> Column:
    """Whether a ratio meets a claim such as 10x, 10-25x or >10x."""
    bare = F.regexp_replace(claimed, "[xX]", "")
    parts = F.split(bare, "-")
    low = F.coalesce(F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.lit(0.0))
    high = F.coalesce(F.trim(F.get(parts, F.lit(1))).try_cast("double"), F.lit(float("inf")))
    above = F.coalesce(F.trim(F.substring(bare, 2, 32)).try_cast("double"), F.lit(0.0))
    return F.when(F.contains(bare, F.lit("-")), (actual >= low) & (actual <= high)).when(F.startswith(bare, F.lit(">")), actual > above).otherwise(actual >= low)


def confusion(df: DataFrame, truth: Column, found: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy."""
    cells = {"tp": truth & found, "fp": ~truth & found, "fn": truth & ~found, "tn": ~truth & ~found}
    out = df.groupBy(*(keys or [])).agg(*(F.count_if(v).alias(k) for k, v in cells.items()))
    tp, fp, fn, tn = (F.col(k) for k in cells)
    return out.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn)})


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x.cast("double"))))


def argmax_last(values: Column) -> Column:
    """The place (from 0) of the greatest value; of equal ones the last."""
    return F.size(values) - F.array_position(F.reverse(values), F.array_max(values)).cast("int")


def cache_hits(requests: DataFrame, key: str, ttl: str, time: str = "ts") -> DataFrame:
    """Adds `hit`: the key's request before came no longer than the time to live ago."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time, "event_id"))
    return requests.withColumn("hit", F.coalesce(F.col(time) <= before + F.expr(f"interval {ttl}"), F.lit(False)))


def lru(requests: DataFrame, cache: str, key: str, capacity: int, ttl_seconds: float, time: str = "ts", order: str = "event_id") -> DataFrame:
    """requests(cache, key, time, order) with `hit`: a cache holds its `capacity` least recently used out, and entries for their time to live from their insertion on.

    A cache's requests depend on each other in order: they are read in one task, as a sorted stream; memory holds one cache's keys.
    """
    schema = f"{order} long, {cache} long, {key} string, hit boolean"

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries = object(), OrderedDict()
        for batch in batches:
            out = []
            for c, k, at in zip(batch[cache].to_pylist(), batch[key].to_pylist(), batch["at"].to_pylist(), strict=True):
                if c != now:
                    now, entries = c, OrderedDict()
                hit = k in entries and at - entries[k] < ttl_seconds * 1_000_000
                out.append(hit)
                if hit:
                    entries.move_to_end(k)
                elif capacity > 0:
                    entries.pop(k, None)
                    if len(entries) >= capacity:
                        entries.popitem(last=False)
                    entries[k] = at
            yield pa.RecordBatch.from_arrays([batch[order], batch[cache], batch[key], pa.array(out, pa.bool_())], [order, cache, key, "hit"])

    rows = requests.select(F.col(order).cast("long").alias(order), F.col(cache).cast("long").alias(cache), F.col(key).cast("string").alias(key), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    return rows.repartition(cache).sortWithinPartitions(cache, "at", order).mapInArrow(simulate, schema)


def inference_ratios(counts: DataFrame) -> DataFrame:
    """Adds rates to counts(total_calls, ml_calls, cache_hits, heuristic_short_circuits, total_ms, ml_errors); without calls they are 0."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counts.withColumns({"cache_hit_rate": share("cache_hits", "total_calls"), "heuristic_filter_rate": share("heuristic_short_circuits", "total_calls"), "avg_inference_ms": share("total_ms", "total_calls"), "ml_error_rate": share("ml_errors", "ml_calls")})


def in_flight(intervals: DataFrame, keys: list[str], start: str, end: str, bin_seconds: int = 3600) -> DataFrame:
    """Per key the most intervals open at once; one that ends when another begins is over.

    Running sums go over bins of time first, and within each bin from what is open where it begins, so that a key's marks
    are sorted bin by bin.
    """
    marks = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(intervals.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d")))
    sums = marks.groupBy(*keys, "at").agg(F.sum("d").alias("d")).withColumn("bin", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (bin_seconds * 1_000_000)))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.groupBy(*keys, "bin").agg(F.sum("d").alias("change")).withColumn("carried", F.coalesce(F.sum("change").over(before), F.lit(0)))
    running = F.sum("d").over(Window.partitionBy(*keys, "bin").orderBy("at"))
    return sums.join(bins.select(*keys, "bin", "carried"), [*keys, "bin"]).withColumn("open", F.col("carried") + running).groupBy(*keys).agg(F.max("open").alias("most"))


def over_limit(intervals: DataFrame, key: str, start: str, end: str, tier: str, limits: dict[str, int]) -> DataFrame:
    """Per key its tier, the most intervals open at once, the tier's limit, and whether it was passed."""
    most = in_flight(intervals, [key, tier], start, end)
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col(tier)), F.lit(0))
    return most.withColumn("limit", limit).withColumn("over", F.col("most") > F.col("limit"))


def once_per_text(df: DataFrame, text: str, scan) -> DataFrame:
    """df with `scanned`, computed once per distinct text and joined back by the text's hash and the text; null is a text too."""
    keyed = df.withColumns({"text_hash": F.xxhash64(text), "absent": F.col(text).isNull(), text: F.coalesce(text, F.lit(""))})
    keys, own = ["text_hash", "absent", text], F.when(~F.col("absent"), F.col(text))  # plain equality keeps the shuffle of the distinct texts
    found = keyed.select(*keys).dropDuplicates(keys).withColumn("scanned", scan(own))
    return keyed.join(found, keys).withColumn(text, own).drop("text_hash", "absent")
