"""Mixing sources to target weights.

Method: hierarchical budgeting over a domain-language-source tree. The budget goes down by weight. What a child
can't supply (its tokens times the epochs allowed) is shared among its siblings by weight; only what all siblings
together lack reaches the parent's siblings, because a parent never gets more than its subtree has, where
leaves below a child of zero weight have nothing. A leaf takes whole epochs, then the prefix of a seeded order of its documents that fits.

Leaf sums are tables, and shares are window sums over siblings. The prefix is found by bins of the seeded hash:
bin sums tell the bin in which a leaf's budget ends, and only that bin's rows are sorted, so
a leaf of a third of all rows never meets in one task. The leaf table is broadcast up to
`broadcast_leaves` rows, and joined by shuffle beyond.

Cases: nulls in the tree's columns are a child of their own, whose weight is given under None; null text has no tokens and is taken with
its leaf's first epoch if there is budget left; rows without doc_id are placed by their texts; rows of one place go by doc_id, then by a hash of
all columns (but maps), so only equal rows tie, of which it does not matter which is taken; repeated rows are rows of
their own; other columns pass through (n_tokens and epoch are replaced); no rows or no budget give no rows; siblings of zero weight get
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.scratch import Scratch, aside

TREE = ("domain", "lang", "source")
BINS_BITS, BROADCAST_LEAVES = 14, 100_000
EPOCHS, SEED = 4, 17


def tokens(text: str = "text") -> Column:
    """Four bytes a token, as the library's token limit has it."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def child(column: str) -> Column:
    """A child's name in the tree: not null, and null's is no other's."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _weight(names: Column, weights: dict[str | None, float] | None) -> Column:
    """Weights by name; a child that none is given for has 0, and all have 1 without any."""
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for name, w in weights.items() for x in ("" if name is None else f"={name}", float(w)))), names), F.lit(0.0)).cast("double")


def order_of(seed: int, whole: Column) -> Column:
    """The seeded order, 0 to 2 ** 60: a hash of doc_id (of the text where that is null), another one after each whole epoch."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), whole.cast("string"), name)), 1, 15), 16, 10).cast("long")


def tie_of(documents: DataFrame) -> Column:
    """Decides between rows of one place: a hash of all columns but maps."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()))


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """children(…, budget of the parent as `budget`, weight, supply) with their own budget.

    The level at which weight * level, but no child's supply, is given: children are full in the order
    of supply / weight, and of those before one the supply is spent.
    """
    some = children.where("weight > 0")
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("supply").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = some.withColumn("level", F.greatest(F.lit(0.0), F.col("budget") - spent) / heavy)
    level = level.withColumn("level", F.when(F.col("level") * F.col("weight") < F.col("supply"), F.col("level")))
    level = level.withColumn("level", F.max("level").over(Window.partitionBy(*parent)))  # later children would count too much as spent
    return level.withColumn("budget", F.least(F.col("supply"), F.coalesce(F.col("level") * F.col("weight"), F.col("supply")))).drop("level")


def budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with their budgets."""
    out = None
    weighty = F.lit(True)
    for column in TREE:
        weighty &= _weight(F.col(column), weights.get(column)) > 0
    usable = leaves.where(weighty & (F.col("tokens") > 0))
    for depth, column in enumerate(TREE):
        own, parent = list(TREE[: depth + 1]), list(TREE[:depth])
        sums = usable.groupBy(*own).agg((F.sum("tokens") * epochs).cast("double").alias("supply"))
        level = sums.withColumn("budget", F.lit(float(budget))).withColumn("root", F.lit(0)) if out is None else sums.join(out.drop("supply"), parent)
        level = level.withColumn("weight", _weight(F.col(column), weights.get(column))).withColumn("name", F.col(column))
        out = shared_out(level, parent or ["root"]).select(*own, "budget", "supply")
    return leaves.join(out.drop("supply"), list(TREE))


def mix(documents: DataFrame, share: float, weights: dict[str, dict[str, float]], cost: Column | None = None, epochs: int = EPOCHS, seed: int = SEED, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """Rows of documents(doc_id, domain, lang, source, …) as often as they are taken, with `epoch` and `n_tokens`. share: of all tokens, the budget."""
    scratch = Scratch(documents.sparkSession, "mixing")
    names = [f"tree_{c}" for c in TREE]
    documents = documents.drop("n_tokens", "epoch")
    moved, back = aside(documents, "order", "bin", "whole", "rest", "taken", "end_bin", "end_before", "in_bin", "upto", *names)
    rows = moved.withColumn("n_tokens", tokens() if cost is None else cost)
    rows = rows.withColumns({n: child(c) for n, c in zip(names, TREE, strict=True)})
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = scratch.table(leaves.select(*(F.col(n).alias(c) for n, c in zip(names, TREE, strict=True)), "tokens"), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, share * total, weights, epochs).where("tokens > 0 and budget > 0")
    plan = plan.select(*(F.col(c).alias(n) for n, c in zip(names, TREE, strict=True)), F.expr("least(floor(budget / tokens), bigint(%d))" % epochs).alias("whole"), "tokens", "budget")
    plan = scratch.table(plan.withColumn("rest", F.when(F.col("whole") >= epochs, F.lit(0.0)).otherwise(F.col("budget") - F.col("whole") * F.col("tokens"))), "plan")
    small = plan.count() <= broadcast_leaves
    near = F.broadcast if small else lambda t: t.hint("shuffle_merge")
    met = rows.join(near(plan.select(*names, "whole", "rest")), names).withColumn("order", order_of(seed, F.col("whole"))).withColumn("bin", F.shiftright("order", 60 - BINS_BITS))
    sums = met.groupBy(*names, "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("rest"))
    upto = F.sum("in_bin").over(Window.partitionBy(*names).orderBy("bin"))
    ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy(*names).agg(F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"))).alias("end"))
    ends = scratch.table(ends.select(*names, F.col("end.bin").alias("end_bin"), F.col("end.before").alias("end_before")), "ends")
    met = met.join(near(ends), names, "left")
    inner = Window.partitionBy(*names).orderBy("order", F.col("doc_id").asc_nulls_last(), tie_of(moved)).rowsBetween(Window.unboundedPreceding, 0)
    last = met.where("bin = end_bin").withColumn("taken", (F.col("rest") > 0) & (F.col("end_before") + F.sum("n_tokens").over(inner) <= F.col("rest")))
    others = met.where("end_bin is null or bin <> end_bin").withColumn("taken", (F.col("rest") > 0) & (F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin"))))
    times = F.col("whole") + F.col("taken").cast("long")
    taken = others.unionByName(last).where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    return taken.select(*moved.columns, "n_tokens", "epoch").withColumnsRenamed(back)
