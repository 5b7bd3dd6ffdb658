"""N-gram Jaccard join: every two documents whose sets of word shingles are alike, as linked components.

Method: adaptive multi-match prefixes. Shingles have one order, by how many documents have them.
Alike sets of overlap a share l shingles within the first n - a + l of each; a document takes the
l of least estimated cost (postings to read plus candidates to verify), and a pair is verified
only if its prefixes share the smaller l of the two.

What keeps the work in bounds, none of which loses a link:
- Shingles of one document only come first in the order and match nothing, so a document goes on
  only if enough of its shingles are in other documents, and with those alone.
- Equal sets are one node. Copies are never compared.
- Of a posting list, first the pairs with its most central node (pivot) are verified; components
  follow, and a list whose other nodes are of one component is done.
- Nodes that the open lists connect are clusters. A cluster that fits a task is one group. Of a larger one either the
  lists are dealt to groups, as many as fit a task, so that a node goes once for each of its open lists at most; or its
  nodes are cut into parts, where that moves less: those outside its largest component meet each other and those of it.
  Parts wait for the components of all else, and so do lists that fit no task: what is still open goes to parts of
  the lists' clusters, or of each list.
- A group counts the shingles that its sets share, the frequent ones by a matrix product, the others by an index in
  memory, and emits a link where two components meet first. No pairs are emitted, and the largest component is not
  compared with itself.

Cases: null or empty text has an empty set and links with nothing; fewer words than the shingle
length make one shingle; rows with one doc_id are one document where that matters: each row is
returned with the component of its own set (one_of_each keeps one row of them); a null doc_id counts as larger than all when the smallest is
taken, and a component of only such rows has a null id; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.components import components
from sievemark.llm.memory import give_back
from sievemark.llm.repeats import repeated_keys
from sievemark.llm.scratch import Scratch, aside, task_count
from sievemark.llm.wordhash import U, runs, words

WORDS, PERCENT = 5, 80
#: Cost of verifying a candidate against that of reading a posting, and the longest l.
VERIFY_COST, MOST_SHARED = 16.0, 16
#: Shingles of a group that one task compares, and pairs that it compares at once. A shingle is frequent if one of FEW sets of the group has it.
PART_SHINGLES, AT_ONCE, FEW = 1 << 20, 1 << 20, 8


def shingle_sets(k: int):
    """For repeated_keys: the distinct shingles of each text."""

    def extract(batch: pa.RecordBatch):
        for w in words(batch["text"], fold=True):
            gram, n = runs(w.hash, k), w.counts()
            keys, counts, names = [], np.zeros(w.texts, dtype=np.int64), []
            for d in range(w.texts):
                a = int(w.first[d])
                own = np.zeros(0, U)
                if n[d] >= k:
                    own = np.unique(gram[a : a + n[d] - k + 1])
                elif n[d]:
                    own = runs(w.hash[a : a + n[d]], int(n[d]))
                keys.append(own)
                counts[d] = len(own)
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            meta = pa.RecordBatch.from_arrays([batch["doc_id"].slice(w.at, w.texts), batch["th"].slice(w.at, w.texts), pa.array(counts), pa.array(names, pa.binary())], ["doc_id", "th", "n", "name"])
            yield np.concatenate(keys) if keys else np.zeros(0, U), counts, meta

    return extract


def _with_shared(percent: int):
    """Keeps the shared shingles of documents that have enough of them for a link."""

    def finish(rows: pa.Table, at: np.ndarray, keys: np.ndarray) -> pa.Table:
        n = rows["n"].to_numpy()
        cuts = np.searchsorted(at, np.arange(rows.num_rows + 1))
        shared = [keys[a:b].astype(np.int64) if b > a and 100 * (b - a) >= percent * m else None for a, b, m in zip(cuts[:-1], cuts[1:], n, strict=True)]
        return rows.append_column("shared", pa.array(shared, pa.list_(pa.int64())))

    return finish


def prefixes(percent: int, cost: float = VERIFY_COST, most: int = MOST_SHARED):
    """Adds l (`need`) and the prefix to nodes with shingles in order; `counts` are their documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, prefix = [], []
            for n, tokens, counts in zip(batch["n"].to_pylist(), batch["tokens"], batch["counts"], strict=True):
                tokens, counts = np.asarray(tokens.values), np.asarray(counts.values).astype(np.float64)
                overlap = -(-percent * n // 100)
                shortest = n - overlap - (n - len(tokens))  # shingles of this document alone come first
                read = np.cumsum(counts - 1)
                least, best = float("inf"), 1
                for l in range(1, min(most, overlap) + 1):
                    if shortest + l > len(tokens):
                        break
                    postings = read[shortest + l - 1] if shortest + l > 0 else 0.0
                    if (total := postings + cost * postings / l) < least:
                        least, best = total, l
                need.append(best)
                prefix.append(tokens[: max(0, shortest + best)])
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], batch["tokens"], batch["central"], pa.array(need, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], ["node", "n", "tokens", "central", "need", "prefix"])
            batch = tokens = counts = prefix = None
            give_back()

    return add


def _alike(percent: int) -> Column:
    both = F.size(F.array_intersect("x.tokens", "y.tokens"))
    near = F.size(F.array_intersect("x.prefix", "y.prefix")) >= F.least("x.need", "y.need")
    sizes = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    return sizes & F.when(near, 100 * both >= percent * (F.col("x.n") + F.col("y.n") - both)).otherwise(F.lit(False))


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    x, y = nodes.alias("x"), nodes.alias("y")
    first = pairs.alias("p").join(x.hint("shuffle_merge"), F.col("p.a") == F.col("x.node")).select(F.col("p.b").alias("b"), F.struct("x.*").alias("x"))
    return first.join(y.hint("shuffle_merge"), F.col("b") == F.col("y.node")).where(_alike(percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _order(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, tokens, counts) with shingles in order of their documents, where those of one node go; and the table of counts that it reads.

    Counts are written first, here and below: a join of two plain shuffles can be split where one key is hot.
    """
    each = nodes.select("node", "n", F.explode("shared").alias("token"))
    count = scratch.table(each.groupBy("token").agg(F.count("*").alias("count")).where("count > 1"), "counts")
    met = each.join(count.hint("shuffle_merge"), "token")
    ordered = met.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "token"))).alias("t"))
    return ordered.select("node", "n", F.col("t.token").alias("tokens"), F.col("t.count").alias("counts")), count


def text_name() -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5("text"))


def _labelled(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, th, n, label) per row: the name of the text, the size of its set, and its component (null for an empty set)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("th"), "text")
    sets = repeated_keys(docs, shingle_sets(shingle), _with_shared(percent), "doc_id long, th binary, n long, name binary, shared array<long>", task_count(spark, documents, 4 << 20))
    sets = scratch.table(sets, "sets")
    nodes = sets.where("shared is not null").groupBy("name").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("node"), "name", "n", "shared"), "nodes")  # numbers are fixed by writing
    rows, names = scratch.table(sets.select("doc_id", "th", "n", "name"), "rows"), scratch.table(nodes.select("node", "name"), "names")
    scratch.drop(sets)
    ordered, counts = _order(scratch, nodes)
    ordered = ordered.where(100 * F.size("tokens") >= percent * F.col("n"))
    central = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c) / F.col("n")
    ordered = ordered.withColumn("central", central).select("node", "n", "tokens", "counts", "central")
    ordered = scratch.table(ordered.mapInArrow(prefixes(percent), "node long, n long, tokens array<long>, central double, need int, prefix array<long>"), "ordered")
    scratch.drop(nodes, counts)
    label = _labels(scratch, ordered, percent)
    by_name = scratch.table(names.join(label.hint("shuffle_merge"), "node").select("name", "label"), "named")
    named = rows.join(by_name.hint("shuffle_merge"), "name", "left")
    # Equal sets share a component even where nothing else links; names have more digits than numbers.
    own = F.coalesce(F.col("label").cast("string"), F.hex("name"))
    return scratch.only(scratch.table(named.select("doc_id", "th", "n", F.when(F.col("n") > 0, own).alias("label")), "labelled"))


def similar_components(documents: DataFrame, shingle: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    documents should come from files: their rows are numbered where they are read.
    """
    named = _labelled(documents, shingle, percent)
    smallest = Scratch(documents.sparkSession, "jaccard-components").table(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest")
    out = named.join(smallest.hint("shuffle_merge"), "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(documents: DataFrame, shingle: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component the row with the smallest doc_id (nulls last), with all columns. Rows with empty sets all stay."""
    named = _labelled(documents, shingle, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    first = named.where("label is not null").groupBy("label").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("id"), F.col("r.th").alias("th"))
    moved, back = aside(documents, "th", "id")
    copies = moved.withColumn("th", text_name()).alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th"))
    kept = copies.join(first.hint("shuffle_merge").alias("f"), same, "left_semi")
    # Rows of one id and one text may differ elsewhere: the one of the least hash stays.
    others = [f.name for f in moved.schema.fields if "map<" not in f.dataType.simpleString()]
    kept = kept.groupBy("doc_id", "th").agg(F.min_by(F.struct(*moved.columns), F.xxhash64(*others)).alias("row")).select("row.*")
    return kept.withColumnsRenamed(back).select(documents.columns).unionByName(documents.where(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")))


def _labels(scratch: Scratch, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of the linked nodes."""
    lists = nodes.select("node", F.struct("central", "node").alias("rank"), F.explode("prefix").alias("token"))
    lists = scratch.table(lists, "postings")
    pivot = scratch.table(lists.groupBy("token").agg(F.max("rank").getField("node").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "pivots")
    rest = scratch.table(lists.select("token", "node").join(pivot.hint("shuffle_merge"), "token").where("node <> pivot"), "rest")
    scratch.drop(lists, pivot)
    pairs = rest.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = scratch.table(_verified(pairs, nodes, percent), "links")
    label = components(scratch, links)
    # Lists whose other nodes are of one component are done: a pivot has met all of its list.
    tagged = rest.where("size > 2").join(label.hint("shuffle_merge"), "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    open_lists = tagged.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first")).where("low <> high").select("token", "first")
    open_lists = scratch.table(open_lists, "open")
    left = scratch.table(tagged.join(open_lists.hint("shuffle_merge"), "token"), "left")
    scratch.drop(rest, open_lists)
    groups, large = _dealt(scratch, left, nodes)
    links = links.unionByName(scratch.table(_compared(groups, nodes, percent), "links"))
    label = components(scratch, links)
    if large.isEmpty():
        return label
    groups = _in_parts(scratch, large, label)
    return components(scratch, links.unionByName(scratch.table(_compared(groups, nodes, percent), "links")))


def _clusters(scratch: Scratch, lists: DataFrame) -> DataFrame:
    """(node, cluster) of lists(first, node): clusters share no list."""
    edges = lists.where("node <> first").selectExpr("first as a", "node as b").distinct()
    return components(scratch, edges).withColumnRenamed("label", "cluster")


def _dealt(scratch: Scratch, left: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (node, label, kind, key, i, j, ask) of clusters and of lists, each of PART_SHINGLES at most, and the rows of lists that go to parts."""
    cluster = _clusters(scratch, left)
    weighed = left.select("token", "node", "label").join(nodes.select("node", F.size("tokens").cast("long").alias("w")).hint("shuffle_merge"), "node").join(cluster.hint("shuffle_merge"), "node")
    weighed = scratch.table(weighed, "weighed")
    size = scratch.table(weighed.select("node", "cluster", "w").distinct().groupBy("cluster").agg(F.sum("w").alias("size")), "sizes")
    lists = scratch.table(weighed.groupBy("token").agg(F.sum("w").alias("list")), "lists")
    full = scratch.table(weighed.join(size.hint("shuffle_merge"), "cluster").join(lists.hint("shuffle_merge"), "token"), "full")
    whole = full.where(F.col("size") <= PART_SHINGLES).select("node", "label", F.lit(0).alias("kind"), F.col("cluster").alias("key"), F.lit(0).cast("long").alias("i"))
    large = full.where(F.col("size") > PART_SHINGLES)
    dealt = large.where(F.col("list") <= PART_SHINGLES).groupBy("cluster").agg(F.sum("w").alias("dealt"), F.first("size").alias("size"))
    # Lists of the same nodes would take these along again and again: in parts a node goes once for each part at most.
    dealt = dealt.where(F.col("dealt") <= F.col("size") * _parts(F.col("size")))
    buckets = scratch.table(dealt.select("cluster", F.ceil(F.col("dealt") / PART_SHINGLES).alias("buckets")), "buckets")
    large = large.join(buckets.hint("shuffle_merge"), "cluster", "left")
    fits = F.col("buckets").isNotNull() & (F.col("list") <= PART_SHINGLES)
    cut = large.where(fits).select("node", "label", F.lit(1).alias("kind"), F.col("cluster").alias("key"), F.pmod(F.xxhash64("token"), F.col("buckets")).alias("i"))
    groups = whole.unionByName(cut).distinct().select("*", F.lit(0).cast("long").alias("j"), F.lit(True).alias("ask"))
    return groups, large.where(~fits).select("token", "node", "w")


def _parts(w: Column) -> Column:
    return F.ceil(w * 2 / PART_SHINGLES)


def _majors(scratch: Scratch, rows: DataFrame, key: str) -> DataFrame:
    """Of rows(key, label, w) by key: the largest component, into how many parts it and all else go, and the shingles that this moves."""
    sums = rows.groupBy(key, "label").agg(F.sum("w").alias("w"))
    sums = sums.groupBy(key).agg(F.max_by("label", F.struct("w", "label")).alias("major"), F.max("w").alias("held"), F.sum("w").alias("all"))
    sums = sums.withColumns({"asking": _parts(F.col("all") - F.col("held")), "asked": _parts(F.col("held"))})
    moved = (F.col("all") - F.col("held")) * (F.col("asking") + F.col("asked")) + F.col("held") * F.col("asking")
    return scratch.table(sums.select(key, "major", "asking", "asked", moved.alias("moved")), "majors")


def _in_parts(scratch: Scratch, large: DataFrame, label: DataFrame) -> DataFrame:
    """Groups of large lists that have several components yet, by clusters or by lists, where less is moved. Parts outside the largest component ask each other, and its parts."""
    tagged = large.join(label.hint("shuffle_merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    tagged = scratch.table(tagged, "large")
    open_lists = tagged.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("first")).where("low <> high").select("token", "first")
    tagged = scratch.table(tagged.join(scratch.table(open_lists, "open").hint("shuffle_merge"), "token"), "left")
    tagged = scratch.table(tagged.join(_clusters(scratch, tagged).hint("shuffle_merge"), "node").drop("first"), "clusters")
    each = tagged.select("cluster", "node", "label", "w").distinct()
    by_cluster, by_list = _majors(scratch, each, "cluster"), _majors(scratch, tagged, "token")
    lists = tagged.select("cluster", "token").distinct().join(by_list.hint("shuffle_merge"), "token").groupBy("cluster").agg(F.sum("moved").alias("lists"))
    by_cluster = scratch.table(by_cluster.join(lists.hint("shuffle_merge"), "cluster").where("moved <= lists").drop("moved", "lists"), "together")
    met = each.join(by_cluster.hint("shuffle_merge"), "cluster").withColumns({"kind": F.lit(2), "key": F.col("cluster")}).drop("cluster")
    alone = tagged.join(by_cluster.hint("shuffle_merge"), "cluster", "left_anti").drop("cluster").join(by_list.drop("moved").hint("shuffle_merge"), "token")
    met = met.unionByName(alone.withColumns({"kind": F.lit(3), "key": F.col("token")}).drop("token"))
    part = F.when(F.col("label") == F.col("major"), F.col("asking") + F.pmod(F.xxhash64("node"), F.col("asked"))).otherwise(F.pmod(F.xxhash64("node"), F.col("asking")))
    met = met.withColumn("part", part)
    others = F.when(F.col("label") == F.col("major"), F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("asking") + F.col("asked") - 1))
    each = met.withColumn("other", F.explode(others))
    return each.select("node", "label", "kind", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("ask"))


def _compared(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each group."""
    full = groups.join(nodes.select("node", "n", "tokens").hint("shuffle_merge"), "node")
    return full.groupBy("kind", "key", "i", "j").applyInArrow(_links_of(percent), "a long, b long").distinct()


def _index(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each list begins (and the last ends)."""
    cuts = lists.offsets.to_numpy()
    return lists.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]


def _links_of(percent: int):
    """Links of a group. If all its nodes ask, each two components meet; else those that ask meet the others (and each other in another group)."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, n, ask = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "ask"))
        tokens, cuts = _index(table["tokens"].combine_chunks())
        _, component, size = np.unique(label, return_inverse=True, return_counts=True)
        among = bool(ask.all())
        asking = component != size.argmax() if among else ask  # of two components one is not the largest
        order = np.argsort(~asking, kind="stable")  # those that ask come first
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        last = int(asking.sum())
        owner = np.repeat(place, np.diff(cuts))
        node, n, component = node[order], n[order], component[order]
        _, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
        frequent = (count > 1) & (FEW * count >= len(node))
        has = np.zeros((len(node), int(frequent.sum())), dtype=np.float32 if n.max() < 1 << 24 else np.float64)
        often = frequent[number]
        has[owner[often], (np.cumsum(frequent) - 1)[number[often]]] = 1
        rare = ~often & (count > 1)[number]
        owner, number = owner[rare], number[rare]
        by = np.argsort(number, kind="stable")
        posted, first = owner[by], np.searchsorted(number[by], np.arange(len(count) + 1))
        by = np.argsort(owner, kind="stable")
        own, ends = number[by], np.searchsorted(owner[by], np.arange(len(node) + 1))
        a, b = [], []
        s = 0
        while s < last:
            low = s if among else last  # later ones that ask meet this one there
            if low == len(node):
                break
            e = min(last, s + max(1, AT_ONCE // (len(node) - low)))
            both = (has[s:e] @ has[low:].T).astype(np.float64)
            for q in range(s, e):
                if ends[q] < ends[q + 1]:
                    met = np.concatenate([posted[first[t] : first[t + 1]] for t in own[ends[q] : ends[q + 1]].tolist()])
                    both[q - s] += np.bincount(met, minlength=len(node))[low:]
            alike = (100 + percent) * both >= percent * (n[s:e, None] + n[low:])
            alike &= component[s:e, None] != component[low:]
            for q in (np.flatnonzero(alike.any(axis=1)) + s).tolist():
                met = np.flatnonzero(alike[q - s]) + low
                while len(met := met[component[met] != component[q]]):
                    x = met[0]
                    a.append(min(int(node[q]), int(node[x])))
                    b.append(max(int(node[q]), int(node[x])))
                    component[component == component[x]] = component[q]
            s = e
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links
