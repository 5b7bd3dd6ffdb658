"""Substring dedup: removes words of passages that a document with a smaller id has too.

Method: prefix-partitioned suffix trees. A suffix begins at a word; its first `depth` words decide.
Suffixes that cannot repeat are left out first, without loss: the least hash of the k-word runs in
those words goes with equal words, so a suffix whose least run is in no other document has no
equal. The rest are dealt to ranges that fit a task's memory by a prefix that is as short as that allows: by that run, or, where
HOT_ROWS rows have the run, by all of the suffix's words. Within a range, prefixes
are lengthened word by word until their suffixes fit the size of one subtree. Sorted suffixes with their common prefix
lengths are the subtree; its deep internal nodes (of `depth` words or more) are the repeats, and the least document
below such a node keeps its words. Nodes that follow each other word by word make up a maximal repeat: `passages` are
those of a document that go.

Hashes only deal and sort: the words themselves travel, and suffixes are equal where all their bytes are.

Equal suffixes of many documents are settled in the map tasks first: only those of the least
document of a chunk go on, so a passage of a third of all documents reaches the shuffle once a chunk.

Cases: null text has no words; null doc_id counts as larger than all; rows with one doc_id never
remove each other's words; a suffix that repeats in its own document alone stays; other columns of the input are
ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.repeats import _WIRE, _WIRE_DDL, ANSWER, BLOCK_BITS, CHUNK_KEYS, ENTRY, ROWS, _batches, by_block, next_block, repeated_keys
from sievemark.llm.scratch import Scratch, task_count
from sievemark.llm.wordhash import U, mix, numbers, planes, runs, unplanes, windows, words

DEPTH, RUN = 13, 6
SUBTREE_SUFFIXES = 400_000
#: Rows that a run is in from which its suffixes are dealt by all their words.
HOT_ROWS = 1 << 13
_LAST = (1 << 63) - 1
_EVEN = ~U(1)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` consecutive values."""
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _starts(first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words where a suffix of `depth` words begins, and how many each text has."""
    n = np.maximum(np.diff(first) - depth + 1, 0)
    at = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return at, n


def pieces(words: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Row numbers of suffixes in groups of up to `limit` by prefixes as short as that allows; equal suffixes stay together."""
    depth = words.shape[1]
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        rows, k = todo.pop()
        if len(rows) <= limit or k == depth:
            if len(rows):
                yield rows
            continue
        word = words[starts[rows], k]
        order = np.argsort(word, kind="stable")
        rows, word = rows[order], word[order]
        lo, ends = 0, [*(np.flatnonzero(np.diff(word)) + 1).tolist(), len(rows)]
        for i, hi in enumerate(ends):
            following = ends[i + 1] if i + 1 < len(ends) else hi
            if hi - lo > limit:
                todo.append((rows[lo:hi], k + 1))
                lo = hi
            elif following - lo > limit or hi == len(rows):
                todo.append((rows[lo:hi], depth))
                lo = hi


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order, and the length of the prefix that each shares with the one before (0 for the first): a suffix tree."""
    order = np.lexsort(suffixes.T[::-1])
    ordered = suffixes[order]
    common = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        common[1:] = np.cumprod(ordered[1:] == ordered[:-1], axis=1, dtype=np.int8).sum(axis=1)
    return order, common


def repeats(words: np.ndarray, starts: np.ndarray, docs: np.ndarray, limit: int = SUBTREE_SUFFIXES) -> np.ndarray:
    """Whether a smaller document has the same suffix, for each. words: the first words of all places; starts: those of the suffixes."""
    found = np.zeros(len(docs), dtype=bool)
    for rows in pieces(words, starts, limit):
        order, common = subtree(words[starts[rows]])
        node = np.flatnonzero(common < words.shape[1])  # a deep internal node begins, or a leaf
        who = docs[rows][order]
        least = np.repeat(np.minimum.reduceat(who, node), np.diff(np.append(node, len(who))))
        found[rows[order]] = who > least
    return found


def _minimizers(depth: int, run: int):
    def extract(batch: pa.RecordBatch):
        for w in words(batch["text"]):
            least = mix(_least(runs(w.hash, run), depth - run + 1)) & _EVEN  # least values are small: spread them again
            at, n = _starts(w.first, depth)
            keys, counts = [], np.zeros(w.texts, dtype=np.int64)
            ends = np.cumsum(n)
            values = least[at] if len(at) else np.zeros(0, U)
            for d in np.flatnonzero(n):
                own = np.unique(values[ends[d] - n[d] : ends[d]])
                keys.append(own)
                counts[d] = len(own)
            yield np.concatenate(keys) if keys else np.zeros(0, U), counts, pa.RecordBatch.from_arrays([batch["id"].slice(w.at, w.texts), batch["th"].slice(w.at, w.texts)], ["id", "th"])

    return extract


def _by_row(table: pa.Table, at: np.ndarray, keys: np.ndarray) -> pa.Table:
    rows, first = np.unique(at, return_index=True)
    cuts = np.append(first, len(at))
    out = table.select(["id", "th"]).take(pa.array(rows))
    return out.append_column("keys", pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))


class _Chunk:
    """Suffixes of some rows of a map task."""

    def __init__(self, base: int, slots: int, width: np.uint64, depth: int):
        self.base, self.slots, self.width, self.depth = base, slots, width, depth
        self.data, self.start, self.end, self.hash = [], [], [], []
        self.at, self.anchor, self.hot, self.row, self.doc, self.first, self.meta = [], [], [], [], [], [], []
        self.rows = self.size = self.held = self.bytes = 0

    def add(self, w, batch: pa.RecordBatch, keys: pa.Array, run: int) -> None:
        least = mix(_least(runs(w.hash, run), self.depth - run + 1)) & _EVEN
        at, n = _starts(w.first, self.depth)
        ends = np.cumsum(n)
        ids = batch["id"].slice(w.at, w.texts).to_numpy(zero_copy_only=False)
        for d in np.flatnonzero(n):
            known = np.frombuffer(keys[w.at + int(d)].as_py() or b"", dtype=U)
            here = at[ends[d] - n[d] : ends[d]]
            here = here[np.isin(least[here], known & _EVEN)]
            self.at.append(here + self.size)
            self.anchor.append(least[here])
            self.hot.append(np.isin(least[here] | U(1), known))
            self.row.append(np.full(len(here), self.base + self.rows + d))
            self.doc.append(np.full(len(here), ids[d]))
            self.first.append(np.full(len(here), self.size + w.first[d]))
            self.held += len(here)
        self.data.append(w.data)
        self.start.append(w.start + self.bytes)
        self.end.append(w.end + self.bytes)
        self.hash.append(w.hash)
        self.meta.append(pa.RecordBatch.from_arrays([batch["id"].slice(w.at, w.texts), batch["th"].slice(w.at, w.texts)], ["id", "th"]))
        self.size += len(w.hash)
        self.bytes += len(w.data)
        self.rows += w.texts

    def full(self) -> bool:
        return self.held >= CHUNK_KEYS or self.size >= 4 * CHUNK_KEYS or self.rows >= CHUNK_KEYS // 2

    def wire(self) -> Iterator[tuple]:
        yield from by_block(self.meta, self.base, self.slots)
        if not self.held:
            return
        data, start, end, hashes, at, anchor, hot, who, doc, head = (np.concatenate(x) for x in (self.data, self.start, self.end, self.hash, self.at, self.anchor, self.hot, self.row, self.doc, self.first))
        key = windows(numbers(data, start, end, hashes), at, self.depth)
        order = np.lexsort((at, who, doc, key))
        k, d, r = key[order], doc[order], who[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        least = np.repeat(d[new], np.diff(np.append(np.flatnonzero(new), len(k))))
        late = d > least
        once = np.ones(len(k), dtype=bool)  # of a row's equal suffixes one
        once[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        gone = order[late & once]
        yield from _found(who[gone], at[gone] - head[gone], self.slots)
        keep = np.sort(order[~late & once])
        if not len(keep):
            return
        at, anchor, hot, who, doc, head = at[keep], anchor[keep], hot[keep], who[keep], doc[keep], head[keep]
        # A hot run's suffixes stand alone and go by a hash of all their words, which is the same in every task.
        anchor = np.where(hot, runs(hashes, self.depth)[at], anchor)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        order = np.argsort(anchor[first], kind="stable")
        first, count = first[order], count[order]
        slot = (anchor[first] // self.width).astype(np.int64)
        raw, begin, stop = data.tobytes(), start[at[first]].tolist(), end[at[first] + count + self.depth - 2].tolist()
        cut = np.flatnonzero(np.diff(slot)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(first)], strict=True):
            f = first[lo:hi]
            text = b" ".join([raw[a:b] for a, b in zip(begin[lo:hi], stop[lo:hi], strict=True)])
            yield (int(slot[lo]), 0, ENTRY, text, planes(count[lo:hi].astype(np.int32)), planes(np.concatenate([who[f], doc[f], at[f] - head[f]])))


def _found(who: np.ndarray, places: np.ndarray, slots: int) -> Iterator[tuple]:
    """Places in rows where a repeated suffix begins, by blocks of rows."""
    order = np.argsort(who, kind="stable")
    who, places = who[order], places[order]
    block = who >> BLOCK_BITS
    cut = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(who)], strict=True):
        if hi > lo:
            yield (slots + int(block[lo]), int(block[lo]), ANSWER, planes(who[lo:hi]), planes(places[lo:hi]), b"")


def _segments(entries: pa.Table, depth: int) -> tuple[np.ndarray, ...]:
    """Word numbers of all segments, where each suffix begins in them, its row, its document and its place in the row."""
    texts, starts, who, doc, place, size = [], [], [], [], [], 0
    for a, b, m in zip(entries["a"], entries["b"], entries["meta"], strict=True):
        texts.append(a.as_py())
        c, ids = unplanes(b.as_py(), np.int32).astype(np.int64), unplanes(m.as_py(), np.int64)
        n = len(c)
        inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        starts.append(np.repeat(np.cumsum(c + depth - 1) - (c + depth - 1) + size, c) + inside)
        who.append(np.repeat(ids[:n], c))
        doc.append(np.repeat(ids[n : 2 * n], c))
        place.append(np.repeat(ids[2 * n :], c) + inside)
        size += int((c + depth - 1).sum())
    (w,) = words(pa.array([b" ".join(texts)], pa.large_binary()).cast(pa.large_string()))
    assert len(w.hash) == size
    return numbers(w.data, w.start, w.end, w.hash), *map(np.concatenate, (starts, who, doc, place))


def _repeated_suffixes(candidates: DataFrame, slots: int, depth: int, run: int) -> DataFrame:
    """Places of the suffixes of a row that a smaller document has; of a row's equal ones the first."""
    width = np.uint64((1 << 64) // slots + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            chunk = _Chunk(TaskContext.get().partitionId() << 33, slots, width, depth)
            for batch in batches:
                for w in words(batch["text"]):
                    chunk.add(w, batch, batch["keys"], run)
                    if chunk.full():
                        yield from chunk.wire()
                        chunk = _Chunk(next_block(chunk.base + chunk.rows), slots, width, depth)
            if chunk.rows:
                yield from chunk.wire()

        return _batches(rows())

    def meet(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        passed = table.filter(pa.array(kind != ENTRY)).to_batches()
        entries = table.filter(pa.array(kind == ENTRY))
        out = []
        if entries.num_rows:
            number, starts, who, doc, place = _segments(entries, depth)
            late = repeats(np.lib.stride_tricks.sliding_window_view(number, depth), starts, doc)
            out = list(_batches(_found(who[late], place[late], slots)))
        return pa.Table.from_batches([*passed, *out], schema=_WIRE)

    def gather(table: pa.Table) -> pa.Table:
        ids, metas, owner, places = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, m, kind in zip(table["a"], table["b"], table["meta"], table["kind"].to_pylist(), strict=True):
            x = unplanes(a.as_py(), np.int64)
            if kind == ROWS:
                ids.append(x)
                metas.append(pa.ipc.open_stream(m.as_py()).read_all())
            else:
                owner.append(x)
                places.append(unplanes(b.as_py(), np.int64))
        ids, owner, places = np.concatenate(ids), np.concatenate(owner), np.concatenate(places)
        rows, by = pa.concat_tables(metas), np.argsort(ids, kind="stable")
        at = np.searchsorted(ids[by], owner)
        order = np.argsort(at, kind="stable")
        return _by_row(rows.take(pa.array(by)), at[order], places[order])

    return candidates.mapInArrow(spread, _WIRE_DDL).groupBy("slot").applyInArrow(meet, _WIRE_DDL).groupBy("block").applyInArrow(gather, "id long, th binary, keys binary")


_PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))


def _kept(depth: int, with_text: bool):
    """Rows with what stays of their words; keys are places of suffixes to remove, with all that equal them, null for none."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w in words(batch["text"]):
                raw, start, end, first = w.data.tobytes(), w.start.tolist(), w.end.tolist(), w.first.tolist()
                number = None
                for d in range(w.texts):
                    a, b = first[d], first[d + 1]
                    blob, gone, passages = batch["keys"][w.at + d].as_py(), 0, []
                    stay = range(a, b)
                    if blob:
                        number = numbers(w.data, w.start, w.end, w.hash) if number is None else number
                        name = windows(number[a:b], np.arange(b - a - depth + 1), depth)
                        hit = np.flatnonzero(np.isin(name, name[np.frombuffer(blob, dtype=np.int64)]))
                        step = np.zeros(b - a + 1, dtype=np.int64)
                        step[hit] += 1
                        step[hit + depth] -= 1
                        covered = np.cumsum(step[:-1]) > 0
                        gone = int(covered.sum())
                        stay = (np.flatnonzero(~covered) + a).tolist()
                        edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                        passages = [{"first_word": x, "n_words": y - x} for x, y in edge.reshape(-1, 2).tolist()]
                    kept = b" ".join([raw[start[i] : end[i]] for i in stay])
                    out.append((b - a, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, passages))
            n, gone, sha, text, passages = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(passages, _PASSAGES)], ["id", "th", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "passages"])

    return cover


def substring_dedup(documents: DataFrame, depth: int = DEPTH, run: int = RUN, with_text: bool = True) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by one space; null without with_text), passages (first_word, n_words) that go."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.unhex(F.md5("text")).alias("th"))
    slots = task_count(spark, documents)
    anchors = repeated_keys(docs.select("id", "th", "text"), _minimizers(depth, run), _by_row, "id long, th binary, keys binary", slots, HOT_ROWS)
    anchors = scratch.table(anchors.dropDuplicates(["id", "th"]), "anchors")
    candidates = scratch.table(docs.join(anchors.hint("shuffle_merge"), ["id", "th"]).select("doc_id", "id", "th", "text", "keys"), "candidates")
    found = scratch.table(_repeated_suffixes(candidates, slots, depth, run).dropDuplicates(["id", "th"]), "suffixes")
    scratch.drop(anchors)
    schema = "id long, th binary, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, passages array<struct<first_word:long,n_words:long>>"
    changed = candidates.drop("keys").join(found.hint("shuffle_merge"), ["id", "th"]).mapInArrow(_kept(depth, with_text), schema)
    rest = docs.withColumn("keys", F.lit(None).cast("binary")).mapInArrow(_kept(depth, with_text), schema)
    rest = rest.join(found.select("id", "th").hint("shuffle_merge"), ["id", "th"], "left_anti")
    return changed.unionByName(rest).drop("id", "th")
