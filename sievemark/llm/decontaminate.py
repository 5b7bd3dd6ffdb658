"""Benchmark decontamination: which documents hold which test items.

Method: the test items are a BM25 inverted index, searched by block-max WAND; every passage of every document is
a query. An item's score is divided by its score against itself, so a passage with all its
words scores 1, and all items of `least_score` or more are retrieved, however many. Block bounds come first, for a whole batch of passages at
once: what frequent terms can give at most in a block, and the block maxima of the others; where frequent terms alone can reach the
threshold, theirs too. Blocks that can't reach it are skipped, and with them most passages. In the others a search keeps a
cursor in the posting list of each of the passage's terms. The pivot is the first item that the maxima of the lists up to it can lift to the
threshold; cursors behind it skip to it, and it is scored once all are there.
A retrieved item is then verified: enough of the n-grams of its question and of its answer must be in the
document near the passage.

Items are grouped by length. Passages are windows of twice the most words that a group's items can have and overlap by that, so each
occurrence is whole in one, and a long item makes no passages long but its group's. All groups are searched in one pass over the
documents. Up to `shard_items` items and SHARD_BYTES of text are broadcast at once; a larger benchmark takes more passes,
with statistics over all items.

Cases: null or empty texts match nothing, as do items without words; equal items are all reported; repeated
documents are reported each; other columns stay out; an empty table gives no rows; a long text is
cut into passages, never shortened.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.memory import give_back
from sievemark.llm.scratch import Scratch
from sievemark.llm.wordhash import SPACE_AND_MARKS, U, runs, words

LEAST_SCORE, LEAST_OVERLAP, GRAM = 0.6, 0.7, 5
K1, B = 1.2, 0.75
SHARD_ITEMS, SHARD_BYTES, BLOCK_ITEMS = 20_000, 16 << 20, 8
#: Words that items of the first group have at most, and how many times as many each further group's.
SHORT, LONGER = 64, 2
#: Terms in more than this share of a shard's items are bounded together.
FREQUENT = 0.1
#: Block maxima that are summed at once, in whole passages; rows that are returned at once.
BOUNDS, ROWS = 1 << 18, 1024
_ANSWER = re.compile(r"(?is)\A(.*?\S)\s*(?:\banswer\s*:|\ba\s*:|\?\s+)\s*(\S.*)\Z")
_SENTENCE = re.compile(r"(?s)\A(.*[.!?])\s+(\S.*)\Z")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: at an answer mark or question mark, else before its last sentence, else its last quarter of words."""
    found = _ANSWER.match(text) or _SENTENCE.match(text.rstrip())
    if found and len(found[2].split()) >= 3:
        return found[1], found[2]
    parts = text.split()
    cut = max(1, len(parts) - max(1, len(parts) // 4))
    return " ".join(parts[:cut]), " ".join(parts[cut:]) or text


def _terms(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for w in words(pa.array(texts, pa.string()), fold=True, gaps=SPACE_AND_MARKS):
        out += [w.hash[w.first[d] : w.first[d + 1]] for d in range(w.texts)]
    return out


def _grams(terms: np.ndarray, n: int) -> np.ndarray:
    return np.unique(runs(terms, min(n, len(terms)))) if len(terms) else np.zeros(0, U)


@dataclass
class Statistics:
    """Over all items: terms in order, how many items have each, items, and their mean words."""

    term: np.ndarray
    items: np.ndarray
    total: int
    mean: float

    @staticmethod
    def of(terms: list[np.ndarray]) -> Statistics:
        names, n = np.unique(np.concatenate([np.unique(t) for t in terms]) if terms else np.zeros(0, U), return_counts=True)
        return Statistics(names, n, len(terms), max(1.0, float(np.mean([len(t) for t in terms])) if terms else 1.0))


@dataclass
class Index:
    """Postings by term in the order of items; `impact` is a share of the item's own score."""

    ids: list
    vocabulary: np.ndarray
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # by term
    frequent: np.ndarray  # by term
    block_first: np.ndarray  # by term, into block and block_top
    block: np.ndarray
    block_top: np.ndarray
    base: np.ndarray  # by block: what frequent terms give at most
    longest: int  # words that an item can have
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    sizes: list[tuple[int, int]]
    lists: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def build(ids: list, texts: list[str], statistics: Statistics | None = None, longest: int = 0, gram: int = GRAM) -> Index:
        terms = _terms(texts)
        whole = statistics or Statistics.of(terms)
        term, item, impact = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, own in enumerate(terms):
            if not len(own):
                continue
            names, tf = np.unique(own, return_counts=True)
            df = whole.items[np.searchsorted(whole.term, names)]
            score = np.log1p((whole.total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / whole.mean))
            term.append(names)
            item.append(np.full(len(names), i))
            impact.append(score / score.sum())
        term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        vocabulary, first = np.unique(term, return_index=True)
        ends = np.append(first, len(term))
        many = np.diff(ends) > max(2, FREQUENT * len(texts))
        top = np.maximum.reduceat(impact, first) if len(first) else impact
        number = np.repeat(np.arange(len(vocabulary)), np.diff(ends))
        rare = ~many[number]
        key = number * (1 << 32) + item // BLOCK_ITEMS
        keys, at = np.unique(key, return_index=True)
        blocks = -(-len(texts) // BLOCK_ITEMS)
        own = np.bincount(item[~rare], impact[~rare], minlength=blocks * BLOCK_ITEMS)
        parts = [question_and_answer(t) for t in texts]
        questions, answers = _terms([q for q, _ in parts]), _terms([a for _, a in parts])
        return Index(
            ids, vocabulary, ends, item, impact, top, many,
            np.searchsorted(keys, np.arange(len(vocabulary) + 1) * (1 << 32)), keys % (1 << 32), np.maximum.reduceat(impact, at) if len(at) else np.zeros(0),
            own.reshape(-1, BLOCK_ITEMS).max(axis=1) if blocks else own, longest or max((len(t) for t in terms), default=0),
            [_grams(q, gram) for q in questions], [_grams(a, gram) for a in answers], [(min(gram, len(q)), min(gram, len(a))) for q, a in zip(questions, answers, strict=True)],
        )

    @staticmethod
    def groups(ids: list, texts: list[str], statistics: Statistics | None = None) -> list[Index]:
        """An index for each group of items by length; items without words are in none."""
        terms = _terms(texts)
        statistics = statistics or Statistics.of(terms)
        by: dict[int, list[int]] = {}
        for i, own in enumerate(terms):
            if len(own):
                size = SHORT
                while len(own) > size:
                    size *= LONGER
                by.setdefault(size, []).append(i)
        return [Index.build([ids[i] for i in own], [texts[i] for i in own], statistics, size) for size, own in sorted(by.items())]

    def bounds(self, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose bound reaches least, from distinct (passage, term) in order."""
        heavy = self.base >= least - 1e-9  # frequent terms count one by one here, and in other blocks as base
        keep = heavy[self.block] | ~np.repeat(self.frequent, np.diff(self.block_first))
        first = np.concatenate([[0], np.cumsum(keep)])[self.block_first]
        block, top, base = self.block[keep], self.block_top[keep], np.where(heavy, 0.0, self.base)
        n = first[term + 1] - first[term]
        some = n > 0
        passage, term, n = passage[some], term[some], n[some]
        if not len(passage):
            return passage, passage
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        part = (np.cumsum(n) - n)[starts] // BOUNDS
        cuts = [*starts[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(passage)]
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            m = n[lo:hi]
            at = np.repeat(first[term[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            key = np.repeat(passage[lo:hi], m) * len(base) + block[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            total = np.add.reduceat(top[at][order], cut)
            key = key[cut]
            found.append(key[total + base[key % len(base)] >= least - 1e-9])
        key = np.concatenate(found)
        return key // len(base), key % len(base)

    def _in_blocks(self, t: int) -> dict[int, tuple[list[int], list[float], float]]:
        """A term's postings by block, with their maxima; made once a worker, for the terms that are asked for."""
        found = self.lists.get(t)
        if found is None:
            found, items, impacts = {}, self.item[self.first[t] : self.first[t + 1]].tolist(), self.impact[self.first[t] : self.first[t + 1]].tolist()
            lo = 0
            for k, top in zip(self.block[self.block_first[t] : self.block_first[t + 1]].tolist(), self.block_top[self.block_first[t] : self.block_first[t + 1]].tolist(), strict=True):
                hi = bisect_left(items, (k + 1) * BLOCK_ITEMS, lo)
                found[k] = (items[lo:hi], impacts[lo:hi], top)
                lo = hi
            self.lists[t] = found
        return found

    def search(self, terms: np.ndarray, blocks: np.ndarray, least: float) -> dict[int, float]:
        """Block-max WAND: items whose score reaches least, in the blocks whose bound does; terms are distinct."""
        least -= 1e-9
        own = [self._in_blocks(t) for t in terms.tolist()]
        found: dict[int, float] = {}
        for block in blocks.tolist():
            lists = [x for o in own if (x := o.get(block))]
            # A cursor: the item it stands at, its list, its place there.
            cursors = sorted((x[0][0], k, 0) for k, x in enumerate(lists))
            while cursors:
                total, pivot = 0.0, -1
                for j, (_, k, _) in enumerate(cursors):
                    total += lists[k][2]
                    if total >= least:
                        pivot = j
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0]
                while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                    pivot += 1
                if cursors[0][0] == item:  # all that the pivot needs are there
                    score = sum(lists[k][1][at] for _, k, at in cursors[: pivot + 1])
                    if score >= least:
                        found[item] = score
                    item += 1
                ahead = []
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        items = lists[c[1]][0]
                        at = bisect_left(items, item, c[2])
                        if at == len(items):
                            continue
                        c = (items[at], c[1], at)
                    ahead.append(c)
                cursors = sorted(ahead + cursors[pivot + 1 :])
        return found

    def overlaps(self, item: int, near: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams that are among these words."""
        out = []
        for own, n in ((self.questions[item], self.sizes[item][0]), (self.answers[item], self.sizes[item][1])):
            out.append(float(np.isin(own, runs(near, n)).mean()) if len(own) and n else 1.0)
        return out[0], out[1]


@dataclass
class Shard:
    """The groups of some items, and for each of all their terms its number in every group (or -1)."""

    groups: list[Index]
    vocabulary: np.ndarray
    numbers: list[np.ndarray]

    @staticmethod
    def of(ids: list, texts: list[str], statistics: Statistics | None = None) -> Shard:
        groups = Index.groups(ids, texts, statistics)
        vocabulary = np.unique(np.concatenate([g.vocabulary for g in groups])) if groups else np.zeros(0, U)
        numbers = []
        for g in groups:
            number = np.full(len(vocabulary), -1)
            number[np.searchsorted(vocabulary, g.vocabulary)] = np.arange(len(g.vocabulary))
            numbers.append(number)
        return Shard(groups, vocabulary, numbers)


def _passages(index: Index, w, place: np.ndarray, term: np.ndarray, least_score: float, least_overlap: float) -> Iterator[tuple]:
    """(text, item, what is found) of an index in a slice's words; term: numbers of the words at these places."""
    step = index.longest
    owner = np.searchsorted(w.first, place, side="right") - 1
    # A passage is the words of two steps; numbers grow over the slice's texts.
    steps = -(-np.diff(w.first) // step)
    base = np.concatenate([[0], np.cumsum(steps + 1)])
    number = base[owner] + (place - w.first[owner]) // step + 1
    key = np.unique(np.concatenate([number, number - 1]) * len(index.vocabulary) + np.concatenate([term, term]))
    passage, term = key // len(index.vocabulary), key % len(index.vocabulary)
    best: dict[tuple[int, int], tuple] = {}
    who, block = index.bounds(passage, term, least_score)
    for p in np.unique(who).tolist():
        found = index.search(term[slice(*np.searchsorted(passage, [p, p + 1]))], block[slice(*np.searchsorted(who, [p, p + 1]))], least_score)
        if not found:
            continue
        d = int(np.searchsorted(base, p, side="right")) - 1
        a = w.first[d] + max(0, (p - base[d] - 1) * step)
        b = min(w.first[d + 1], w.first[d] + (p - base[d] + 1) * step)
        near = w.hash[max(w.first[d], a - index.longest) : min(w.first[d + 1], b + index.longest)]
        for i, score in found.items():
            question, answer = index.overlaps(i, near)
            new = (min(question, answer), round(score, 9), question, answer, int(a - w.first[d]), int(b - a))  # the order of a sum does not decide
            if (d, i) not in best or best[d, i] < new:
                best[d, i] = new
    yield from ((d, index.ids[i], x) for (d, i), x in best.items() if x[0] >= least_overlap)


def _find(shared, least_score: float, least_overlap: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = shared.value
        for batch in batches:
            rows = []
            for w in words(batch["text"], fold=True, gaps=SPACE_AND_MARKS):
                if not len(w.hash) or not shard.groups:
                    continue
                at = np.searchsorted(shard.vocabulary, w.hash)
                at[at == len(shard.vocabulary)] = 0
                hit = np.flatnonzero(shard.vocabulary[at] == w.hash)
                for index, number in zip(shard.groups, shard.numbers, strict=True):
                    term = number[at[hit]]
                    own = term >= 0
                    if own.any():
                        rows += [(w.at + d, i, x) for d, i, x in _passages(index, w, hit[own], term[own], least_score, least_overlap)]
            rows.sort(key=lambda r: (r[0], r[1]))
            cols = [[x[k] for _, _, x in rows] for k in range(1, 6)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array([d for d, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "n_words"],
            )

    return find


def _shards(benchmark: DataFrame, shard_items: int) -> Iterator[Shard]:
    """All items, in parts that are small enough to be broadcast."""
    items = benchmark.where("text is not null").selectExpr("cast(item_id as long) as item_id", "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // shard_items), -(-(size["bytes"] or 0) // SHARD_BYTES))
    if shards == 1:
        rows = items.orderBy("item_id", "text").collect()
        yield Shard.of([r[0] for r in rows], [r[1] for r in rows])
        return
    shards *= 2  # hashing fills shards unevenly

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, terms in zip(batch["shard"].to_pylist(), _terms(batch["text"].to_pylist()), strict=True):
                names = np.unique(terms).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), shard)), pa.array(names), pa.array(np.full(len(names), len(terms) / max(1, len(names))))], ["shard", "term", "words"])

    scratch = Scratch(benchmark.sparkSession, "decontaminate")
    numbered = scratch.table(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    each = scratch.table(numbered.select("shard", "text").mapInArrow(count, "shard long, term long, words double"), "terms")
    mean = max(1.0, (each.agg(F.sum("words")).first()[0] or 0.0) / size["n"])
    documents = scratch.table(each.groupBy("term").agg(F.count("*").alias("df")), "counts")
    for shard in range(shards):
        rows = numbered.where(F.col("shard") == shard).orderBy("item_id", "text").collect()
        if rows:
            own = each.where(F.col("shard") == shard).select("term").distinct().join(documents.hint("shuffle_merge"), "term").collect()
            own = sorted((r[0] & ((1 << 64) - 1), r[1]) for r in own)
            statistics = Statistics(np.array([t for t, _ in own], dtype=U), np.array([n for _, n in own]), size["n"], mean)
            yield Shard.of([r[0] for r in rows], [r[1] for r in rows], statistics)
    scratch.close()


def contaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word, n_words): items of benchmark(item_id, text) in documents(doc_id, text), the best passage of each."""
    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, n_words long"
    out = None
    for shard in _shards(benchmark, shard_items):
        shared = documents.sparkSession.sparkContext.broadcast(shard)
        part = docs.mapInArrow(_find(shared, least_score, least_overlap), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.where("false").selectExpr("doc_id", "doc_id as item_id", "0D as score", "0D as question_overlap", "0D as answer_overlap", "0L as first_word", "0L as n_words")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """documents without the rows that hold a test item, with all columns; nothing is shuffled. Between the passes of a large benchmark rows are written."""
    out, scratch = None, None
    for shard in _shards(benchmark, shard_items):
        if out is not None:
            scratch = scratch or Scratch(documents.sparkSession, "decontaminated")
            out = scratch.table(out, "clean")
        find = _find(documents.sparkSession.sparkContext.broadcast(shard), least_score, least_overlap)

        def clean(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS)):
                    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part["text"]], ["doc_id", "text"])
                    hit = {x for b in find(iter([rows])) for x in b["doc_id"].to_pylist()}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))
                batch = part = rows = None
                give_back()

        out = (documents if out is None else out).mapInArrow(clean, documents.schema)
    return documents if out is None else out
