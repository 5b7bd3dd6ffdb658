"""Language identification by words first.

Method: word-first backoff. A word seen in training scores its log frequency in each language. Any
other word scores by its character n-grams, the longest of which some are known, each by its log
frequency; shorter ones are asked only if no longer one is known. A text's language has
the largest sum over its words, and `score` is that language's posterior.

Training counts words of labelled rows in Spark. The sample is bounded for each language: its rows whose id hash
falls under the smaller of max_rows / its labelled rows and max_bytes / its labelled bytes, so a language of fewer
rows and bytes has all of them read, however rare it is. Every word and n-gram of the sample is in the model,
which is as large as the sample at most: that bounds what is collected and broadcast.

Words are runs of letters, lower-cased one by one. In a task each distinct word gets a row of scores once,
and a text's sum is taken over its words' rows; long texts are summed piece by piece. Every worker holds a model, so its
words and n-grams are packed bytes, not objects; of a batch a few texts at a time are made into strings.

Cases: null text and text without a letter give `und` and score 0, as does every text when nothing was
learned; equal sums go to the first language by name; rows with null lang or doc_id teach nothing, a null doc_id is
not held out; repeated rows count each time; other columns pass through (lang_pred and score
are replaced); a text or word of any length is read whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.llm.memory import give_back

UND = "und"
#: Rows of a language, and bytes of their texts, that are learned from.
MAX_ROWS, MAX_BYTES = 4_000, 16 << 20
LONGEST = 5
#: Added to counts; characters of unseen words that a worker remembers before it starts afresh; characters, words and texts that are handled at once.
SMOOTH, REMEMBERED, PIECE, AT_ONCE, TEXTS = 0.5, 1 << 20, 1 << 19, 1 << 17, 512
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


def pieces(text: str) -> Iterator[str]:
    """The text in parts that end where no word goes on."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def split(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def grams(word: str, n: int) -> Iterator[str]:
    """Character n-grams; a word's borders count as characters from two on."""
    padded = f"^{word}$" if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


class Packed:
    """Distinct strings, numbered, in little more than their bytes (a dict takes ten times as many): those of one checksum's bucket stand together."""

    def __init__(self, names: pa.Array):
        encoded = names.cast(pa.large_binary()).to_pylist()
        self.mask = (1 << max(0, len(encoded) - 1).bit_length()) - 1
        bucket = np.fromiter((crc32(x) & self.mask for x in encoded), np.int64, len(encoded))
        order = np.argsort(bucket, kind="stable")
        self.blob = b"".join([encoded[i] for i in order.tolist()])
        self.cuts, self.first = (array("Q" if at[-1] >> 32 else "I", at.tolist()) for at in (
            np.cumsum([0, *(len(encoded[i]) for i in order.tolist())]), np.searchsorted(bucket[order], np.arange(self.mask + 2)),
        ))
        #: Of each of names the number.
        self.numbers = np.empty(len(order), dtype=np.int64)
        self.numbers[order] = np.arange(len(order))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"numbers": None}  # only needed to fill tables

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def get(self, name: str) -> int | None:
        x = name.encode("utf-8", "surrogatepass")
        at, cuts = crc32(x) & self.mask, self.cuts
        for i in range(self.first[at], self.first[at + 1]):
            if self.blob[cuts[i] : cuts[i + 1]] == x:
                return i
        return None


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, languages: list[str], words: Packed, grams: Packed, table: np.ndarray, gram_table: np.ndarray, longest: int = LONGEST):
        self.languages, self.words, self.grams, self.table, self.gram_table, self.longest = languages, words, grams, table, gram_table, longest

    def word(self, word: str) -> np.ndarray:
        """Scores of a lower-case word."""
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        for n in range(self.longest, 0, -1):
            total, some, held = np.zeros(len(self.languages)), 0, []
            for g in grams(word, n):
                if (at := self.grams.get(g)) is not None:
                    held.append(at)
                    if len(held) == AT_ONCE:
                        total, some, held = total + self.gram_table[held].sum(axis=0), some + len(held), []
            if some + len(held):
                return (total + self.gram_table[held].sum(axis=0)) / (some + len(held))
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        return Reader(self).predict([text])[0]


class _Places(dict):
    """Words as they stand in texts to rows of a table that grows by each word when it is first met; row 0 has no letter in it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.chars, self.n = model, 0, 1
        self.scores = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        self.chars += len(word)
        at = 0
        if word.isalpha() or any(map(str.isalpha, word)):
            if self.n == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            at, self.n = self.n, self.n + 1
            self.scores[at] = self.model.word(word.lower())
        self[word] = at
        return at


class Reader:
    """Predicts for many texts and remembers the words met."""

    def __init__(self, model: Model):
        self.model, self.places = model, _Places(model)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        names = self.model.languages
        total, lettered = np.zeros((len(texts), len(names))), np.zeros(len(texts), dtype=bool)
        places, starts, owner = [], [], []

        def settle() -> None:
            if places:
                at, to = np.array(places), np.array(owner)
                np.add.at(total, to, np.add.reduceat(self.places.scores[at], starts))
                np.logical_or.at(lettered, to, np.maximum.reduceat(at, starts) > 0)
            places.clear()
            starts.clear()
            owner.clear()
            if self.places.chars > REMEMBERED:
                self.places = _Places(self.model)

        for d, text in enumerate(texts if names else []):
            for piece in pieces(text) if text else ():
                if found := _WORD.findall(piece):
                    starts.append(len(places))
                    owner.append(d)
                    places.extend(map(self.places.__getitem__, found))
                    if len(places) > AT_ONCE or self.places.chars > REMEMBERED:
                        settle()
        settle()
        if not names:
            return [(UND, 0.0)] * len(texts)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        return [(names[b], s) if ok else (UND, 0.0) for b, s, ok in zip(best.tolist(), score.tolist(), lettered.tolist(), strict=True)]


def _logs(counts: np.ndarray) -> np.ndarray:
    table = counts + SMOOTH
    return np.log(table / table.sum(axis=0)) if len(table) else table


def _count(longest: int):
    """Words (kind 0) and n-grams (kind 1) by language, for each task."""

    def rows(lang: str, kind: int, found: Counter) -> Iterator[pa.RecordBatch]:
        names, n = list(found), list(found.values())
        for a in range(0, len(names), 50_000):
            part = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array(n[a : a + 50_000], pa.int64())], ["lang", "kind", "item", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = seen.setdefault(lang, Counter())
                for piece in pieces(text or ""):
                    own.update(split(piece))
            for lang in list(seen):
                found, parts = seen.pop(lang), Counter()
                for w, n in found.items():
                    for k in range(1, longest + 1):
                        for g in grams(w, k):
                            parts[g] += n
                yield from rows(lang, 0, found)
                yield from rows(lang, 1, parts)
            batch = found = parts = None
            give_back()

    return count


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, longest: int = LONGEST) -> Model:
    """Learns from labelled(doc_id, text, lang)."""
    labelled = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(max_rows) / F.count("*"), F.coalesce(F.try_divide(F.lit(max_bytes), F.sum(F.octet_length("text"))), F.lit(1.0))).alias("share"))
    sample = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))  # a row a language
    counts = sample.select("lang", "text").mapInArrow(_count(longest), "lang string, kind int, item string, n long")
    found = counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(found["lang"].unique().to_pylist())
    place = {x: i for i, x in enumerate(languages)}
    models = []
    for kind in (0, 1):
        own = found.filter(pa.compute.equal(found["kind"], kind))
        names = own["item"].unique()
        packed = Packed(names)
        table = np.zeros((len(names), len(languages)))
        table[packed.numbers[pa.compute.index_in(own["item"], names).to_numpy()], [place[x] for x in own["lang"].to_pylist()]] = own["n"].to_numpy()
        models.append((packed, _logs(table)))
    (words, table), (parts, gram_table) = models
    found = own = names = None
    give_back()
    return Model(languages, words, parts, table, gram_table, longest)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and score added; only `text` is read for them."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as the training sample at most
    documents = documents.drop("lang_pred", "score")
    names = documents.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or Reader(shared.value)
            for part in (batch.slice(a, TEXTS) for a in range(0, batch.num_rows, TEXTS)):
                found = reader.predict(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "score"])
            batch = part = None
            give_back()

    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(add, schema)
