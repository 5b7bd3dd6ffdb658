"""Token counts of texts, as a sentencepiece BPE model with byte fallback gives them.

Method: heap and linked list. The characters of a piece of text are a linked list; a heap holds
adjacent pairs that are in the vocabulary by rank (score, then place). The lowest is popped and
merged, its new neighbours are pushed, stale entries are skipped. The count is the symbols at first
less the merges (a character outside the vocabulary counts as its UTF-8 bytes); no ids are made.

Two characters that stand side by side in no piece of the vocabulary are never merged over, so a text
is cut between them: at word marks (that no piece has one after another character is asserted) and
within words. Parts are counted apart and remembered, a bounded number of them.

Cases: null is empty text and has no tokens; special strings are ordinary text; repeated rows are
counted again; other columns of the input stay out; a very long word takes n log n steps.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
LIMIT = 4096
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 700_000


class Vocabulary:
    """Ranks of a model's pieces; counts the tokens of texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a piece spans several words: words can't be counted apart")
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        # Control characters that are in no longer piece stand alone: a text can be cut at them.
        self.lone = [c for c in "\n\r\t" if c not in joined]
        cut = "".join(self.lone)
        self.words = re.compile(f"[{re.escape(cut)}]|{MARK}+[^{MARK}{re.escape(cut)}]*|[^{MARK}{re.escape(cut)}]+" if cut else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for word, n in Counter(self.words.findall(MARK + text.replace(" ", MARK))).items():
            size = known.get(word)
            if size is None:
                size = self.parts(word)
            total += n * size
        return total

    def parts(self, word: str) -> int:
        """A word that is not remembered, by its parts."""
        known, beside, total, at = self.known, self.beside, 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in beside:
                part = word[at:i]
                size = known.get(part)
                if size is None:
                    size = self.word(part)
                    self._remember(part, size)
                total += size
                at = i
        self._remember(word, total)
        return total

    def _remember(self, part: str, size: int) -> None:
        if len(part) < 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = size

    def word(self, word: str) -> int:
        rank = self.rank
        n = len(word)
        symbol: list[str] = list(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := word[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            if not symbol[left] or right < 0 or len(symbol[left]) + len(symbol[right]) != len(pair):
                continue
            symbol[left], symbol[right] = pair, ""
            merges += 1
            after[left] = onward = after[right]
            if onward >= 0:
                before[onward] = left
                if (p := pair + symbol[onward]) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
            back = before[left]
            if back >= 0 and (p := symbol[back] + pair) in rank:
                heapq.heappush(heap, (rank[p], back, p))
        return n - merges + sum(len(s.encode()) - 1 for s in symbol if len(s) == 1 and s not in rank)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(documents: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_bytes, n_tokens, over_limit. model_path must be on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            size = [len(t.encode()) if t else 0 for t in texts]
            tokens = [vocabulary(model_path).text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
