"""Language identification against a plain version, and on texts that it has not seen."""

import math
import pickle
import random
import re
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemark.llm import language_id, op5_queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W\d_]+")


def _grams(word, n):
    word = f"^{word}$" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _plain(labelled, texts):
    """Word-first backoff, said once more with dictionaries."""
    languages = sorted({lang for _, lang in labelled})
    words, grams = {x: Counter() for x in languages}, {x: Counter() for x in languages}
    for text, lang in labelled:
        for w in WORD.findall(text or ""):
            words[lang][w.lower()] += 1
            for n in range(1, 6):
                grams[lang].update(_grams(w.lower(), n))
    all_words, all_grams = {w for c in words.values() for w in c}, {g for c in grams.values() for g in c}
    size = {x: (sum(words[x].values()) + 0.5 * len(all_words), sum(grams[x].values()) + 0.5 * len(all_grams)) for x in languages}
    out = []
    for text in texts:
        found = [w.lower() for w in WORD.findall(text or "")]
        if not any(map(str.isalpha, "".join(found))):
            out.append(("und", 0.0))
            continue
        sums = dict.fromkeys(languages, 0.0)
        for w in found:
            if w in all_words:
                for x in languages:
                    sums[x] += math.log((words[x][w] + 0.5) / size[x][0])
                continue
            if not any(map(str.isalpha, w)):
                continue
            for n in range(5, 0, -1):
                known = [g for g in _grams(w, n) if g in all_grams]
                if known:
                    for x in languages:
                        sums[x] += sum(math.log((grams[x][g] + 0.5) / size[x][1]) for g in known) / len(known)
                    break
        top = max(sums.values())
        odds = {x: math.exp(v - top) for x, v in sums.items()}
        best = min(languages, key=lambda x: (-sums[x], x))
        out.append((best, odds[best] / sum(odds.values())))
    return out


def _labelled():
    rng = random.Random(9)
    stems = {"en": ["the", "house", "walking", "dogs", "and"], "de": ["das", "haus", "gehend", "hunde", "und"], "fr": ["la", "maison", "été", "chiens", "et"]}
    return [(" ".join(rng.choice(stems[x]) for _ in range(rng.randint(1, 9))), x) for x in ["en", "de", "fr"] * 12] + [(None, "en"), ("", "fr"), ("Straße ẞ ʼn Ⅷ ² 12", "de")]


TEXTS = ["the dog", "die Katze", "hundehaus", "chienne", None, "", "123 !?", "ẞ", "²", "Ⅷ² the", "qqq", "été ÉTÉ", "x" * 300, "漢字漢字", "a_b-c3d", "the das", "haus " * 5000 + "the" * 40_000]


def test_against_a_plain_version(spark, monkeypatch):
    rows = [(i, t, x) for i, (t, x) in enumerate(_labelled())]
    labelled = spark.createDataFrame([*rows, (900, "zug", None), (None, "zug", "de")], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    want = _plain(_labelled(), TEXTS)
    for piece, at_once, remembered in ((1 << 20, 1 << 18, 4 << 20), (7, 3, 10)):
        monkeypatch.setattr(language_id, "PIECE", piece)
        monkeypatch.setattr(language_id, "AT_ONCE", at_once)
        monkeypatch.setattr(language_id, "REMEMBERED", remembered)
        got = language_id.Reader(model).predict(TEXTS)
        assert [x for x, _ in got] == [x for x, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, lang_pred string, score int")
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert found.count() == 2 * len(TEXTS) and [by_id[i][0] for i in range(len(TEXTS))] == [x for x, _ in want]
    assert language_id.predict(docs.where("false"), model).isEmpty()


def test_equal_sums_go_to_the_first_name(spark):
    model = language_id.train(spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string"))
    assert model.predict("same") == ("a", 0.5) and model.predict("unlike")[0] == "a"


def test_nothing_learned(spark):
    none = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.predict("text") == ("und", 0.0)
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(docs, none).collect()] == ["und", "und"]


def test_language_of_few_rows(spark):
    rows = [(i, f"common{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} the of and", "en") for i in range(3000)] + [(5000 + i, "zug zwölf wälder", "xx") for i in range(5)] + [(9000, None, "xx")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for few in (language_id.train(labelled, max_rows=20), language_id.train(labelled, max_bytes=400)):
        assert few.languages == ["en", "xx"] and few.predict("zwölf")[0] == "xx" and few.predict("the")[0] == "en"
        assert len(few.words) <= 3 + 3 + 60  # about 20 rows of the large language
    whole = language_id.train(labelled)
    assert len(whole.words) == 26 * 26 + 6  # every word of the sample


def test_a_worker_holds_the_model_in_few_bytes(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40_000)] + ["é", "ß", "漢字"]
    labelled = spark.createDataFrame([(i, " ".join(names[i::50]), "en" if i % 2 else "de") for i in range(50)], "doc_id long, text string, lang string")
    sent = pickle.dumps(language_id.train(labelled))
    tracemalloc.start()
    model = pickle.loads(sent)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 60 * (len(model.words) + len(model.grams))  # 16 of them scores
    assert len({model.words.get(w) for w in set(names)}) == len(set(names)) == len(model.words)
    assert model.words.get("") is model.words.get("abc") is model.grams.get("\udc80") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = op5_queries.QUERIES["op5_language_id"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == docs.count()
    met = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = met.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n >= 0.97
    # What is held out teaches nothing.
    spoiled = docs.withColumn("lang", F.when(op5_queries.fold() == 0, "zz").otherwise(F.col("lang")))
    assert "zz" not in op5_queries.learn(spoiled).languages
    ids = {r["doc_id"]: r["held_out"] for r in found.collect()}
    import zlib

    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, held in ids.items())
