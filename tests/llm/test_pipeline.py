"""The pipeline's stages on the smallest tables, and run() against a plain version of all five."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import test_documents as D
from tests.llm import test_language as N
from tests.test_oracles import _plain, duck  # noqa: F401

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    counts = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        assert name == "mixing" or docs.columns == first
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}


def test_run_matches_sql(spark, duck):  # noqa: F811
    out = pipeline.run(spark, SF)
    columns = sorted(out.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in out.collect())
    found = duck.execute(pipeline.ORACLE_SQL)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()) and len(got) > 50


def _corpus():
    """Four languages of own words, near and exact copies, a benchmark item in some, credentials in others, and odd rows."""
    rng = random.Random(77)
    stems = {x: [f"{x}{a}{b}" for a in "abcdefg" for b in "klmnop"] for x in ("en", "de", "fr", "es")}
    rows, items = [], [(k, " ".join(rng.choice(stems["en"]) for _ in range(18)) + f"? {rng.choice(stems['en'])} answer{k} so") for k in range(6)]

    def add(text, lang, source):
        rows.append((len(rows) * 3 % 1000, text, lang, source, len(text or ""), f"x{len(rows)}"))

    for i in range(130):
        lang = rng.choice(list(stems))
        words = [rng.choice(stems[lang]) for _ in range(rng.randint(20, 70))]
        text = " ".join(words)
        add(text, lang if i % 6 else None, f"s{i % 7}")
        if i % 8 == 0:
            add(text.upper() if i % 16 else text, lang, f"s{i % 5}")
        if i % 9 == 0:
            words[len(words) // 2] = "changed"
            add(" ".join(words), lang, "s1")
        if i % 11 == 0:
            add(f"{text} {items[i % 6][1].upper()} {words[0]}", lang, "s2")
        if i % 13 == 0:
            add(f"{text} user = bob password: hunter2hunter2", lang, "s3")
    for text, lang in ((None, "en"), ("", "de"), ("123 456 !!", "fr"), (" ", None)):
        add(text, lang, "s1")
    rows.append((None, " ".join(stems["es"][:30]), "es", "s4", 1, "a"))
    rows.append((None, " ".join(stems["es"][:30]), "es", "s4", 1, "b"))
    rows.append((5000, " ".join(stems["de"][5:35]), "de", None, 1, "c"))
    rows.append((rows[3][0], " ".join(stems["fr"][5:35]), "fr", "s6", 1, "d"))  # an id that another row has
    return rows, items


def test_run_against_a_plain_version(spark, tmp_path):
    from sievemark.llm import decontaminate, mixing, op2_queries

    rows, items = _corpus()
    names = ("doc_id", "text", "lang", "source", "n_chars", "th")  # the last has a name that stages use
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).select("th", "epoch", "n_tokens", "domain").collect()

    # Language
    taught = [(t, x) for i, t, x, *_ in rows if x is not None and i is not None and zlib.crc32(str(i).encode()) % 5]
    kept = [r for r, (x, score) in zip(rows, N._plain(taught, [r[1] for r in rows]), strict=True) if x != "und" and score >= 0.5]
    assert len(kept) < len(rows)
    # Near copies: of each group the smallest id, then the text of the least name, then one of the rows that are equal in both.
    _, groups = D._components([(r[0], r[1]) for r in kept])
    least = {min(g, key=lambda j: (kept[j][0] is None, kept[j][0] or 0, hashlib.md5(kept[j][1].encode()).digest())) for g in {tuple(g) for g in groups}}
    alone = [kept[j] for j in sorted(least)]
    assert len(alone) < len(kept) - 20
    # Benchmark items
    hit = {k for k, _ in D._leaks(list(enumerate(r[1] for r in alone)), items, decontaminate.LEAST_SCORE, decontaminate.LEAST_OVERLAP)}
    clean = [r for k, r in enumerate(alone) if k not in hit]
    assert 5 < len(clean) < len(alone)
    # Credentials
    open_ = [r for r in clean if not D._spans(r[1])]
    assert len(open_) < len(clean)
    # Mixing
    domains = op2_queries.DOMAINS
    domain = lambda s: domains[int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % len(domains)] if s is not None else None
    df = spark.createDataFrame(open_, schema).withColumn("domain", op2_queries.domain())
    places = {w: {r["th"]: (r["o"], r["doc_id"] is None, r["doc_id"] or 0, r["t"]) for r in df.select("th", "doc_id", mixing.order_of(mixing.SEED, F.lit(w)).alias("o"), mixing.tie_of(df).alias("t")).collect()} for w in range(mixing.EPOCHS + 1)}
    leaves = [(r[5], domain(r[3]), r[2], r[3], -(-len(r[1].encode()) // 4)) for r in open_]
    want = D._mixed(leaves, op2_queries.WEIGHTS, op2_queries.SHARE, mixing.EPOCHS, lambda r, whole: places[whole][r[0]])
    twin = lambda th: "a" if th == "b" else th  # noqa: E731  # rows of one id and text: either may stay
    assert sorted(((twin(r["th"]), r["epoch"]) for r in got), key=str) == sorted(((twin(th), e) for th, e in want), key=str)
    assert len(want) > 20 and len(names) == 6
