"""Pipelines, anonymization, quotas and streams."""

import random

from pyspark.sql import functions as F

from sievemark.operators import anonymize as A
from sievemark.operators import quota as U
from sievemark.operators import scanners as S
from sievemark.plans import shield as P
from sievemark.sources import tables as IO
from sievemark.streaming import flows


def test_round_trip(spark):
    texts = ["John Doe (joe@example.com) works. Card 4111-1111-1111-1111.", "é 123-45-6789 and 123-45-6789", "", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = A.anonymize(df, "id").orderBy("id").collect()
    assert out[0]["anonymized"] == "[PERSON_1] ([EMAIL_1]) works. Card [CREDIT_CARD_1]."
    assert out[1]["anonymized"].count("[SSN_") == 2
    vault = A.vault(A.anonymize(df, "id"), "id", F.lit("2024-01-01").cast("timestamp"))
    masked = A.anonymize(df, "id").select(F.col("id").cast("string").alias("session_id"), "anonymized")
    back = {r["session_id"]: r["restored"] for r in A.deanonymize(masked, vault).collect()}
    assert [back[str(i)] for i in range(4)] == texts


def test_short_circuit_and_combine(spark):
    shield = P.Shield({"a": lambda t: S.ban_substrings(t, ["bad"]), "b": S.no_refusal}, True, 0.9)
    df = spark.createDataFrame([("bad I cannot",), ("I cannot",), ("fine",)], "text string")
    rows = shield.scan(df).collect()
    assert [len(r["results"]) for r in rows] == [1, 2, 2]
    assert [r["verdict"]["is_valid"] for r in rows] == [False, False, True]
    assert rows[1]["verdict"]["risk_score"] == 0.95


def _plain_quota(requests, limits):
    out, state = {}, {}
    for user, event, at in sorted(requests, key=lambda r: (r[0], r[2], r[1])):
        own = state.setdefault(user, {w: [None, 0] for w in limits})
        for w in own:
            if own[w][0] is None or at >= own[w][0] + U.WINDOWS[w] * 1_000_000:
                own[w] = [at, 0]
        ok = all(own[w][1] < limits[w] for w in own)
        for w in own:
            own[w][1] += ok
        out[event] = ok
    return out


def _requests(n=600, seed=3):
    rng = random.Random(seed)
    return [(rng.randint(1, 5), i, 1_700_000_000_000_000 + rng.randint(0, 4 * 86_400) * 1_000_000) for i in range(n)]


def test_exact_quota(spark):
    requests, limits = _requests(), {"hour": 2, "day": 12}
    df = spark.createDataFrame(requests, "user_id long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["event_id"]: r["allowed"] for r in U.exact(df, limits).collect()}
    assert got == _plain_quota(requests, limits)


def test_stream_quota_and_rollup(spark, tmp_path):
    requests, limits = _requests(200), {"hour": 2, "day": 12}
    rows = spark.createDataFrame(requests, "user_id long, event_id long, us long").select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.event_stream(spark, str(tmp_path / "in"))
    flows.run_to_table(flows.quota(stream, limits), str(tmp_path / "quota"), str(tmp_path / "c1"))
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "quota")).collect()}
    assert got == _plain_quota(requests, limits)
    counts: dict = {}
    flows.run_in_batches(flows.rolled(flows.event_stream(spark, str(tmp_path / "in")), "1 hour"), str(tmp_path / "c2"), lambda frame, number: counts.update({r["bucket"]: r["n"] for r in frame.collect()}))
    assert sum(counts.values()) == 200


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"x")
    assert [r["text"] for r in IO.text_files(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    prompts = spark.createDataFrame([("1", "hi", "simple", ["none"], 1)], "id string, text string, category string, expected_threats array<string>, word_count long")
    IO.write_prompts(prompts, str(tmp_path / "p"))
    assert IO.prompts(spark, str(tmp_path / "p")).collect() == prompts.collect()
    IO.append_results(spark.range(2), str(tmp_path / "r"))
    assert IO.results(spark, str(tmp_path / "r"), "id long").count() == 2


def test_scan_once_counts_null_texts(spark, tmp_path):
    import duckdb

    from sievemark.plans import registry

    docs = [(1, "one text", "a"), (2, "one text", "a"), (3, None, "a"), (4, None, "a"), (5, None, "b"), (6, "", "b"), (7, "another", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["scan_once_per_text"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(registry.ORACLES["scan_once_per_text"]).fetchall()
    assert sorted(map(str, (tuple(r[c] for c in ("source", "n", "texts", "tokens")) for r in got.collect()))) == sorted(map(str, want))
