"""From raw documents to a training mix: language, near copies, benchmark leaks, secrets, sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.

Cases: rows with null, empty or blank text, or without letters, go in the first stage; a null lang teaches nothing, and its row goes on by
the language of its text until the mix, where null lang and null source have no weight; null doc_ids count as larger than all, and
rows of one doc_id are told apart by their texts; equal rows are near copies, and one stays; columns beyond those of `documents` pass
through, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import op1_queries as op1
from sievemark.llm import op2_queries as op2
from sievemark.llm import op5_queries as op5
from sievemark.llm import op6_queries as op6
from sievemark.llm import op9_queries as op9
from sievemark.llm.decontaminate import without_contaminated
from sievemark.llm.jaccard_join import one_of_each
from sievemark.llm.language_id import UND, predict
from sievemark.llm.mixing import mix
from sievemark.llm.op2_queries import SHARE, WEIGHTS, domain
from sievemark.llm.op5_queries import learn
from sievemark.llm.scratch import Scratch, mark, release
from sievemark.llm.secret_scan import without_secrets

#: A language of a lower posterior than this is not known.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: no letters, or no language likelier than all others together."""
    found = predict(docs, learn(docs))
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the smallest doc_id."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a test item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold credentials."""
    return without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the target weights, some in several epochs; adds domain, n_tokens and epoch."""
    return mix(docs.withColumn("domain", domain()), SHARE, WEIGHTS)


STAGES = [("language", language), ("near copies", near_copies), ("benchmark leaks", benchmark_leaks), ("secrets", secrets), ("mixing", mixed)]


def _sql() -> str:
    """The operators' SQL, each over what the stage before keeps. For tables with an id a row, and of which every labelled row is learned from."""
    over = lambda name, kept: "(" + next(m for m in (op1, op2, op5, op6, op9) if name in m.ORACLES).ORACLES[name].replace("FROM documents", f"FROM {kept}") + ")"
    return f"""
WITH known AS MATERIALIZED (SELECT documents.* FROM documents JOIN {over("op5_language_id", "documents")} USING (doc_id) WHERE lang_pred <> '{UND}' AND score >= {LEAST_SCORE}),
single AS MATERIALIZED (SELECT known.* FROM known JOIN {over("op6_ngram_jaccard_join", "known")} USING (doc_id) WHERE component_id = doc_id),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM {over("op1_benchmark_decontamination", "single")})),
open AS MATERIALIZED (SELECT * FROM clean WHERE doc_id NOT IN (SELECT doc_id FROM {over("op9_secret_scans", "clean")} WHERE spans <> ''))
SELECT doc_id, text, lang, source, n_chars, domain, n_tokens, epoch FROM open JOIN (SELECT doc_id, domain, n_tokens, epoch FROM {over("op2_mixing_sources", "open")}) USING (doc_id)
"""


#: Tests hold run() against this, and against a plain version on odd rows.
ORACLE_SQL = _sql()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "corpus-pipeline")
    before = None
    for name, stage in STAGES:
        began = mark()
        after = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(began)  # the stage's own tables
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
