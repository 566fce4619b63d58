"""Five stages from raw documents to token ids; each is a row of STAGES.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs. All but the last keep the columns of
documents; clean documents pass every filter.

1. language_id: documents that match no learned language go (null texts and texts
   without a letter too); a null lang takes the prediction.
2. line_dedup: later repeats of runs of lines are cut; documents with nothing left go.
3. near_dedup: one document of each class of near duplicates stays.
4. decontaminate: documents that hold a benchmark item go.
5. byte_bpe: ids and n_tokens are added, and text is what decoding the ids gives.
"""

from __future__ import annotations

import threading
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, line_dedup, minhash, support
from tracewell.session import table

#: What goes to a Python worker at a time: whole texts, however long they are, and rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_scratch = threading.local()


def _stage(f):
    """A stage drops the scratch tables of the one before it in its thread, once that one's result is written.

    A result that still reads them (not written yet) keeps them. A stage's result is written after it
    returns, so the bound on batches is set for the session; run() puts the session's own back.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        support.ship(spark)
        for name, bound in BATCHES.items():
            spark.conf.set(name, bound)
        before = getattr(_scratch, "tables", [])
        if before and not any(path in file for path in map(_tail, before) for file in docs.inputFiles()):
            support.release(spark, before)
            before = []
        known = set(support.tables())
        out = f(spark, docs, sf_dir)
        _scratch.tables = before + [p for p in support.tables() if p not in known]
        return out

    return run_stage


def _tail(path: str) -> str:
    """The part of a table's path that is its own."""
    return path.rsplit("/", 1)[-1]


def _with_text(docs: DataFrame) -> DataFrame:
    """n_chars follows text where documents have it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs.withColumnsRenamed({c: f"own_{c}" for c in ("lang_pred", "score", "rejected") if c in docs.columns}), langid.fit(langid.learnable(docs, langid.held_out())))
    kept = found.filter("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score", "rejected")
    return kept.withColumnsRenamed({f"own_{c}": c for c in ("lang_pred", "score", "rejected") if c in docs.columns}).select(*[f"`{c}`" for c in docs.columns])


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(docs)
    return _with_text(cut.filter("n_removed = 0 or n_removed < n_lines").select(*[f"`{c}`" for c in docs.columns]))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = docs.withColumnRenamed("leaks", "own_leaks")
    clean = decontam.matches(held, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).drop("leaks")
    return clean.withColumnRenamed("own_leaks", "leaks") if "leaks" in docs.columns else clean


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, rank_file, public_tokenizers.PATTERN).withColumn("text", F.col("decoded").cast("string")).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL expresses neither the classifier nor BPE; tests/llm hold run() against its stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = support.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        return docs
    finally:
        for name, bound in before.items():
            spark.conf.set(name, bound)
