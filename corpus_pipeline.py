"""Corpus pipeline over documents: stages in order, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of documents; n_chars follows the text. For every stage: an empty table gives
an empty result, repeated rows are worked on each for itself (near copies excepted, see there), and further columns come
through as they are, whatever their names. The toxicity stage learns from the labelled rows of the corpus that it then scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import drop_tables, release, spare, table, table_mark, written
from pulseloom.llm.line_dedup import line_dedup
from pulseloom.llm.ngram_join import ngram_jaccard_join
from pulseloom.llm.packing import pack
from pulseloom.llm.queries import tokenizer_spec
from pulseloom.llm.secrets import redact_secrets
from pulseloom.llm.toxicity import learn, toxicity

#: Ids of copies up to which they are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` in the columns of ``before``; n_chars counts the text's code points (null stays null)."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*before.columns)


def _aside(docs: DataFrame, names: tuple[str, ...], run) -> DataFrame:
    """run(docs), with columns of ``docs`` that are named as those an operator adds out of its way."""
    clashing = [c for c in docs.columns if c.lower() in names]
    away = {}
    for c in clashing:
        away[c] = spare(f"_kept_{c}", [*docs.columns, *away.values()])
    out = run(docs.withColumnsRenamed(away)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null and empty texts stay."""
    release(spark)
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = spare("_score", docs.columns)
    return toxicity(docs, *model, score=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share; null texts become empty."""
    release(spark)
    return _aside(docs, ("n_lines", "n_dropped"), lambda rows: _recounted(rows, line_dedup(rows)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one of the least id; documents without words stay.

    Rows with a null id stay. An id that several rows have goes if all of them are others' copies; of rows that
    repeat both id and text one stays.
    """
    release(spark)
    rows = written(ngram_jaccard_join(docs), "groups")
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.expr("bool_and(n_shingles > 0 and doc_id <> component_id)").alias("copy"))
    copies = written(ids.where("copy").select("doc_id"), "copies")
    kept = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(ids.where("n > 1 and not copy").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by the name of their kind in angle brackets. Null texts stay null."""
    release(spark)
    return _recounted(docs, redact_secrets(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed by source; ids as unsigned little-endian 32-bit numbers. Null texts are one piece of
    one id, null sources a queue of their own; other columns than doc_id, text and source are not read."""
    release(spark)
    return pack(docs, tokenizer_spec())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("secrets", hide_secrets), ("packing", pack_sequences)]
#: SQL can't express the learned grammar, the span parsers or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = table_mark()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, mark, keep=docs)  # the stage's working tables; its result is written
    return docs
