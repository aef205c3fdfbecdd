"""The corpus pipeline: language, repeated lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, with what the stage decided taken out or changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import fresh, staged, table
from kindred.llm.language_id import identify, learn
from kindred.llm.line_dedup import dedup_lines
from kindred.llm.minhash import near_duplicates
from kindred.llm.mixing import mix_sources
from kindred.llm.packing import pack
from kindred.llm.queries import mix_params, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text or no letter); a null lang becomes the predicted one.

    All rows with a label and a text are learnt from.
    Without any labelled row there is nothing to learn from: documents with a letter stay as they
    are. Repeated rows are judged alike, other columns stay, an empty table gives an empty one.
    """
    learnt = learn(docs)
    if not learnt.phrases:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "_found", "_found_score")
    found = identify(docs, learnt, out_lang=lang, out_score=score).filter(F.col(lang) != "und")
    known = F.coalesce(F.col("lang"), F.col(lang).cast(docs.schema["lang"].dataType)).alias("lang")
    return found.select(*[known if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents of which nothing is left.

    Null and blank texts go with them. Rows that repeat id and text are one document; other columns
    stay, an empty table gives an empty one.
    """
    return dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id.

    Rows that repeat an id are one document: they stay or go together. Null ids and texts
    without words are in no group and stay; other columns stay, an empty table gives an empty one.
    """
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents sampled by their calibrated probabilities.

    Null labels are a value of their own, repeated ids are drawn alike, other columns stay, an
    empty table gives an empty one.
    """
    mixed = mix_sources(docs, mix_params())
    return mixed.filter(F.col(mixed.columns[-1])["selected"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece. A null text is the end id alone, repeated rows are packed each for itself, an empty table gives no rows."""
    return pack(docs, tokenizer_path(), 4096, 1)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("minhash", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Tokenisation and learnt automata have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
