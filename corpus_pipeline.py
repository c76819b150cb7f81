"""A corpus from raw documents: quality, lines, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import kneser_ney, line_dedup, minhash, packing, suffix_dedup
from palimpsest.llm._shared import materialize


WORD = r"[^\x20\x09-\x0D]"


def _row(docs: DataFrame) -> Column:
    """What an operator that changes texts hands through: whether there were words, and all columns but the text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return F.struct(F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("had"), F.struct(*others).alias("row"))


def _with_text(columns: list[str], new: DataFrame) -> DataFrame:
    """The columns of documents, from ``new`` (text, carried), without documents that had words and have none left."""
    stays = ~F.col("carried.had") | F.col("text").rlike(WORD)
    return new.where(stays).select(*(F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"carried.row.`{c}`").alias(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text rejects go.

    Null texts are empty; documents without a language, or of one without trusted text, stay. Rows with one doc_id go or stay
    together. Without labels all stay; an empty table stays empty."""
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood before, or are one edit from one that did, go.

    Null texts stay null, lines without a word stay; of rows alike each line stays in one place, and a row that is there twice is
    one document. Documents with words that have none left go. An empty table stays empty."""
    return _with_text(docs.columns, line_dedup.dedup_lines(docs, carry=_row(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: of those that are 0.8 alike or more. 37 bands of 5 rows miss a pair at 0.8 as seldom as 25 miss one at 0.85.

    The smallest doc_id of a group stays, with all its rows. Null and wordless texts and rows without a doc_id are alone and
    stay; an empty table stays empty."""
    return minhash.drop_near_duplicates(docs, minhash.Params(numerator=80, bands=37))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that are anywhere else too go, from 256 bytes on: with over 50 words that is nearly every one. A code point that
    loses a byte goes whole.

    Null and shorter texts stay as they are, an empty table stays empty; a row that is there twice repeats itself, and goes
    whole where it is long enough. Documents with words that have none left go."""
    got = suffix_dedup.remove_repeats(docs, length=256, gram=96, carry=_row(docs), characters=True)
    return _with_text(docs.columns, got.select("carried", F.col("kept").cast("string").alias("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot. Null texts have no words; repeated rows are packed like others; an empty table gives an empty table."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup_stage), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: Trained and sketched stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
