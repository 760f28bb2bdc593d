"""Corpus preparation in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.base import saved
from lumenframe.llm.language import UNKNOWN, identify, train
from lumenframe.llm.mix import emit, mix
from lumenframe.llm.near_text import near_duplicates
from lumenframe.llm.pack import pack
from lumenframe.llm.pii import redact
from lumenframe.plans.scratch import step

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label every document with its language; those without any (no letter, or no text) go.

    The field is fitted on the stage's own labelled rows. ``lang`` becomes the predicted language.
    """
    known = identify(docs.select(*COLUMNS), train(docs))
    return known.where(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the least id (none comes last), then by a hash of its text.

    Rows are told apart by a number of their own, so repeated rows and rows without an id are near duplicates like
    any others. Texts without a word are in no group and stay.
    """
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("kept_row")), "numbered")
    found = near_duplicates(rows, id_col="kept_row").select("kept_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "kept_row")
    known = rows.select("kept_row", order.alias("at"))
    kept = found.join(known, "kept_row").groupBy("component_id").agg(F.min_by("kept_row", "at").alias("kept_row"))
    return rows.join(kept.select("kept_row"), "kept_row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed span of personal data is replaced by its kind; all documents stay."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are left out, kept, or repeated as rows."""
    return emit(mix(docs.select(*COLUMNS))).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's own tables are dropped when its result is stored, all but the last's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with step(spark):
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
