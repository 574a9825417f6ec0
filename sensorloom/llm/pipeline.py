"""Stages of the corpus pipeline, each from documents to documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import small_side
from sensorloom.llm.decontaminate import without_contaminated
from sensorloom.llm.language_id import UNDETERMINED, fit_languages, held_out, identify_languages
from sensorloom.llm.mixing import mix_sources
from sensorloom.llm.ngram_join import ngram_join
from sensorloom.llm.token_files import token_files
from sensorloom.sources.scratch import written

#: Documents whose best language explains a smaller share of their n-grams are in no known language.
LEAST_SHARE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or in no learned language go."""
    model = fit_languages(docs.where(~held_out()).select("text", "lang"))
    found = identify_languages(docs, model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component; of rows that share a doc_id, one.

    Rows without doc_id stay. Two documents link at a Jaccard similarity of 0.8 of their five-word shingles.
    """
    found = ngram_join(docs.select("doc_id", "text"), k=5, percent=80)
    copies = written(found.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    kept = docs.join(small_side(copies), "doc_id", "left_anti").select(*docs.columns)
    single = kept.join(small_side(repeated), "doc_id", "left_anti").select(*docs.columns)
    double = kept.join(small_side(repeated), "doc_id", "left_semi").select(*docs.columns)
    return single.unionByName(double.dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weight; a document comes as often as its hash says, in shuffled order."""
    return mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place and ids as read back from the packed segments."""
    found = token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", tokens),
]


def run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each from the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
