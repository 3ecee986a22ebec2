"""A corpus pipeline over ``documents``: language, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept. The first four return the columns of
documents, the last one the packed pieces. Ids are taken as unique; rows that share one share its fate in the near-copy
and mixing stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid_ppm, ngram_join, packing
from tidemark.llm.common import materialise
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix_sources

#: A document whose best language has less than this share of the probability is rejected, like one without letters.
MIN_LANGUAGE_SCORE = 0.5
#: Ids up to which a list of dropped documents is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null, without a letter, or undecided. The trees learn from a bounded labelled sample."""
    trees = langid_ppm.fit(docs.where(~langid_ppm.held_out("doc_id", 4, 2)))
    found = langid_ppm.predict(docs, trees, pass_cols=[F.col(c) for c in docs.columns])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    return exact_dedup(docs, keep="max", columns=docs.columns).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of 0.8 or more connect keep the one with the least id."""
    classes = ngram_join.near_classes(docs)
    dropped = materialise(classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target; a document appears as often as the mix takes it."""
    times = mix_sources(docs).where("repeats > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max("repeats").cast("int").alias("__times"))
    taken = docs.join(times, docs["doc_id"].eqNullSafe(times["__id"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces of at most 1024 tokens and pack these into sequences."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: A learned language model decides in the first stage, which SQL cannot express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
