"""The corpus pipeline against its stages in plain Python, and on odd and empty tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_llm import DOCS, brute_classes
from tests.oracle import SF
from tidemark.llm import packing
from tidemark.llm.mixing import mix_sources


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == columns, name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    one: dict = {}
    for i, t in texts.items():
        if any(c.isalpha() for c in t):
            one[t] = max(one.get(t, i), i)
    left = {i: t for t, i in one.items()}
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _, _ in brute_classes(left).values()}
    times = {r["doc_id"]: r["repeats"] for r in mix_sources(kept).collect() if r["repeats"]}
    mixed = corpus_pipeline.source_mix(spark, kept, SF)
    assert mixed.columns == columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times
    out = corpus_pipeline.run(spark, SF).toPandas()
    enc = packing.byte_bpe(*packing.vocabulary())
    assert out["length"].sum() == sum(n * (len(packing.token_ids(texts[i], enc)) + 1) for i, n in times.items())
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "some words of the day and more of them", "en", "a", 9), (3, "some words of the day and more of them", "en", "a", 9), (4, "123 456", None, "b", 7)]
    for k, part in enumerate(([], rows)):
        spark.createDataFrame(part, DOCS).write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / f"{k}"))
        assert {r["doc_id"] for r in out.select(F.col("doc_id")).collect()} <= {3}
