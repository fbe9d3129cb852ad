"""The findings of FINDINGS_r02.md on corpus operators, each with an input that failed before."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siftline.llm import decontaminate, simhash


def test_index_row_groups_hold_few_segments(spark):
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha beta gamma delta "), 150_000).alias("text"))
    files = decontaminate.build_index(docs).inputFiles()
    groups = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 12 and max(groups) <= 2


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{d}x{i}" for i in range(12)) for d in range(200)]
    compared, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest, **kw: compared.append(pairs.distinct().count()) or alike(pairs, *rest, **kw))
    kept = simhash.keep_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(200))
    assert sum(compared[1:]) == 0  # the first are those that meet by bits
