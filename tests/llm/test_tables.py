from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from fieldloom.llm import tables


def test_stages_send_few_texts_at_once(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        corpus_pipeline.pack_sequences(spark, docs, "")

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

        most = max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect())
        assert most <= tables.BATCH
        spark.conf.set(name, "20")
        tables.small_batches(spark)
        assert spark.conf.get(name) == "20"
    finally:
        spark.conf.set(name, before)


def test_scratch_tables_go_and_settings_stay(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with tables.scratch(spark) as write:
        part = write(spark.range(100).groupBy("id").count())
        path = Path(part.inputFiles()[0].removeprefix("file:")).parent
        whole = tables.materialise(part.select("id"))
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    assert whole.count() == 100 and spark.conf.get(name, None) == before
