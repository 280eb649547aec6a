"""The pipeline's stages, each judged on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from tessella.llm.common import documents, shared_dir
from tessella.llm import op6_simhash

from .conftest import TEN


def test_stages(spark):
    docs = documents(spark, TEN)
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, TEN).write.parquet(path := f"{shared_dir(spark)}/pipeline-test/{k}")
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "simhash_near_dedup":
            classes = {r.doc_id: r.component_id for r in op6_simhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(classes.values())
        if k < 4:
            assert docs.columns == columns
    assert sizes[1] >= 0.9 * sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
    for r in docs.collect():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_odd_and_empty_tables(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages."""
    for docs in (odd, empty):
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, TEN).write.parquet(path := f"{shared_dir(spark)}/pipeline-odd/{docs.count()}-{name}")
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == columns
            if name == "language_id":
                assert docs.where("text is null or text = ''").isEmpty()
            if name == "simhash_near_dedup":
                assert docs.where("text = 'same text here'").count() <= 1
