"""The pipeline keeps what its operators keep."""
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from spoor.llm import bpe, langid
from spoor.llm.common import small_batches

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_mark", F.lit(1))
    assert len(corpus_pipeline.STAGES) == 5
    rows = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, rows, SF)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows.collect()}
        rows = out
    want = bpe.encode_digests(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < found.count() < docs.count()


def test_every_stage_takes_odd_rows_and_none(spark, odd, docs_of):
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd, SF)
        kept = out.collect()
        if step is not corpus_pipeline.encode:
            assert out.columns == odd.columns, name
            assert len(kept) <= odd.count(), name
        else:
            assert len(kept) == odd.count()
        assert step(spark, docs_of([]), SF).count() == 0, name
    found = [r.doc_id for r in corpus_pipeline.identify_language(spark, odd, SF).collect()]
    assert not {1, 2, 3} & set(found)                  # null, empty and blank texts have no language
    stays = corpus_pipeline.drop_near_duplicates(spark, docs_of([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]), SF).collect()
    assert [r.doc_id for r in stays] == [1]


def test_few_rows_are_read_at_a_time(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    for key in keys:
        spark.conf.unset(key)
    small_batches(spark)
    assert [spark.conf.get(k) for k in keys] == ["512", "512"]


def test_workers_remember_a_bounded_vocabulary():
    """What a worker keeps after encoding stays in its memory during the stages that follow."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    batches = [pd.DataFrame({"doc_id": [k], "text": [" ".join(f"w{i}" for i in range(20_000 * k, 20_000 * (k + 1)))]}) for k in range(10)]
    done = sum(len(rows) for rows in bpe._digests(path, public_tokenizers.PATTERN)(iter(batches)))
    assert done == 10 and len(bpe.codec(path, public_tokenizers.PATTERN).chunks) <= 160_000


def test_sampled_texts_are_counted_once(spark, odd, capsys):
    """Two evaluations in one task would hold two Python workers."""
    sample = langid._sample(odd, odd.select("doc_id").distinct())
    sample.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert {r.doc_id for r in sample.collect()} == {4, 5, 6, 7, 8}
