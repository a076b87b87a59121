import duckdb
import pytest

import corpus_pipeline
from textbarge.llm.common import read
from textbarge.llm.queries import ORACLE, QUERIES
from textbarge.plans.check import compare, diff

from .test_packing import check
from .helpers import documents

SF = "/root/testdata/sf0.001"


def test_stages_give_documents_and_keep_clean_ones(spark):
    docs = read(spark, SF, "documents")
    total, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = docs.count()
    assert 0.4 * total < left < total
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        read(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    r = compare(spark, QUERIES[name], ORACLE[name], SF)
    assert r["hash_match"] and r["rows_spark"] == r["rows_oracle"], diff(r)


def test_stages_take_clashing_and_null_columns(spark):
    docs = documents(spark, [(i, f"text number {i} of some length and more words to have {i * 7}") for i in range(40)] + [(None, None), (40, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
