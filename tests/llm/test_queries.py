"""The registered queries against their SQL, and the pipeline's stages."""

import pytest

import corpus_pipeline
from loam.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.common import docs, table
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on its predecessor's result, with the columns of documents; packing covers the mix."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows.write.parquet(str(tmp_path / name))
        made = stage(spark, spark.read.parquet(str(tmp_path / name)), sf)
        assert made.columns == rows.columns
        rows = spark.createDataFrame(made.collect(), made.schema)
        counts.append(rows.count())
    assert counts[0] >= 198 and counts[1] == 189 and 180 <= counts[2] <= 189
    packed = corpus_pipeline.packing(spark, rows, sf)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in rows.select("doc_id").collect()}
    same = corpus_pipeline.run(spark, sf).orderBy("bin_id", "slot").collect()
    assert sorted(map(repr, same)) == sorted(map(repr, packed.collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, tmp_path, empty):
    rows = table(spark, docs())
    (rows.where("false") if empty else rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() == 0) is empty
