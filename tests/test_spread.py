"""Small files of many rows: what is made of each row is many tasks' work, and the rows stay the same."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from loam.functions import paths

ROWS = 25_000


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A table of one row group for each of some names."""
    root = tmp_path_factory.mktemp("tables")
    key = pa.array(range(ROWS), pa.int64())
    name = pa.array([f"Name#{i:09}" for i in range(ROWS)])
    pq.write_table(pa.table({"c_custkey": key, "c_name": name, "c_mktsegment": name}), root / "customer.parquet")
    pq.write_table(pa.table({"p_partkey": key, "p_name": pa.array([f"n{i % 7}" for i in range(ROWS)]), "p_brand": pa.array(["B"] * ROWS), "p_size": pa.array([1] * ROWS, pa.int32())}), root / "part.parquet")
    return str(root)


@pytest.mark.parametrize("query", ["host_forms", "front_matter_values", "anchored_front", "imported_tables", "resolved_targets", "written_texts"])
def test_rows_of_one_row_group_are_dealt(spark, tables, query):
    found = entry.queries()[query](spark, tables)
    assert found.rdd.getNumPartitions() >= 3
    assert found.count() == ROWS


def test_imports_are_parsed_once_for_each_different_text(spark, tables):
    plan = entry.queries()["imported_tables"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "read_front_matter" not in plan


def test_hosts_are_made_once_for_each_url(monkeypatch):
    import pandas as pd

    asked = []
    monkeypatch.setattr(paths, "host_of", lambda u: asked.append(u) or u[:1])
    assert list(paths.resource_host.func(pd.Series(["ab", None, "ab", "c"], dtype=object))) == ["a", None, "a", "c"]
    assert sorted(asked) == ["ab", "c"]


def test_defective_concepts_are_dealt(spark, tables):
    from loam.plans.catalogue import _defective

    files = _defective(spark, tables)
    assert files.rdd.getNumPartitions() >= 3
    assert files.count() == ROWS + 1


def test_absent_keys_cost_no_pattern(spark):
    """Keys of front matter are looked for before their patterns are tried, and what is found stays the same."""
    from loam.operators import parsing

    texts = ["---\ntype: T\ntitle: 'a'\ntags: [x, y]\n---\n", "---\nsubtitle: b\nretags:\n  - z\ntype: U\n---\n", "no front\n---\ntype: V\n---\n"]
    made = parsing.parse(spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, content string"))
    assert [(r["type"], r["title"], r["tags"]) for r in made.orderBy("path").collect()] == [("T", "a", ["x", "y"]), ("U", None, None), ("", None, None)]
    plan = made.select("owner", "tags")._jdf.queryExecution().optimizedPlan().toString()
    assert "owner:)" in plan and "tags:)" in plan


def test_many_bundles_have_their_hub_without_a_second_pass(spark, tables):
    from loam.plans.many import EACH, _part_bundles

    files = _part_bundles(spark, tables).files
    assert files.where("path = 'parts/hub.md'").count() == -(-ROWS // EACH) and files.count() == ROWS + -(-ROWS // EACH)
    assert files._jdf.queryExecution().logical().toString().count("/part.parquet") <= 2 and files._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
