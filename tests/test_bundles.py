"""Many bundles at once give what a loop over them gives."""

import pytest

from loam.bundle import Bundle
from loam.bundles import Bundles
from loam.operators import rules as R

NOTE = "---\ntype: Note\ntitle: {t}\ndescription: D.\n---\n{b}\n"
FILES = {
    "one": {"a.md": NOTE.format(t="Same", b="[b](b.md) [out](../two/a.md) [root](/x/c.md)"), "b.md": NOTE.format(t="Same", b="[a](a.md)"), "x/c.md": "no front matter", "index.md": "[a](a.md)"},
    "two": {"a.md": NOTE.format(t="Same", b="alone in its bundle"), "b.md": "---\ntitle: [\n---\n", "x/c.md": NOTE.format(t="C", b="[gone](gone.md) [a](../a.md)")},
    "öne/..": {"a.md": NOTE.format(t="Other", b="[self](a.md) token word"), "log.md": "log"},
}


def table(spark, files=FILES):
    rows = [(name, path, text) for name, bundle in files.items() for path, text in bundle.items()]
    return spark.createDataFrame(rows, "bundle string, path string, content string").repartition(3)


def looped(spark, ask, files=FILES):
    found = []
    for name, bundle in files.items():
        rows = ask(Bundle(spark.createDataFrame(list(bundle.items()), "path string, content string"), R.Config(presets=("recommended", "strict"))))
        found += [(name, *map(str, r)) for r in rows.collect()]
    return sorted(found)


def asked(df):
    return sorted((r["bundle"], *map(str, r[1:])) for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    return Bundles(table(spark), R.Config(presets=("recommended", "strict")))


def test_diagnostics(spark, many):
    columns = ["code", "severity", "severity_rank", "message", "path", "concept_id"]
    assert asked(many.lint().select("bundle", *columns)) == looped(spark, lambda b: b.lint().select(*columns))
    found, scores = many.doctor()
    assert asked(found.select("bundle", *columns)) == looped(spark, lambda b: b.doctor()[0].select(*columns))
    counts = ["error", "warning", "advice", "info", "score"]
    assert asked(scores.select("bundle", *counts)) == looped(spark, lambda b: b.doctor()[1].select(*counts))


def test_graphs_and_search(spark, many):
    assert asked(many.backlinks().select("bundle", "id", "source")) == looped(spark, lambda b: b.backlinks().select("id", "source"))
    assert asked(many.clusters().select("bundle", "id", "cluster")) == looped(spark, lambda b: b.clusters().select("id", "cluster"))
    assert asked(many.search("word bundle same", 2).select("bundle", "id", "score", "rank")) == looped(spark, lambda b: b.search("word bundle same", 2).select("id", "score", "rank"))
    columns = ["files", "concepts", "indexes", "logs", "links", "broken_links", "diagnostics"]
    assert asked(many.list().select("bundle", *columns)) == looped(spark, lambda b: b.stats().select(*columns))
    assert [(r["bundle"], r["scc"], r["cycle"]) for r in many.cycles().orderBy("bundle", "scc").collect()] == [("one", "a", ["a", "b", "a"]), ("öne/..", "a", ["a", "a"])]


def test_differences_stay_in_their_bundle(spark, many):
    """A file that leaves one bundle and comes to another was removed here and added there, and renamed in neither."""
    moved = {name: dict(bundle) for name, bundle in FILES.items()}
    moved["one"]["moved.md"] = moved["one"].pop("x/c.md")
    moved["two"]["new.md"] = moved["öne/.."].pop("a.md")
    found = Bundles(table(spark, moved), many.config).diff(many)
    expected = {("one", "renamed", "moved", "x/c"), ("two", "added", "new", None), ("öne/..", "removed", "a", None)}
    assert {(r["bundle"], r["change"], r["id"], r["old_id"]) for r in found.collect()} == expected


def test_names_and_no_bundles(spark, many):
    for bad in (None, "a\x1fb"):
        with pytest.raises(Exception, match="needs a name"):
            Bundles(spark.createDataFrame([(bad, "a.md", "")], "bundle string, path string, content string"), many.config).list().collect()
    none = Bundles(table(spark).where("false"), many.config)
    assert none.list().collect() == [] and none.lint().collect() == [] and none.clusters().collect() == []
