"""The bundle handle, formatting, incremental parsing, and hostile texts."""

import time

import pytest

from loam.bundle import Bundle, load_config
from loam.operators import formatting, incremental, parsing
from tests.test_operators import BUNDLE, files


def write(root, content):
    for name, text in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_bundle(spark, tmp_path):
    b = Bundle.load(spark, write(tmp_path / "b", BUNDLE | {"loam.json": '{"rules": {"style/tag-format": "error"}, "presets": ["strict"]}'}))
    assert b.config.level("style/tag-format") == "error" and b.config.presets == ("strict",)
    assert b.stats().first()["concepts"] == 2
    assert {r["code"] for r in b.validate().collect()} == {"spec/missing-type"}
    ranks = [r["severity_rank"] for r in b.lint().collect()]
    assert ranks == sorted(ranks, reverse=True)
    assert {(r["direction"], r["id"]) for r in b.neighbors("a").collect()} >= {("out", "x/b"), ("out", "tag:x"), ("in", "x/b"), ("in", "index")}
    assert {(r["id"], r["source"]) for r in b.backlinks().collect()} == {("a", "index"), ("a", "x/b"), ("x/b", "a")}
    assert {r["cluster"] for r in b.clusters().collect()} == {"a"}
    assert b.search("part two").first()["id"] == "a"
    changed = dict(BUNDLE) | {"x/c.md": BUNDLE["x/b.md"], "a.md": BUNDLE["a.md"] + "more\n"}
    del changed["x/b.md"]
    after = Bundle.load(spark, write(tmp_path / "c", changed))
    assert {(r["change"], r["id"], r["old_id"]) for r in after.diff(b).collect()} == {("changed", "a", None), ("renamed", "x/c", "x/b")}
    assert b.manifest().first()["files"] == 4
    with pytest.raises(ValueError):
        load_config(write(tmp_path / "d", {"loam.json": '{"colour": 1}'}) + "/loam.json")


def test_formatting(spark):
    text = "---\ntitle: T\r\ntags:\n  - a\n  - b\ntype: Note\nowner: o\ntimestamp: 2024-01-31\n---\n\n\nx  \n\n\n\n```\nkeep  \n\n\n\nthis\n```\ny\t\n\n"
    rows = files(spark, **{"a.md": text, "b.md": None, "c.md": "---\nb: &x 1\na: *x\n---\n"})
    made = {r["path"]: r["formatted"] for r in formatting.formatted(rows).collect()}
    assert made["a.md"] == "---\ntype: Note\ntitle: T\ntags:\n  - a\n  - b\ntimestamp: 2024-01-31T00:00:00.000Z\nowner: o\n---\n\nx\n\n```\nkeep  \n\n\n\nthis\n```\ny\n"
    assert made["b.md"] == "" and made["c.md"] == "---\nb: &x 1\na: *x\n---\n"
    again = formatting.formatted(spark.createDataFrame(list(made.items()), "path string, content string"))
    assert {r["changed"] for r in again.collect()} == {False}


def test_incremental(spark):
    first = incremental.refreshed(files(spark, **BUNDLE), parsing.parse(files(spark, **BUNDLE)).where("false").selectExpr("*", "'1' AS parser")).cache()
    assert first.count() == 4
    changed = files(spark, **(BUNDLE | {"a.md": "new"}))
    assert [r["path"] for r in incremental.stale_files(changed, first).collect()] == ["a.md"]
    assert {r["path"]: r["body"] for r in incremental.refreshed(changed, first).collect()}["a.md"] == "new"


@pytest.mark.parametrize(
    "text",
    ["[" * 25_000, "[x](" * 8_000, "".join("`" * n + " " for n in range(1, 600)), "[" + "a" * 200_000, "---\ntags:\n" + "  - t\n" * 20_000 + "---\n", "# h\n[a](b.md)\n" * 5_000, "(" * 20_000 + "[a](" + "(" * 20_000],
    ids=range(7),
)
def test_hostile_texts(spark, text):
    began = time.time()
    row = parsing.parse(files(spark, **{"a.md": text})).first()
    assert row["path"] == "a.md" and time.time() - began < 20
