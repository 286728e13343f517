"""Trees: listed by tasks, hidden files included, written whole or not at all, and the catalogue's queries over them."""

import json
import os

import pytest

from loam.bundle import Bundle
from loam.operators import diff as D, exchange as X
from loam.sources import store as stores
from loam.sources.bundle import BundleDataSource, read_bundle
from loam.sources.sink import STAGING, refused_paths, write_files, write_pieces
from loam.sources.tree import list_tree, read_tree

TREE = {"a.md": "A", ".hidden.md": "H", "_u/b.md": "é", ".dot/x/c.md": "C", "skip/d.md": "no", "x/skip/e.md": "E", "x/f.txt": "no", "node_modules/g.md": "no"}


def make(root, files=TREE):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def rows(df):
    return sorted((r["path"], r["content"]) for r in df.collect())


def table(spark, files):
    return spark.createDataFrame(list(files.items()) if isinstance(files, dict) else files, "path string, content string").repartition(3)


def test_listing(spark, tmp_path):
    root = make(tmp_path / "t", TREE | {"bad.md": b"\xff\xfe"})
    os.symlink(tmp_path / "t" / "a.md", tmp_path / "t" / "link.md")
    os.symlink(tmp_path / "t" / "x", tmp_path / "t" / "linked")
    expected = [(".dot/x/c.md", "C"), (".hidden.md", "H"), ("_u/b.md", "é"), ("a.md", "A"), ("bad.md", "\ufffd\ufffd"), ("x/skip/e.md", "E")]
    assert rows(read_tree(spark, root, exclude="skip/**,node_modules/**")) == expected
    assert rows(read_tree(spark, f"file://{root}", exclude="skip/**,node_modules/**", per_task=1)) == expected
    spark.dataSource.register(BundleDataSource)
    for tasks in (1, 3, 64):
        assert rows(spark.read.format("bundle").option("exclude", "skip/**,node_modules/**").option("tasks", tasks).load(root)) == expected
    (tmp_path / "empty").mkdir()
    assert read_tree(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(NotADirectoryError):
        read_bundle(spark, root + "/a.md")


def test_other_file_systems_give_the_same(spark, tmp_path, monkeypatch):
    """A store by pyarrow's interface lists and reads what a disk's does."""
    root = make(tmp_path / "t")
    disk, other = stores.Store(root), stores.Store(root)
    other.local, other._fs = False, stores.arrow_fs.LocalFileSystem()
    for folder in ("", "x", ".dot"):
        assert disk.entries(folder) == other.entries(folder)
    assert disk.read("_u/b.md") == other.read("_u/b.md") and other.kind("x") == "folder" and other.kind("none") is None and other.kind("a.md") == "file"
    other.make_folder("new/er")
    with other.create("new/er/z.md") as f:
        f.write(b"z")
    other.move("new/er/z.md", "z.md")
    assert disk.read("z.md") == b"z" and disk.kind("new/er/z.md") is None
    other.remove("new")
    disk.remove("none")
    assert disk.kind("new") is None


def test_a_cluster_needs_a_shared_disk(spark, tmp_path):
    class Far:
        class sparkContext:  # noqa: N801
            master = "yarn"

        conf = {"spark.checkpoint.dir": "file:///shared/"}

    with pytest.raises(ValueError):
        stores.shared_store(Far, str(tmp_path))
    assert stores.shared_store(Far, str(tmp_path), mounted=True).local and stores.shared_store(Far, "/shared/x").local
    with pytest.raises(ValueError):
        stores.shared_store(Far, "/shared-not/x")


def test_many_folders(spark, tmp_path):
    """Wide and deep trees; no level is listed by one task or kept by the driver."""
    files = {f"w{i % 40}/d{i}/f.md": str(i) for i in range(400)} | {"/".join("deep") + f"/{i}.md": "d" for i in range(5)}
    write_files(table(spark, files), str(tmp_path / "t"))
    found = list_tree(spark, str(tmp_path / "t"))
    assert {r["path"]: r["size"] for r in found.collect()} == {p: len(t) for p, t in files.items()}


def test_written_files(spark, tmp_path):
    root = str(tmp_path / "out")
    files = {"a.md": "A", "x/y/b.md": "", "x/.h.md": "é\r\n", "long.md": "word " * 400_000}
    done = write_files(table(spark, files), root)
    assert {r["path"]: r["size"] for r in done.collect()} == {p: len(t.encode()) for p, t in files.items()}
    assert rows(read_tree(spark, root)) == sorted(files.items()) and os.listdir(root).count("a.md") == 1
    with pytest.raises(ValueError, match="there already"):
        write_files(table(spark, {"new.md": "n", "a.md": "B"}), root)
    assert rows(read_tree(spark, root)) == sorted(files.items())
    write_files(table(spark, {"a.md": "B"}), root, replace=True)
    assert rows(read_tree(spark, root)) == sorted((files | {"a.md": "B"}).items())
    assert not [f for f in os.listdir(root) if f.startswith(STAGING)]
    write_files(table(spark, []), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


@pytest.mark.parametrize(
    ("files", "why"),
    [
        ([("a.md", "1"), ("A.md", "2")], "taken more than once"), ([("a.md", "1"), ("a.md", "1")], "taken more than once"), ([("../a.md", "1")], "portable"), ([("/a.md", "1")], "portable"),
        ([("a\\b.md", "1")], "portable"), ([("a//b.md", "1")], "portable"), ([("", "1")], "portable"), ([(None, "1")], "portable"), ([("C:/a.md", "1")], "portable"), ([("a.md", None)], "no content"),
        ([("a", "1"), ("A/b.md", "1")], "also a folder"), ([("l/b.md", "1")], "behind a link"), ([("f/b.md", "1")], "below a file"), ([("d", "1")], "not a file"),
    ],
)
def test_refused_writes_leave_nothing(spark, tmp_path, files, why):
    root = tmp_path / "r"
    make(root, {"f": "file", "d/z.md": "z"})
    (tmp_path / "else").mkdir()
    os.symlink(tmp_path / "else", root / "l")
    with pytest.raises(ValueError, match=why):
        write_files(table(spark, [("good.md", "g"), *files]), str(root), replace=True)
    assert sorted(os.listdir(root)) == ["d", "f", "l"] and os.listdir(tmp_path / "else") == []
    with pytest.raises(NotADirectoryError):
        write_files(table(spark, files), str(root / "l"))


def test_a_write_that_fails_midway(spark, tmp_path):
    """A row that fails while others are staged leaves neither files nor staging folder."""
    root = tmp_path / "r"
    made = spark.range(200).selectExpr("concat('f', id, '.md') AS path", "IF(id = 150, raise_error('lost'), 'x') AS content")
    with pytest.raises(Exception, match="lost"):
        write_files(made, str(root))
    assert not root.exists() or os.listdir(root) == []


def test_hot_paths_are_counted(spark):
    files = spark.range(20_000).selectExpr("IF(id % 3 > 0, 'same.md', concat(id, '.md')) AS path", "'' AS content")
    assert [tuple(r) for r in refused_paths(files).collect()] == [("same.md", "taken more than once")]


def test_pieces_and_graphs(spark, tmp_path):
    """A file of many rows, in order; the graph of a bundle as one document."""
    pieces = spark.range(5000).selectExpr("IF(id % 5 = 0, 'b.txt', 'a.txt') AS path", "-id AS nth", "IF(id = 7, NULL, concat(id, '\n')) AS text").repartition(4)
    write_pieces(pieces, ["nth"], str(tmp_path / "p"))
    expected = [str(i) for i in range(4999, -1, -1)]
    assert (tmp_path / "p" / "b.txt").read_text().split() == [x for x in expected if int(x) % 5 == 0]
    assert (tmp_path / "p" / "a.txt").read_text().split() == [x for x in expected if int(x) % 5 and x != "7"]
    nodes = spark.createDataFrame([("a", "a.md", "T", "A", ["x"]), ("b", "b.md", None, None, None)], "id string, path string, type string, title string, tags array<string>")
    edges = spark.createDataFrame([("b", "a", "k", True, "l"), ("a", "b", "k", True, "2"), ("a", "b", "k", True, "1"), ("a", "z", "k", False, None)], "source string, target string, kind string, resolved boolean, label string")
    write_pieces(X.graph_json(nodes, edges), ["part", "key"], str(tmp_path / "g"))
    graph = json.loads((tmp_path / "g" / "graph.json").read_text())
    assert [n["id"] for n in graph["nodes"]] == ["a", "b"] and [e["id"] for e in graph["edges"]] == ["a->b:k:0", "a->b:k:1", "a->z:k:2", "b->a:k:3"]
    assert [e.get("label") for e in graph["edges"]] == ["1", "2", None, "l"]
    write_pieces(X.graph_json(nodes.where("false"), edges.where("false")), ["part", "key"], str(tmp_path / "e"))
    assert json.loads((tmp_path / "e" / "graph.json").read_text()) == {"nodes": [], "edges": []}


def test_a_bundle_writes_itself(spark, tmp_path):
    root = make(tmp_path / "b", {"a.md": "---\ntitle: T\ntype: Note\n---\nSee [b](b.md).  \n\n\n", "b.md": "---\ntype: Note\ntitle: B\n---\n\nx\n", "index.md": "[a](a.md)\n"})
    bundle = Bundle.load(spark, root)
    assert bundle.format_files(root, check=True).collect() and "type: Note\n---\nSee" in (tmp_path / "b" / "a.md").read_text()
    assert {r["path"] for r in bundle.format_files(root).collect()} == {"a.md"}
    assert (tmp_path / "b" / "a.md").read_text() == "---\ntype: Note\ntitle: T\n---\n\nSee [b](b.md).\n"
    again = Bundle.load(spark, root)
    assert again.format_files(root).collect() == []
    again.write_site(str(tmp_path / "site"))
    assert sorted(os.listdir(tmp_path / "site")) == ["a.html", "b.html", "graph.json", "index.html"]
    assert (tmp_path / "site" / "index.html").read_text().index("a.html") < (tmp_path / "site" / "index.html").read_text().index("b.html")
    assert {e["target"] for e in json.loads((tmp_path / "site" / "graph.json").read_text())["edges"]} == {"a", "b"}


def test_renames_of_a_hot_hash(spark):
    """Most files of both snapshots have one content; null hashes pair with none; leftovers stay added or removed."""
    before = spark.range(3000).selectExpr("concat('old', lpad(id, 5, '0')) AS id", "IF(id % 10 = 0, concat('h', id), 'hot') AS content_hash")
    after = spark.range(3300).selectExpr("concat('new', lpad(id, 5, '0')) AS id", "IF(id % 10 = 0, concat('h', id), 'hot') AS content_hash")
    nulls = spark.createDataFrame([("n1", None), ("n2", None)], "id string, content_hash string")
    found = D.diff(before.union(nulls), after).collect()
    pairs = {r["id"]: r["old_id"] for r in found if r["change"] == "renamed"}
    hot_old = [f"old{i:05}" for i in range(3000) if i % 10]
    hot_new = [f"new{i:05}" for i in range(3300) if i % 10]
    expected = dict(zip(hot_new, hot_old)) | {f"new{i:05}": f"old{i:05}" for i in range(0, 3000, 10)}
    assert pairs == expected
    assert sorted(r["id"] for r in found if r["change"] == "removed") == ["n1", "n2"]
    assert sorted(r["id"] for r in found if r["change"] == "added") == sorted(set(hot_new[2700:]) | {f"new{i:05}" for i in range(3000, 3300, 10)})


def test_packages_take_all_files(spark, tmp_path):
    """Hidden and binary files are in, sensitive names, keys, packages and the output are not; doubtful paths are refused."""
    files = {"a.md": "---\ntype: Note\n---\nx\n", ".hidden/b.bin": b"\xff\x00\xfe", "_c.txt": "c", ".env": "S=1", "k.txt": "-----BEGIN PRIVATE KEY-----", "old.tar.gz": b"\x1f", "out.zip": "o", ".loam/x": "y", "x/.ssh/id": "z"}
    root = make(tmp_path / "p", files)
    bundle = Bundle.load(spark, root)
    taken, manifest = bundle.package(root, out="out.zip")
    assert {r["path"]: bytes(r["content"]) for r in taken.collect()} == {"a.md": files["a.md"].encode(), ".hidden/b.bin": b"\xff\x00\xfe", "_c.txt": b"c"}
    assert manifest.first()["files"] == 3
    for bad in ("con.txt", "a:b.md", "A.MD", "dot./x.md"):
        again = make(tmp_path / f"q{len(bad)}{bad[0]}", {"a.md": "a", bad: "b"})
        with pytest.raises(ValueError, match="portable|the same as"):
            Bundle.load(spark, again).package(again)


def test_reports_are_files(spark, tmp_path):
    root = make(tmp_path / "b", {"a.md": "---\ntype: Note\ntitle: T\n---\nSee [b](b.md).\n", "b.md": "---\ntype: Note\ntitle: B\n---\nx\n"})
    Bundle.load(spark, root).write_reports(str(tmp_path / "r"))
    read = lambda name: (tmp_path / "r" / name).read_text()
    assert read("graph.dot") == 'digraph bundle {\n  "a" -> "b";\n}\n'
    assert {e["ruleId"] for e in json.loads(read("diagnostics.sarif"))["runs"][0]["results"]} >= {"hygiene/missing-description"}
    assert read("graph.html").startswith("<!doctype html>") and json.loads(read("graph.json"))["edges"][0]["id"] == "a->b:markdown-link:0"


def test_a_text_is_formatted_once(spark):
    """However often what is made of it is named, and where only what changed is asked for."""
    from loam.operators.formatting import formatted

    plan = formatted(spark.createDataFrame([("a.md", "x")], "path string, content string")).where("changed").select("path", "formatted")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("{3,}, ") == 1


def test_rewritten_files_are_read_once(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(i, f"a  \n\n\n\n```\nx \n```\n{i}", "s") for i in range(5)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["rewritten_tree"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["changed"] for r in found.collect()] == [False] * 5


def test_fenced_blocks_stay_in_their_places(spark):
    from loam.operators.formatting import formatted

    many = "".join(f"a{i}  \n```\nb{i}  \n\n\n\n```\n\n\n\n" for i in range(50))
    tidy = "".join(f"a{i}\n```\nb{i}  \n\n\n\n```\n\n" for i in range(50))[:-1]
    cases = [(many, tidy), ("", ""), ("\n \n", ""), ("a \u2028", "a\u2028\n"), ("x\r\ny\t\r", "x\ny\n"), ("``` \n\n\n\nopen ", "``` \n\n\n\nopen \n"), ("\ue000a", "a\n"), ("a```b \n\n\n", "a```b\n")]
    found = formatted(spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(cases)], "path string, content string"))
    assert [r["formatted"] for r in sorted(found.collect(), key=lambda r: int(r["path"]))] == [t for _, t in cases]
