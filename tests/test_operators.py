"""Bundle operators on small inputs with stated results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import diff as D, exchange as X, graph as G, packing as P, parsing, rules as R, search as S
from loam.operators.components import connected_components
from loam.sources.bundle import glob_pattern, read_bundle


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content string")


def parsed(spark, content):
    return parsing.parse(files(spark, **content))


BUNDLE = {
    "index.md": "# Index\n\n[a](a.md)\n",
    "a.md": '---\ntype: Note\ntitle: "A"\ntags: [x, Y_z]\nresource:\n  - https://example.com/a\n  - http://10.0.0.1/\n---\n# A #\n\n[to b](x/b.md "t") ![i](i.md) `[c](c.md)`\n\n```\n# no\n[d](d.md)\n```\n\n## Part *two*\n',
    "x/b.md": "---\ntitle: B\n---\nback [to a](../a.md#top), [gone](none.md), [out](https://example.org)\n",
    "x/log.md": "log",
}


def test_parse(spark):
    rows = {r["path"]: r for r in parsed(spark, BUNDLE).collect()}
    a = rows["a.md"]
    assert (a["id"], a["kind"], a["type"], a["title"], a["tags"], a["resource"]) == ("a", "concept", "Note", "A", ["x", "Y_z"], ["https://example.com/a", "http://10.0.0.1/"])
    assert [(h["level"], h["title"]) for h in a["headings"]] == [(1, "A"), (2, "Part *two*")]
    assert [(x["text"], x["target"]) for x in a["links"]] == [("to b", "x/b.md")]
    assert a["keys"] == ["type", "title", "tags", "resource"]
    assert rows["index.md"]["kind"] == "index" and rows["x/log.md"]["kind"] == "log" and rows["x/log.md"]["front"] is None
    assert rows["x/b.md"]["type"] == "" and rows["x/b.md"]["tags"] is None


def test_links_and_stats(spark):
    p = parsed(spark, BUNDLE)
    found = {(r["source"], r["target_raw"]): (r["kind"], r["target"], r["resolved"]) for r in parsing.resolved_links(p).collect()}
    assert found == {
        ("index", "a.md"): ("internal", "a", True),
        ("a", "x/b.md"): ("internal", "x/b", True),
        ("x/b", "../a.md#top"): ("internal", "a", True),
        ("x/b", "none.md"): ("internal", None, False),
        ("x/b", "https://example.org"): ("external", None, True),
    }
    stats = parsing.bundle_stats(p, parsing.resolved_links(p)).first().asDict()
    assert stats == {"concepts": 2, "indexes": 1, "logs": 1, "links": 5, "broken_links": 1}


def codes(spark, content, **config):
    p = parsed(spark, content)
    found = R.lint(R.Context(p, parsing.resolved_links(p), R.Config(**config)))
    return sorted((r["code"], r["concept_id"]) for r in found.collect())


def test_lint(spark):
    found = codes(spark, BUNDLE)
    assert ("graph/broken-internal-link", "x/b") in found and ("graph/circular-reference", "a") in found
    assert ("style/tag-format", "a") in found and ("spec/missing-type", "x/b") in found
    assert ("security/private-url", "a") in found and ("spec/missing-frontmatter", "a") not in found
    assert not any(c == "style/tag-format" for c, _ in codes(spark, BUNDLE, rules={"style/tag-format": "off"}))
    allowed = codes(spark, BUNDLE, allow_hosts=("example.com",))
    assert [c for c in allowed if c[0] == "security/non-allowlisted-resource"] == [("security/non-allowlisted-resource", "a")]


def test_levels():
    assert R.Config(presets=("recommended", "strict")).level("hygiene/missing-title") == "error"
    assert R.Config(rules={"hygiene/missing-title": "info"}, presets=("strict",)).level("hygiene/missing-title") == "info"
    with pytest.raises(ValueError):
        R.Config(presets=("no such",))
    with pytest.raises(ValueError):
        R.Config(rules={"hygiene/missing-title": "loud"})


def test_doctor_and_score(spark):
    p = parsed(spark, {"m.md": "---\ntype: metric\ntitle: M\ndescription: d\nstatus: deprecated\ntimestamp: 2020-01-01T00:00:00Z\n---\nbody\n"})
    found, counts = R.doctor(R.Context(p, parsing.resolved_links(p), R.Config(now_ms=1_719_792_000_000)))
    assert {"agent/metric-missing-source", "agent/missing-owner", "agent/stale-timestamp", "agent/deprecated-missing-replacement", "agent/missing-index", "agent/missing-usage"} <= {r["code"] for r in found.collect()}
    c = counts.first()
    assert c["score"] == max(0, 100 - 20 * c["error"] - 8 * c["warning"] - 3 * c["advice"])


def test_empty_bundle(spark):
    p = parsed(spark, {"a.md": None}).where("false")
    assert R.lint(R.Context(p, parsing.resolved_links(p), R.Config())).count() == 0


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = "abcdefghij"
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randint(4, 14))]
    reach = {(x, y) for x, y in pairs}
    while more := {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c} - reach:
        reach |= more
    strong = {x: min(y for y in names if (x, y) in reach and (y, x) in reach) for x in names if (x, x) in reach}
    scc = G.strong_components(edges(spark, pairs))
    assert {r["node"]: r["scc"] for r in scc.collect()} == strong
    for r in G.representative_cycles(edges(spark, pairs), scc).collect():
        start = r["scc"]
        inner = {(a, b) for a, b in pairs if strong.get(a) == strong.get(b) == start}
        paths = [[start, min(b for a, b in inner if a == start)]]
        while not (done := [p for p in paths if p[-1] == start]):
            paths = [p + [b] for p in paths for a, b in sorted(inner) if a == p[-1]]
        assert r["cycle"] == min(done)
    both = reach | {(y, x) for x, y in reach}
    while more := {(a, d) for (a, b), (c, d) in itertools.product(both, both) if b == c} - both:
        both |= more
    least = {x: min(y for y in names if (x, y) in both) for x in names if (x, x) in both or any(x in p for p in pairs)}
    got = {r["node"]: r["component"] for r in connected_components(edges(spark, pairs), "source", "target").collect()}
    assert got == least


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("false")).count() == 0


def test_diff(spark):
    def snapshot(rows):
        return spark.createDataFrame(rows, "id string, content_hash string, title string")

    before = snapshot([("a", "1", "A"), ("b", "2", "B"), ("c", "3", "C"), ("d", "3", "C"), ("e", "5", None)])
    after = snapshot([("a", "1", "A"), ("b", "9", "B2"), ("x", "3", "C"), ("y", "7", "Y"), ("e", "5", None)])
    found = {(r["change"], r["id"], r["old_id"], tuple(r["changed"])) for r in D.diff(before, after, ["title"]).collect()}
    assert found == {("changed", "b", None, ("content_hash", "title")), ("renamed", "x", "c", ()), ("removed", "d", None, ()), ("added", "y", None, ())}


def test_search_limits(spark):
    docs = spark.createDataFrame([(1, "weekly active users"), (2, "weekly"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(0, "weekly users")], "q long, text string")
    pairs = S.terms(docs, "id", "text")
    assert [(r["id"], r["score"]) for r in S.search(pairs, asked, "q", "text", 5).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    for bad in (0, 51, 1.5, True):
        with pytest.raises(ValueError):
            S.search(pairs, asked, "q", "text", bad)


def test_packages(spark):
    names = [".env", ".env.example", "certificate.pem", "concept.md", ".ssh/x", "a/id_rsa", "k.p12"]
    rows = spark.createDataFrame([(n, "x") for n in names] + [("key.md", "-----BEGIN RSA2 PRIVATE KEY-----")], "path string, content string")
    assert {r["path"] for r in P.packable(rows).collect()} == {".env.example", "certificate.pem", "concept.md"}
    import hashlib

    one = spark.createDataFrame([("b.md", "b", "b"), ("a.md", "a", None)], "path string, content string, id string")
    lines = "".join(f"{p}\0{hashlib.sha256(c.encode()).hexdigest()}\0{i}\n" for p, c, i in (("a.md", "a", ""), ("b.md", "b", "b")))
    assert P.manifest_hash(one).first()["hash"] == hashlib.sha256((P.HEADER + lines).encode()).hexdigest()


def test_imports_parse_back(spark):
    node = "named_struct('resource_type', 'model', 'name', 'My [model]', 'description', 'd', 'depends_on', named_struct('nodes', array('model.x')))"
    made = X.model_concepts(spark.sql(f"SELECT 'model.y' AS id, {node} AS node"))
    row = parsing.parse(made).first()
    assert (row["path"], row["type"], row["title"], row["links"]) == ("tables/my-model.md", "Table", "My [model]", [])
    api = spark.sql("SELECT '/o' AS route, 'GET' AS method, named_struct('operationId', 'getO', 'summary', 'Get \"o\"', 'description', cast(null as string)) AS operation")
    assert X.route_concepts(api).first()["path"] == "apis/geto.md"
    same = spark.createDataFrame([("A.md", "", "1"), ("a.md", "", "2"), ("b.md", "", "3")], "path string, content string, identity string")
    paths = {r["identity"]: r["path"] for r in X.disambiguated(same).collect()}
    assert paths["3"] == "b.md" and len({p.lower() for p in paths.values()}) == 3


def test_globs_and_source(spark, tmp_path):
    assert glob_pattern("x/**").match("x") and glob_pattern("x/**").match("x/y/z") and not glob_pattern("x/*").match("x/y/z")
    for name in ("a.md", ".hidden.md", "_x/b.md", ".git/c.md", "n.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(name)
    rows = read_bundle(spark, str(tmp_path), filesPerTask=1).collect()
    assert {r["path"]: r["content"] for r in rows} == {n: n for n in ("a.md", ".hidden.md", "_x/b.md")}
    with pytest.raises(Exception):
        read_bundle(spark, str(tmp_path / "none")).collect()


def test_streamed_versions(spark, tmp_path):
    from loam.streaming.latest import upsert_each_batch

    source = str(tmp_path / "in")
    rows = [("a.md", "old", "2024-01-01 00:00:00"), ("a.md", "new", "2024-01-01 00:00:05"), ("b.md", "b", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "path string, content string, ts string").selectExpr("path", "content", "cast(ts as timestamp) AS ts").write.parquet(source)
    stream = spark.readStream.schema("path string, content string, ts timestamp").parquet(source)
    seen = {}
    q = upsert_each_batch(stream, lambda batch, epoch: seen.update({r["path"]: r["content"] for r in batch.collect()}), str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    assert seen == {"a.md": "new", "b.md": "b"}
