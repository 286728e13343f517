"""Rules that are added, imports and their checks, changes of concepts, exports, and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from loam.operators import diff as D, exchange as X, graph as G, packing as P, parsing, rules as R

NOW = "2024-01-01T00:00:00.000Z"


def context(spark, content, **config):
    parsed = parsing.parse(spark.createDataFrame(list(content.items()), "path string, content string"))
    return R.Context(parsed, parsing.resolved_links(parsed), R.Config(**config))


def test_rules_that_fail_are_diagnostics(spark):
    c = context(spark, {"a.md": "---\ntype: x\ntitle: T\ndescription: d\n---\n[b](a.md)\n"})
    concept = lambda c: c.concepts.select(F.lit("seen").alias("message"), "path", F.col("id").alias("concept_id"))

    def broken(c):
        raise RuntimeError("no")

    extra = {
        "own/good": ("info", concept), "own/broken": ("advice", broken), "own/rows": ("error", lambda c: [1]), "own/path": ("error", lambda c: concept(c).withColumn("path", F.lit("../x"))),
        "own/late": ("error", lambda c: concept(c).withColumn("message", F.raise_error(F.lit("late")))), "own/coded": ("info", lambda c: concept(c).withColumn("code", F.lit("own/other"))),
    }
    found = R.lint(c, extra, only=lambda code: code.startswith("own/")).collect()
    assert sorted((r["code"], r["severity"]) for r in found) == [("own/good", "info"), ("own/other", "info")] + [("plugin/rule-failed", "error")] * 4
    off = context(spark, {"a.md": ""}, rules={"own/broken": "off", "own/good": "error"})
    assert [(r["code"], r["severity"]) for r in R.lint(off, {k: extra[k] for k in ("own/good", "own/broken")}, only=lambda c: c.startswith("own/")).collect()] == [("own/good", "error")]
    with pytest.raises(ValueError):
        R.lint(c, {"own/x": ("fatal", concept)})


def test_presets():
    both = R.Config(presets=("strict", "agent-ready"))
    assert both.level("graph/no-backlinks") == "advice" and both.fails_on == "warning" and R.Config().fails_on == "error"
    assert R.Config(presets=("agent-ready", "strict")).level("graph/no-backlinks") == "warning"
    assert R.Config(fail_on="info", presets=("strict",)).fails_on == "info"


def test_headings_are_whole_words(spark):
    front = "---\ntype: {}\ntitle: T\ndescription: d\nowner: o\n---\n# {}\n"
    content = {f"{i}.md": front.format(t, h) for i, (t, h) in enumerate([("API", "Usage"), ("API", "Api usage"), ("api", "Misusage"), ("runbook", "Symptoms"), ("Runbook", "Asymptomatic"), ('" api"', "x")])}
    c = context(spark, content, presets=("agent-ready",))
    found = R.lint(c, only=lambda code: code in ("agent/missing-usage", "agent/runbook-missing-symptoms")).collect()
    assert sorted((r["concept_id"], r["code"]) for r in found) == [("2", "agent/missing-usage"), ("4", "agent/runbook-missing-symptoms")]


def test_validate_builds_only_its_rules(spark, monkeypatch):
    monkeypatch.setattr(G, "strong_components", None)
    c = context(spark, {"a.md": "---\n- x\n---\n", "b.md": "", "index.md": "---\na: [\n---\n"})
    found = R.lint(c, only=lambda code: code.startswith("spec/")).collect()
    assert sorted((r["code"], r["path"]) for r in found) == [("spec/invalid-frontmatter", "a.md"), ("spec/invalid-frontmatter", "index.md"), ("spec/missing-frontmatter", "b.md")]


@pytest.mark.parametrize(
    "path,hit",
    [(".env", 1), (".env.example", 0), ("a/.ENV.local", 1), ("_netrc", 1), ("x/.yarnrc.yml", 1), (".docker/config.json", 1), ("docker/config.json", 0), ("a/.kube/config", 1), ("x.tfstate", 1), ("x.tfstate.backup", 1),
     (".cargo/credentials.toml", 1), ("credentials", 0), ("a.key", 0), (".git/x", 0), (".ssh/known", 1), ("a/.composer/auth.json", 1), ("b.P12", 1), ("application_default_credentials.json", 1)],
)
def test_sensitive_names(spark, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(P.is_sensitive(F.col("p"))).first()[0] == bool(hit)


def test_generated_paths_that_collide_again(spark):
    from loam.functions.paths import identity_one

    files = [("a.md", "1"), ("A.md", "2"), (f"a-{identity_one('1')}.md", "3"), (f"A-{identity_one('2')}.md", "4"), ("d/.x", "5"), ("d/.X", "6")]
    df = spark.createDataFrame([(p, "", i) for p, i in files], "path string, content string, identity string")
    got = {r["identity"]: r["path"] for r in X.disambiguated(df).collect()}
    assert got["1"] == f"a-{identity_one('1')}-2.md" and got["2"] == f"A-{identity_one('2')}-2.md" and got["3"] == files[2][0] and got["4"] == files[3][0]
    assert got["5"] == f"d/-{identity_one('5')}.x" and len({p.lower() for p in got.values()}) == 6
    with pytest.raises(ValueError, match="share the path"):
        X.disambiguated(df.union(df.limit(1)))


def test_imports_refuse_wrong_input(spark):
    text = lambda value: spark.createDataFrame([(json.dumps(value),)], "content string")
    good = {"info": {"description": "all"}, "paths": {"/a": {"get": {"summary": "S"}, "parameters": []}}}
    assert [r["route"] for r in X.specification_routes(text(good)).collect()] == ["/a"]
    assert X.specification_routes(text({})).count() == 0
    for bad in ([], {"paths": []}, {"paths": {"/a": 1}}, {"paths": {"/a": {"get": []}}}, {"paths": {"/a": {"get": {"summary": 1}}}}):
        with pytest.raises(Exception, match="must be an object"):
            X.specification_routes(text(bad)).collect()
    for bad in ({"nodes": 1}, {"nodes": {"m": 1}}, {"nodes": {"m": {"name": 1}}}):
        with pytest.raises(Exception, match="must be an object"):
            X.manifest_nodes(text(bad)).collect()
    table = spark.sql("SELECT 'p' AS project, ' ' AS dataset, 't' AS table, CAST(NULL AS string) AS description, CAST(NULL AS array<struct<name: string, type: string, description: string>>) AS columns")
    with pytest.raises(Exception, match="a table's dataset must be a text"):
        X.table_concepts(table, NOW).collect()
    with pytest.raises(Exception, match="must stay within"):
        X.note_concepts(spark.sql("SELECT '../x' AS path, CAST(NULL AS string) AS title, '' AS body, CAST(NULL AS array<string>) AS tags"), NOW).collect()


def test_import_texts(spark):
    table = spark.sql("SELECT 'p' AS project, 'd' AS dataset, 't_1' AS table, CAST(NULL AS string) AS description, array(named_struct('name', 'a`b', 'type', 'INT64', 'description', 'x_y')) AS columns")
    row = X.table_concepts(table, NOW).first()
    assert (row["path"], row["identity"]) == ("tables/d-t-1.md", "bigquery://p/d/t_1")
    assert row["content"] == (
        '---\ntype: Table\ntitle: "d.t_1"\ndescription: "Imported from BigQuery metadata."\nresource: "bigquery://p/d/t_1"\ntags:\n  - imported\n  - bigquery\n'
        f"timestamp: {NOW}\n---\n\n# d\\.t\\_1\n\n## Columns\n\n- `` a`b `` (INT64): x\\_y\n"
    )
    note = spark.sql("SELECT 'x/a-b.c.md' AS path, CAST(NULL AS string) AS title, 'Hi' AS body, array('t\"1') AS tags")
    assert X.note_concepts(note, NOW).first()["content"] == (
        f'---\ntype: Note\ntitle: "A B C"\ndescription: "Imported from x/a-b.c.md."\ntags:\n  - "t\\"1"\ntimestamp: {NOW}\n---\n\nHi\n'
    )
    urn = spark.sql("SELECT 'urn:x' AS urn, CAST(NULL AS string) AS name, 'd' AS description, 'My Platform' AS platform")
    row = X.dataset_concepts(urn, NOW).first()
    assert row["path"] == "catalog/urn-x.md" and '  - "my-platform"\n' in row["content"] and row["content"].endswith("DataHub URN: ` urn:x `\n")


def test_exports(spark):
    rows = spark.createDataFrame([("c", "error", "m", "a b/ü?.md"), ("b", "info", "n", None)], "code string, severity string, message string, path string")
    log = json.loads("".join(r["line"] for r in X.sarif_run(rows).orderBy("nth").collect()))
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["b", "c"]
    assert sorted((r["level"], r.get("uri")) for r in log["runs"][0]["results"]) == [("error", "a%20b/%C3%BC%3F.md"), ("note", None)]
    nodes = spark.sql("SELECT 'a' AS id, 'a.md' AS path, 'Note' AS type, CAST(NULL AS string) AS title, CAST(NULL AS array<string>) AS tags")
    edges = spark.createDataFrame([("a", "gone.md", "markdown-link", False, None), ("a", "tag:x", "tag", True, "x"), ("a", "a", "markdown-link", True, "me")], "source string, target string, kind string, resolved boolean, label string")
    got = [(r["id"], r["label"], r["type"]) for r in X.cytoscape_nodes(nodes, edges).collect()]
    assert got == [("a", "a", "Note"), ("gone.md", "gone.md", "Unresolved"), ("tag:x", "x", "tag")]
    page = "\n".join(r["line"] for r in X.graph_html(G.graph_stats(nodes, edges, G.degrees(nodes, edges)), nodes, edges).orderBy("part", "line").collect())
    assert "<pre>a -&gt; tag:x</pre>" in page and '"nodes":1' in page
    assert [r["line"] for r in X.site_index(nodes).collect()] == ['<li><a href="a.html">a</a></li>']


def test_readiness_and_severities(spark):
    c = context(spark, {"a.md": "", "index.md": ""})
    found = R.lint(c)
    counts = {r["severity"]: r["diagnostics"] for r in R.by_severity(found).collect()}
    assert counts["error"] == 1 and [r["code"] for r in R.used_rules(found).collect()] == sorted(r["code"] for r in R.used_rules(found).collect())
    score = lambda n: spark.sql(f"SELECT {n} AS score")
    assert tuple(D.readiness_change(score(40), score(52)).first()) == (40, 52, 12, True)


def test_isolated_clusters(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, cluster string")
    assert tuple(G.isolated_clusters(rows).first()) == (2, 1)


def test_large_manifests_are_folded(spark):
    rows = spark.range(300).select(F.format_string("d/%04d.md", "id").alias("path"), F.col("id").cast("string").alias("content"), F.col("id").cast("string").alias("id"))
    one = P.manifest(rows).first()
    assert tuple(one) == tuple(P.manifest_hash(rows).select("files", "hash").first())
    folded = P.manifest(rows, most=10).first()
    assert folded["files"] == 300 and folded["hash"] == P.manifest(rows.repartition(7), most=10).first()["hash"] != one["hash"]
    changed = rows.withColumn("content", F.when(F.col("id") == "7", "x").otherwise(F.col("content")))
    assert P.manifest(changed, most=10).first()["hash"] != folded["hash"]


def test_cache_states(spark):
    from loam.operators import incremental as I

    files = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "path string, content string")
    kept = I.refreshed(files, parsing.parse(files.limit(0)).withColumn("parser", F.lit("")), {"version": "0.1"})
    later = spark.createDataFrame([("a.md", "1"), ("b.md", "x"), ("d.md", "")], "path string, content string")
    states = lambda **s: {r["path"]: r["state"] for r in I.cache_states(later, kept, s).collect()}
    assert states(version="0.1") == {"a.md": "hit", "b.md": "content", "c.md": "gone", "d.md": "new"}
    assert states(version="0.2")["a.md"] == "parser"
    assert I.stale_files(later, kept, {"version": "0.1"}).count() == 2


def test_trees_and_configurations(spark, tmp_path):
    from loam.bundle import Bundle
    from loam.sources.bundle import comparison_root, read_bundle, read_tree

    root = tmp_path / "one"
    for name, text in {"a.md": "A", "x/b c.md": "\u00e9", "x/skip/c.md": "C", "node_modules/d.md": "D", "e.txt": "E"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "loam.json").write_text(json.dumps({"exclude": ["x/skip/**"], "presets": ["strict"], "failOn": "info"}))
    rows = lambda df: sorted((r["path"], r["content"]) for r in df.collect())
    assert rows(read_tree(spark, f"file://{root}")) == rows(read_bundle(spark, str(root))) == [("a.md", "A"), ("x/b c.md", "\u00e9"), ("x/skip/c.md", "C")]
    bundle = Bundle.load(spark, str(root))
    assert rows(bundle.files) == [("a.md", "A"), ("x/b c.md", "\u00e9")] and bundle.config.fails_on == "info" and bundle.failed()
    assert bundle.stats().first().asDict() == {"files": 2, "concepts": 2, "indexes": 0, "logs": 0, "diagnostics": 0, "links": 0, "broken_links": 0}
    assert bundle.manifest(read_bundle(spark, str(root), include="**/*")).first()["files"] == 5
    assert comparison_root(str(root), "two") == str(tmp_path / "two")
    with pytest.raises(ValueError):
        comparison_root(str(root), "../elsewhere")


def test_one_scheme_of_manifests(spark):
    """A tree of hashes that no number of files changes the scheme of."""
    rows = spark.range(300).select(F.format_string("d/%04d.md", "id").alias("path"), F.col("id").cast("string").alias("content"), F.col("id").cast("string").alias("id"))
    whole = P.manifest_tree(rows).first()
    assert whole["files"] == 300 and whole == P.manifest_tree(rows.repartition(7)).first()
    changed = rows.withColumn("content", F.when(F.col("id") == "7", "x").otherwise(F.col("content")))
    assert P.manifest_tree(changed).first()["hash"] != whole["hash"] and P.manifest_tree(rows.where("false")).collect() == []


def test_reserved_files_join_and_never_bridge(spark):
    from loam.bundle import Bundle
    from loam.operators import rules as R

    note = lambda text: f"---\ntype: Note\n---\n{text}\n"
    files = {"b.md": note("[c](c.md)"), "c.md": note("x"), "d.md": note("[i](x/index.md)"), "z.md": note("x"), "index.md": "[d](d.md) [b](b.md)\n", "x/index.md": "no link\n", "log.md": "[index](index.md)\n"}
    bundle = Bundle(spark.createDataFrame(list(files.items()), "path string, content string"), R.Config())
    found = {r["id"]: r["cluster"] for r in bundle.clusters(reserved=True).collect()}
    assert found == {"b": "b", "c": "b", "d": "d", "z": "z", "index": "b", "x/index": "d"}
    assert {r["id"] for r in bundle.clusters().collect()} == {"b", "c", "d", "z"}


def test_sharded_cache(spark, tmp_path):
    """Each reason of a miss, shards that stay as they are, and what a killed write leaves."""
    import os

    from loam.operators.incremental import ParseCache

    table = lambda files: spark.createDataFrame(list(files.items()), "path string, content string")
    files = {f"f{i}.md": f"---\ntype: Note\ntitle: T{i}\n---\n{i}\n" for i in range(40)}
    cache = ParseCache(spark, str(tmp_path / "c"), {"version": "0.1"})
    states = lambda c, f: {r["path"]: (r["state"], tuple(r["differs"])) for r in c.states(table(f)).collect()}
    assert cache.table() is None and set(states(cache, files).values()) == {("missing", ())}
    assert {r["title"] for r in cache.refresh(table(files)).collect()} == {f"T{i}" for i in range(40)}
    assert set(states(cache, files).values()) == {("hit", ())}
    later = dict(files) | {"f3.md": "changed", "new.md": "n"}
    del later["f9.md"]
    found = states(cache, later)
    assert (found["f3.md"], found["new.md"], found["f9.md"], found["f1.md"]) == (("key", ("content_hash",)), ("missing", ()), ("gone", ()), ("hit", ()))
    other = ParseCache(spark, str(tmp_path / "c"), {"version": "9"}, tool_version="2", rule_version="2")
    assert set(states(other, files).values()) == {("key", ("config_hash", "rule_version", "tool_version"))}
    listing = lambda: {s: sorted(os.listdir(tmp_path / "c" / f"shard={s}")) for s in cache.shards()}
    before = listing()
    parsed = {r["path"]: r["body"] for r in cache.refresh(table(later)).collect()}
    assert parsed == {p: t.rpartition("---\n")[2] for p, t in later.items()}
    import hashlib

    touched = {hashlib.sha256(p.encode()).hexdigest()[:2] for p in ("f3.md", "new.md", "f9.md")}
    after = listing()
    assert {s for s in after if after[s] == before.get(s)} == set(after) - touched and set(states(cache, later).values()) == {("hit", ())}
    cache.refresh(table({"f1.md": files["f1.md"]}))
    assert [r["path"] for r in cache.table().collect()] == ["f1.md"] and len(cache.shards()) == 1
