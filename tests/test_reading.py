"""Front matter, links, places, hosts and paths against stated results; and that hostile texts take linear time."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loam.functions import markdown, paths, yaml
from loam.operators import parsing


def read(text):
    try:
        return yaml.front_matter(text)
    except yaml.FrontMatterError as e:
        return str(e)


@pytest.mark.parametrize(
    "text,value",
    [
        ('type: Note\ntitle: "A: b"\ntags: [a, \'b\', c d]\n', {"type": "Note", "title": "A: b", "tags": ["a", "b", "c d"]}),
        ("a:\n  - x\n  - y: 1\n    z: 2\n  -\n    q: 3\n", {"a": ["x", {"y": 1, "z": 2}, {"q": 3}]}),
        ("a:\n- x\n- y\nb: |\n  one\n   two\n\n  three\nc: >-\n  one\n  two\n\n  three\n", {"a": ["x", "y"], "b": "one\n two\n\nthree\n", "c": "one two\nthree"}),
        ("d: 1.5\ne: 0x1F\nf: ~\ng: true\nh: 0o17\ni: 1.0\nj: 1e3\n", {"d": 1.5, "e": 31, "f": None, "g": True, "h": 15, "i": 1, "j": 1000}),
        ("a: it's # c\n\"k\": v # d\n", {"a": "it's", "k": "v"}),
        ("a: http://x.y/z#q\nb: 'it''s'\nc: \"\\u00e9\\n\"\n", {"a": "http://x.y/z#q", "b": "it's", "c": "é\n"}),
        ("a: several\n  lines\n\n  more\nb: 2", {"a": "several lines\nmore", "b": 2}),
        ("k: {a: b, c: [d, {e: f}]}\n", {"k": {"a": "b", "c": ["d", {"e": "f"}]}}),
        ("a: &x [1]\nb: *x\n", {"a": [1], "b": [1]}),
        ("{type: Note, a: [1, 2]}", {"type": "Note", "a": [1, 2]}),
        ("o: !!omap [{a: 1}]\ns: !!set {a: null}\nb: !!binary SGk=\nc: !own v\nt: !!timestamp 2020-01-01\n",
         {"o": [{"a": 1}], "s": {"a": None}, "b": "SGk=", "c": {"!own": "v"}, "t": "2020-01-01"}),
        ("resource:\r\n  - db://x\r\nempty:\r\nlast: ''\r\n", {"resource": ["db://x"], "empty": None, "last": ""}),
    ],
)
def test_front_matter(text, value):
    assert read(text) == value


@pytest.mark.parametrize(
    "text,why",
    [
        *[(t, yaml.KEYS) for t in ("1: one", "[a, b]: list", "m: {1: one}", "m: !!omap [{1: one}]", "? a\n: b", "true: x")],
        *[(f"m: [{t}]", yaml.FINITE) for t in (".nan", ".inf", "-.inf")],
        *[(f"m: {t}", yaml.TAGS) for t in ("!!null x", "!!bool yes", "!!int abc", "!!float abc", "!!float 42", "!!set [x, y]", "!!str [x, y]", "!!unknown x")],
        *[(t, yaml.NO_MAPPING) for t in ("!own {type: Note}", "# only\n", "- a\n", "text", "")],
        ("a: 1\na: 2", yaml.UNIQUE), ("a: &x [*x]", yaml.RECURSIVE), ("v: " + "[" * 200 + "0" + "]" * 200, yaml.NESTED),
        ('a: "open', "open quote at line 1"), ("a:\n\tb: 1", "tabs at line 2"), ("a:\n  b: 1\n c: 2\n", "unevenly at line 3"), ("a: b: c", "within a line"), ("a: - b", "within a line"),
    ],
)
def test_refused_front_matter(text, why):
    assert why in read(text)


def test_depth_and_aliases():
    assert isinstance(read("v: " + "[" * 199 + "0" + "]" * 199), dict)
    names = "abcd"

    def nested(levels):
        lines = ["a: &a [x,x,x,x,x]"] + [f"{names[n]}: &{names[n]} [{','.join(['*' + names[n - 1]] * 5)}]" for n in range(1, levels + 1)]
        return "\n".join([*lines, f"root: *{names[levels]}"])

    assert isinstance(read(nested(2)), dict) and read(nested(3)) == yaml.ALIASES


def test_both_ways_of_reading_agree(spark):
    """What the patterns read by line is what the YAML reader makes of it."""
    fronts = [
        "type: Note\ntitle: A b (c)\ntags: [a, b-c, d e]\n", 'title: "x: y"\nowner: \'me\'\nresource: db://a/b\n', "tags:\n  - a\n  - \"b\"\ntimestamp: 2024-01-01T00:00:00Z\n",
        "tags:\n- a\n- b\nstatus: deprecated\n", "title: null\ntype: Null\nowner: truest\n", "title:   padded  \ntags: [true, x]\n", "title: a # b\n", "timestamp: 2024-01-01\n", "tags: []\ntitle: [x]\n",
        "title: x\ntitle: y\n", "a: b\n c: d\n", "tags:\n  - a\n - b\n", "title: 1\nowner: 1x\n", "title: 'it''s'\n", "replaced_by: x\n", "title: a: b\n",
    ]
    rows = spark.createDataFrame([(f"{i}.md", f"---\n{f}---\nbody") for i, f in enumerate(fronts)], "path string, content string")
    for r in parsing.parse(rows).collect():
        value = read(fronts[int(r["id"])])
        if isinstance(value, str):
            assert r["invalid"] == value and r["title"] is None and r["tags"] is None
            continue
        text = lambda k: value.get(k) if isinstance(value.get(k), str) and value.get(k) else None
        assert r["invalid"] is None and r["keys"] == list(value)
        assert [r[k] for k in ("title", "owner", "status", "timestamp")] == [text(k) for k in ("title", "owner", "status", "timestamp")]
        assert r["type"] == (text("type") or "")
        assert (r["tags"] or []) == [t for t in (value.get("tags") or []) if isinstance(t, str)]
        assert r["replaced"] == bool(text("replaced_by"))
        assert r["front_json"] is None or json.loads(r["front_json"]) == value


LINKS = [
    ("[a](b) ![i](j) [t](<a b> 'q') [p](a(b(c))d) [n]()", [("a", "b"), ("t", "a b"), ("p", "a(b(c))d"), ("n", "")]),
    ("[x [y](z)](w) \\[no](x) `[c](d)` [e]( \"t\") [o](x y)", [("y", "z"), ("e", "")]),
    ("```\n[f](g)\n```\n[![alt](src)](href) [d](a\\)b)\n~~~\n[h](i)", [("![alt](src)", "href"), ("d", "a\\)b")]),
    ("[a](b\n) [c\nd](e) ``[x](y) ` [z](w)`` [k](l)", [("k", "l")]),
    (f"[x]({'(' * 64}{')' * 64})", [("x", "(" * 64 + ")" * 64)]),
    (f"[x]({'(' * 65}{')' * 65})", []),
    ("[a [b] c](d) [" + "[q]" * 300 + "](r)", [("a [b] c", "d"), ("[q]" * 300, "r")]),
]


@pytest.mark.parametrize("text,found", LINKS)
def test_links(text, found):
    assert [(label, target) for label, target, *_ in markdown.links(text)] == found


def test_links_of_parsed_files(spark):
    rows = spark.createDataFrame([(f"{i}.md", text) for i, (text, _) in enumerate(LINKS)], "path string, content string")
    for r in parsing.parse(rows).collect():
        assert [(x["text"] or "", x["target"]) for x in r["links"]] == LINKS[int(r["id"])][1]


def test_places(spark):
    content = "---\ntype: x\n---\n# \U0001f600 A\r\n\U0001f600 [b](c) [d](e)\n"
    rows = parsing.located(spark.createDataFrame([("a.md", content), ("n.md", None)], "path string, content string")).collect()
    assert [(r["what"], r["label"], r["line"], r["column"], r["offset"]) for r in rows] == [
        ("heading", "\U0001f600 A", 4, 1, 16), ("link", "b", 5, 4, 27), ("link", "d", 5, 11, 34),
    ]


@pytest.mark.parametrize(
    "text,words",
    [("# Title #\n\n*a* [b](c) ![i](j) `d`\n```\nx\n```\n> e-f\n", "Title a b d e f"), ("```\ncode\n```\n", ""), ("![i](j)", ""), (" \n***\n", ""), ("é", "é")],
)
def test_plain_text(spark, text, words):
    row = spark.createDataFrame([(text,)], "t string").select(parsing.plain_text(F.col("t")).alias("p"), parsing.is_empty(F.col("t")).alias("e")).first()
    assert (row["p"], row["e"]) == (words, not words)


@pytest.mark.parametrize(
    "url,host,private",
    [
        ("http://127.1/", "127.0.0.1", True), ("HTTP://EXAMPLE.com:80/x", "example.com", False), ("http://[::127.0.0.1]:8/", "::7f00:1", True), ("http://0x7f.1", "127.0.0.1", True),
        ("db://Some_Host/x", "some_host", False), ("http:\\\\a.b\\c", "a.b", False), ("http://1.2.3.4.5/", None, False), ("https://user@h..", "h", False), ("x", None, False),
        ("mailto:a@b", None, False), ("file:///etc", None, False), ("http://[::ffff:10.0.0.1]", "::ffff:a00:1", True), ("http://a%2eb/", "a.b", False), ("http://local/", "local", True),
        ("http://x.localhost", "x.localhost", True), ("http://[::1]", "::1", True), ("http://[fd00::1]", "fd00::1", True), ("http://8.8.8.8", "8.8.8.8", False), ("http://h:99999/", None, False),
    ],
)
def test_hosts(url, host, private):
    assert (paths.host_of(url), paths.private_one(paths.host_of(url))) == (host, private)


def test_aliases_and_trimmed_urls():
    assert paths.aliases_of("127.1") == ["127.1", "127.0.0.1"] and paths.aliases_of("::1") == ["::1"]
    assert [paths.trimmed_url(f"http://a{x}") for x in ("/(b))", "/b).", "[1]]", "?!", ")" * 50_000)] == ["http://a/(b)", "http://a/b", "http://a[1]", "http://a", "http://a"]


@pytest.mark.parametrize(
    "source,target,path",
    [("a/b.md", "./dir/", "a/dir/"), ("a/b.md", "?q", None), ("b.md", "../x", None), ("a/b.md", "../x.md#y", "x"), ("a/b.md", "/c.md", "c"), ("a.md", ".", None), ("a.md", "//x", None), ("a/b.md", "..\\c.md", "c"), ("a.md", "x%20y.md", "x y"), ("a.md", "#t", None)],
)
def test_targets(source, target, path):
    assert paths.resolve_one(source, target) == path


@pytest.mark.parametrize("path,made", [("./a/b.md", "a/b.md"), ("a:b?.MD", "a-b-.md"), ("x/../nul.txt", "_nul.txt.md"), ("a/. /b", "a/segment/b.md"), ("/a", None), ("../a", None), ("a/", None), ("C:\\a", None), (" ", None)])
def test_concept_paths(path, made):
    if made is None:
        with pytest.raises(ValueError):
            paths.concept_path_one(path)
    else:
        assert paths.concept_path_one(path) == made


@pytest.mark.parametrize(
    "work",
    [
        lambda: list(markdown.links("[" * 25_000)), lambda: list(markdown.links("[x](" * 8000)), lambda: list(markdown.links("".join("`" * i + " " for i in range(1, 1601)))),
        lambda: markdown._places(t := "\n".join(f"# h\n[a](b{i})" for i in range(5000)), t), lambda: list(markdown.links("[a](b) " * 4000)), lambda: read("\n".join(f"key{i}: v" for i in range(8000))),
    ],
)
def test_linear_time(work):
    start = time.process_time()
    work()
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "front,made",
    [
        ("title: &a x\ntype: N\nz: *a\n", "type: N\ntitle: &a x\nz: *a\n"), ("z: &a x\ntitle: *a\n", "z: &a x\ntitle: *a\n"), ("b: &x 1\na: &x 2\n", "b: &x 1\na: &x 2\n"),
        ("c: &x\n  k: 1\n# note\nb:\n  <<: *x\na: 1\n", "a: 1\nc: &x\n  k: 1\n# note\nb:\n  <<: *x\n"), ("{b: &x 1, a: *x}\n", "{b: &x 1, a: *x}\n"), ("b: &x [*x]\na: 1\n", "a: 1\nb: &x [*x]\n"),
        ("1: &x a\nb: *x\na: c\n", "a: c\n1: &x a\nb: *x\n"), ("d: [&p a, &q b]\nc: {k: *q}\nb: [*p, *c]\na: &c x\n", "a: &c x\nd: [&p a, &q b]\nb: [*p, *c]\nc: {k: *q}\n"), ("a: [\n", "a: [\n"), ("&m a: 1\nb: 2\n", "&m a: 1\nb: 2\n"),
    ],
)
def test_anchored_order(front, made):
    assert yaml.ordered_entries(front, ("type", "title")) == made


def test_anchored_order_is_linear():
    start = time.process_time()
    text = "".join(f"k{i}: &a{i} {i}\n" for i in range(4000)) + "".join(f"a{i}: *a{i}\n" for i in range(4000))
    assert yaml.ordered_entries(text, [f"k{i}" for i in range(20_000)]).startswith("k0: ")
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "text,words",
    [
        ("[l](http://x/((y)))", "l"), ("a [x [y](z)](w) b", "a [x y](w) b"), ("[![i](j)](k) t", "t"), ("![a](b(c(d)))x", "x"), ("\\[n](o) [p](q\\)r)", "\\[n](o) p"),
        ("[" + "a" * 500 + "](b)", "a" * 500), ("[a](" + "(" * 40 + ")" * 40 + ") z", "a z"), ("```\n[a](b)\n```\n[c](d (e)) [f](g h)", "c [f](g h)"),
    ],
)
def test_plain_text_of_nested_links(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(parsing.plain_text(F.col("t"))).first()[0] == words


def test_unlinking_is_linear():
    start = time.process_time()
    for text in ("[" * 25_000, "[x](" * 8000, "[a](b) " * 4000, "![" * 10_000 + "](x)" * 10_000):
        markdown.without_links(text)
    assert time.process_time() - start < 5
