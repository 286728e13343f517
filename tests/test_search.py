"""Ranked search against a plain count, its bound on what is read, and the index on disk."""

import random

import pytest

from pyspark.sql import functions as F

from loam.bundle import Bundle
from loam.functions.text import tokens
from loam.operators import rules as R, search as S
from loam.operators.search_index import SearchIndex


def corpus(seed=1, n=1500):
    """Words by falling frequency, so that some are in most documents."""
    rnd = random.Random(seed)
    words = [f"w{i:03}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(n)]


def brute(docs, queries, limit):
    found = []
    for q, text in queries:
        wanted = set((text or "").split())
        scores = [(-len(wanted & set((t or "").split())), i) for i, t in docs]
        found += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(x for x in scores if x[0])[:limit])]
    return sorted(found)


def queries(seed=2):
    rnd = random.Random(seed)
    return [(q, " ".join(f"w{rnd.choice([0, 1, 2, 5, 9, 50, 120, 250, 299]):03}" for _ in range(rnd.randint(1, 9)))) for q in range(8)] + [(90, ""), (91, None), (92, "unknown"), (93, "w000")]


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").repartition(3)


def rows(df):
    return sorted((r["query"], r["id"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 10, 50])
def test_search_against_a_count(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BLOCK", 64)
    docs = corpus()
    pairs = S.terms(table(spark, docs, "id"), "id", "text")
    assert rows(S.search(pairs, table(spark, queries(), "q"), "q", "text", limit)) == brute(docs, queries(), limit)
    assert rows(S.search(pairs.where("false"), table(spark, queries(), "q"), "q", "text", limit)) == []
    for bad in (0, 51, True, 2.0):
        with pytest.raises(ValueError):
            S.search(pairs, table(spark, queries(), "q"), "q", "text", bad)


def test_lists_are_joined_not_documents(spark, monkeypatch):
    """One rare and many common words: common words' lists are read only in blocks where the rare one is."""
    monkeypatch.setattr(S, "BLOCK", 16)
    met = []
    real = S._scored
    monkeypatch.setattr(S, "_scored", lambda asked, index, limit: met.append(asked) or real(asked, index, limit))
    docs = [(i, "common usual plain" + (" rare odd strange" if i % 500 == 7 else "")) for i in range(4000)]
    asked = [(1, "common usual plain rare odd strange")]
    found = S.search(S.terms(table(spark, docs, "id"), "id", "text"), table(spark, asked, "q"), "q", "text", 4)
    assert rows(found) == brute(docs, asked, 4)
    assert sum(m.count() for m in met) <= 6 * 8 < 3 * 4000 // 16 < 3 * 4000  # lists joined, lists of the common terms, documents that have them


def test_index_on_disk(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    with pytest.raises(FileNotFoundError):
        index.postings()
    first, second = corpus(1, 400), [(i, t) for i, t in corpus(5, 500) if i % 3 == 0 or i >= 400]
    index.add(table(spark, first, "id"), "id", "text")
    index.add(table(spark, [*second, (None, "w000")], "id"), "id", "text")
    index.add(table(spark, [(3, ""), (4, "w299 w298")], "id"), "id", "text")
    now = dict(first) | dict(second) | {3: "", 4: "w299 w298"}
    expected = brute(list(now.items()), queries(), 10)
    asked = table(spark, queries(), "q")
    assert rows(index.search(asked, "q", "text")) == expected
    fresh = SearchIndex(spark, str(tmp_path / "f"))
    fresh.add(table(spark, list(now.items()), "id"), "id", "text")
    assert rows(fresh.search(asked, "q", "text")) == expected
    (tmp_path / "i" / "a000009" / "postings").mkdir(parents=True)  # of a write that was killed
    assert len(index.segments()) == 3 and rows(index.search(asked, "q", "text")) == expected
    index.merge()
    assert len(index.segments()) == 1 and rows(index.search(asked, "q", "text")) == expected
    index.add(table(spark, [(7, "w250"), (9999, "w250 w120")], "id"), "id", "text")
    now |= {7: "w250", 9999: "w250 w120"}
    assert rows(index.search(asked, "q", "text")) == brute(list(now.items()), queries(), 10)


def test_bundle_search_gives_concepts(spark):
    files = [("a.md", "---\ntype: Note\ntitle: One\n---\nalpha beta\n"), ("b.md", "---\ntype: Note\ntitle: Two\ndescription: D\n---\nalpha\n"), ("index.md", "alpha\n")]
    bundle = Bundle(spark.createDataFrame(files, "path string, content string"), R.Config())
    assert [tuple(r) for r in bundle.search("alpha beta").select("id", "score", "rank", "path", "title", "description", "type").collect()] == [
        ("a", 2, 1, "a.md", "One", None, "Note"), ("b", 1, 2, "b.md", "Two", "D", "Note"),
    ]
    assert [(r["id"], r["score"]) for r in bundle.search(" ! ").collect()] == [("a", 1), ("b", 1)] and bundle.search("", 1).count() == 1


def test_a_segment_is_written_by_blocks(spark, monkeypatch, tmp_path):
    """Lists of one bucket come from several tasks, and a block's pairs stay few where rows repeat; replaced ids go when segments are merged."""
    from loam.operators import search_index as I

    monkeypatch.setattr(I, "BLOCK", 16)
    docs = corpus(n=400)
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.add(table(spark, docs * 2, "id"), "id", "text")
    assert len(list((tmp_path / "index/a000001/postings/bucket=0").glob("*.parquet"))) > 1
    changed = [(i, "new words" if i % 3 else "") for i, _ in docs[:100]]
    index.add(table(spark, changed, "id"), "id", "text")
    now = dict(docs) | dict(changed)
    wanted = sorted({(w, i) for i, t in now.items() for w in t.split()})
    pairs = lambda: sorted((r["term"], i) for r in index.postings().collect() for i in r["ids"])
    assert pairs() == wanted and all(r["n"] == len(r["ids"]) and r["ids"] == sorted(r["ids"]) for r in index.postings().collect())
    index.merge()
    assert pairs() == wanted and len(index.segments()) == 1


def test_repeats_are_left_out_while_a_block_is_gathered(spark, monkeypatch):
    rows_ = [("b", 0, ["y", "x"]), ("a", 0, ["x"]), ("a", 0, ["x", "z"]), ("a", 1, []), ("c", 1, ["x"])] * 300
    monkeypatch.setattr(S, "_HELD", 50)
    made = S.inverted(spark.createDataFrame(rows_, "id string, block long, terms array<string>"), 2)
    assert sorted((r["term"], r["block"], tuple(r["ids"]), r["n"]) for r in made.collect()) == [("x", 0, ("a", "b"), 2), ("x", 1, ("c",), 1), ("y", 0, ("b",), 1), ("z", 0, ("a",), 1)]


def test_texts_of_an_index_are_split_once(spark, monkeypatch, tmp_path):
    """What is read of a document to be indexed is worked out once: no filter on its terms makes them a second time."""
    from loam.operators import search_index as I

    made = []
    monkeypatch.setattr(I, "inverted", lambda docs, blocks: made.append(S.inverted(docs, blocks)) or made[0])
    SearchIndex(spark, str(tmp_path / "i"), buckets=2).add(table(spark, corpus(n=50), "id"), "id", "text")
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") + plan.count("regexp_replace(") == 1


def test_blocks_are_dealt_in_turn(spark):
    docs = spark.range(256).select("id", (F.col("id") % 32 + (5 << 32)).alias("block"), F.array(F.lit("x")).alias("terms"))
    tasks = S.inverted(docs, 32).select(F.spark_partition_id().alias("task"), "block").groupBy("task").count().collect()
    assert [r["count"] for r in tasks] == [4] * 8


def test_terms_of_texts_are_those_of_tokens(spark):
    """Every character between letters, at both ends and alone, in texts of several; empty texts and nulls have no terms."""
    points = [p for p in [*range(1, 0x3400), *range(0xA000, 0xD7FF, 7), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 997)]]
    texts = ["".join(f"a{c}B {c}cd ef{c} {c} g{c}{c}h." for c in map(chr, points[i : i + 500])) for i in range(0, len(points), 500)] + ["", " ", None, "ΟΔΟΣ.ΑΣ İstanbul ẞß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("block", F.col("id") % 3)
    found = S.inverted(docs, 3).select("term", F.explode("ids").alias("id"))
    wanted = docs.select(F.explode(tokens(F.col("text"))).alias("term"), "id")
    assert found.count() == wanted.count() > 100_000 and found.exceptAll(wanted).count() == 0
