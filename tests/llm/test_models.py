"""Language ID and the quality classifier on held-out rows, and their cases."""

import random
import zlib

import pytest

from loam.llm.langid import identify, keep_identified
from loam.llm.quality import score_quality
from loam.llm.queries import table as load
from tests.llm.common import docs, table

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    documents = load(spark, SF, "documents")
    found = identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    out = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    kept = keep_identified(documents)
    assert kept.columns == documents.columns and kept.count() >= 0.99 * documents.count()


def test_language_cases(spark):
    rows = [r for r in docs() if r[1] != "x"] + [(900, "12 345 !", "en", None, 0, *"izkdh")]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(table(spark, rows)).collect()}
    for r in rows:
        if r[0] is not None and not any(c.isalpha() for c in r[1] or ""):
            assert found[r[0]] == ("und", 0.0)
    assert {x for x, _ in found.values()} <= {"en", "de", "und"}
    nothing = table(spark, [r[:2] + (None,) + r[3:] for r in rows])
    assert {r["lang_pred"] for r in identify(nothing).collect()} == {"und"}
    assert identify(nothing.where("false")).count() == 0 and keep_identified(nothing).count() == 0


def test_symbols_are_no_letters(spark):
    """Beyond U+FFFF too, only letters tell a language; U+10400 is one."""
    texts = ["\U0001f600\U0001f680 \U0001f4a9", "\U0001d7ce\U0001f600", "\U00010400\U00010401", "plain words"]
    rows = [(i, t, "en", None, 0, *"izkdh") for i, t in enumerate(texts * 4)]
    assert {(r["doc_id"] % 4 < 2, r["lang_pred"]) for r in identify(table(spark, rows)).collect()} == {(True, "und"), (False, "en")}
    assert {r["doc_id"] % 4 for r in keep_identified(table(spark, rows)).collect()} == {2, 3}


def test_many_labels(spark):
    """Twelve labels, four by four of one vocabulary: a clean text has a score of about a quarter."""
    rnd = random.Random(4)
    words = ["alpha beta gamma delta".split(), "uno dos tres quatro".split(), "yksi kaksi kolme nelja".split()]
    rows = [(i, " ".join(rnd.choices(words[i % 3], k=20)), f"l{i % 12}", None, 0, *"izkdh") for i in range(600)]
    assert keep_identified(table(spark, rows)).count() >= 590


def test_quality_accuracy(spark):
    documents, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    found = score_quality(documents, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in found)
    out = [r for r in found if r["held_out"]]
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.9 and sum(r["predicted"] == r["quality"] for r in out) >= 0.9 * len(out)


@pytest.mark.parametrize("labelled", [[], [(100, 1)], [(i, i % 2) for i in range(100, 150)], [(None, 0), (101, None), (102, 1), (102, 0)]])
def test_quality_cases(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    rows = docs()
    found = score_quality(table(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert score_quality(table(spark, rows).where("false"), labels).count() == 0
