"""Suffix dedup against brute force; the merge against sorting."""

import random
from collections import Counter

import numpy as np
import pytest

from loam.llm.queries import table as load
from loam.llm.suffix import Run, _common, _front_coded, merged, remove_repeats
from tests.llm.common import docs, table


def brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append(repr((i, len(d), int(gone.sum()), runs, np.frombuffer(d, np.uint8)[~gone].tobytes())))
    return sorted(out)


def found(df, **sizes):
    return sorted(repr((*r[:4], bytes(r[4]))) for r in map(tuple, remove_repeats(df, **sizes).collect()))


@pytest.mark.parametrize("seed,class_items", [(0, 20_000), (1, 20_000), (2, 6)])
def test_against_brute_force(spark, seed, class_items):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("ab") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(50):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(300)
            text += rnd.choice(pool)[at : at + rnd.randint(1, 80)] if rnd.random() < 0.5 else "".join(rnd.choices("abcdé", k=rnd.randint(0, 40)))
        rows.append((rnd.choice([i, i, i, None]), rnd.choice([text, text, text, "xy" * rnd.randint(0, 60), None])))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, window=20, kmer=5, class_items=class_items) == brute(rows, 20)


def test_documents(spark, sf):
    documents = load(spark, sf, "documents").select("doc_id", "text")
    assert found(documents) == brute([tuple(r) for r in documents.collect()], 200)


def test_awkward_and_empty(spark):
    assert remove_repeats(table(spark, docs())).count() == len(docs())
    assert remove_repeats(table(spark, docs()).where("false")).count() == 0


def test_merge_keeps_order_and_prefixes():
    rnd = random.Random(2)
    parts = [[bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))] for _ in range(7)]
    runs = []
    for strings in parts:
        order, shared, rest = _front_coded(strings)
        runs.append(Run(order.tolist(), shared.tolist(), rest, [len(s) for s in strings]))
    out = [(parts[run][item], common) for run, item, common in merged(runs)]
    assert [s for s, _ in out] == sorted(s for p in parts for s in p)
    for (x, _), (y, common) in zip(out, out[1:]):
        assert common == _common(x, y, 0)
