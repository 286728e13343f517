"""Importance resampling against brute force, on small awkward tables; the registered query has SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

from loam.llm.importance import resample
from tests.llm.common import LOWER, SCHEMA, docs, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n, buckets, percent, min_words, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for r in rows for f in features(r[1], n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for r in rows:
        words, found = features(r[1], n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    drawn = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], math.inf if x[0] is None else x[0], -x[2], -x[1]))
    rank = {id(x): i + 1 for i, x in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted(repr((*x[:4], rank.get(id(x)))) for x in out)


def test_resample(spark):
    rows = docs()
    target = ["alpha beta alpha beta", None, "", "x GÄMMA gämma é"]
    goal = spark.createDataFrame([(t, "r") for t in target], "text string, rank string")
    for n, percent, min_words in ((2, 25, 5), (3, 100, 0), (1, 0, 20)):
        found = resample(table(spark, rows), goal, n=n, buckets=50, percent=percent, min_words=min_words, seed=7).collect()
        got = sorted(repr(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))) for r in found)
        assert got == brute(rows, target, n, 50, percent, min_words, 7)
    assert {"text", "lang", "id", "size"} <= set(found[0].asDict())


def test_empty_tables_and_clashing_names(spark):
    goal = spark.createDataFrame([], "text string")
    assert resample(spark.createDataFrame([], SCHEMA), goal).collect() == []
    rows = table(spark, docs()).withColumnRenamed("keep", "Rank").withColumnRenamed("shard", "bucket")
    found = resample(rows, goal, percent=50, min_words=1)
    assert "Rank" not in found.columns and "bucket" in found.columns and found.where("rank IS NOT NULL").count() > 0
    assert all(r["weight"] is not None for r in found.collect())
