"""Exact top-k search and WARC archives."""

import gzip
import hashlib
import base64
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loam.llm.topk import top_k
from loam.llm import warc
from loam.llm.warc import archive_pages, read_pages, register, write_pages


@pytest.mark.parametrize("sizes", [{}, {"query_tile": 3, "shard_rows": 5, "fan_in": 2}])
def test_top_k(spark, sizes):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.3, 1.0]) for _ in range(4)], "q", 1) for i in range(60)]
    rows += [(60, None, "q", 1), (61, [1.0, None, 1.0, 1.0], "q", 1), (80, [float("nan")] * 4, "q", 1), (100, [float("inf")] * 4, "q", 1), (None, [1.0] * 4, "q", 1), (120, [0.5, 0.5], "q", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, tile int")
    import math

    import numpy as np

    ints = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, *_ in rows[:60]}
    expected = []
    for q in ints:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:7]
            expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    found = top_k(df, F.col("id") % 20 == 0, k=7, scale=64, **sizes)
    assert sorted(map(tuple, found.collect())) == expected
    assert top_k(df.where("false"), F.col("id") % 20 == 0).count() == 0


PAGES = [
    (1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (3, None, "<p>ünïque</p>\r\n\r\nWARC/1.0\r\n", "x"), (4, "http://a/4", None, "x"),
    (5, "http://a/5\r\nEvil: 1", "", "x"), (6, "", "z" * 3_000_000, "x"), (2, "http://a/2", "<p>same</p>", "x"), (None, "http://n", "<p>same</p>", "x"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    same = defaultdict(list)
    for i, _, html, _ in PAGES:
        same[html or ""].append(i)
    expected = []
    for i, url, html, _ in PAGES:
        data = (html or "").encode()
        keep = max(same[html or ""], key=lambda x: (x is not None, x or 0))
        revisit = len(data) >= least and i != keep
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, "revisit" if revisit else "response", len(data), digest, keep if revisit else None, None if revisit else data))
    found = archive_pages(pages(spark), min_revisit_bytes=least).drop("target_uri").collect()
    text = lambda r: repr(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r))
    assert sorted(map(text, found)) == sorted(map(repr, expected))


def test_predicates_and_foreign_archives(spark, tmp_path):
    write_pages(pages(spark), str(tmp_path / "a"))
    register(spark)
    read = spark.read.format("warc").load(str(tmp_path / "a"))
    assert read.where("record_type = 'revisit'").count() == 3 and read.where("record_type IN ('response') AND target_uri = 'http://a/4'").count() == 0
    assert read_pages(spark, str(tmp_path / "a"), payloads=False, record_types=["response"]).where("payload IS NOT NULL").count() == 0
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc").write_bytes(plain)
    (tmp_path / "b/y.warc.gz").write_bytes(gzip.compress(plain))
    (tmp_path / "b/z.warc.gz.part").write_bytes(b"unfinished")
    rows = spark.read.format("warc").load(str(tmp_path / "b")).where("record_type = 'resource'").collect()
    assert [(r["target_uri"], bytes(r["payload"]), r["payload_bytes"]) for r in rows] == [("u", b"abc", 3)] * 2
    assert archive_pages(pages(spark).where("false")).count() == 0


@pytest.mark.parametrize("slots", [0, 1 << 29])
def test_groups_beyond_a_broadcast(spark, monkeypatch, slots):
    """Joins by sorting, with and without bitmaps, give the same records, and only kept payloads are joined."""
    real = warc.bitmap_of
    monkeypatch.setattr(warc, "bitmap_of", lambda keys: real(keys, slots))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_round_trip(spark, 0)
        test_round_trip(spark, 5)
        rows = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 > 0, 'hot', concat('own', id)) AS html")
        found = archive_pages(rows).groupBy("record_type").count().collect()
        assert {r["record_type"]: r["count"] for r in found} == {"response": 135, "revisit": 265}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
