"""Paths and rings of thin nodes, shortened in batches: against a walk."""

import random

from loam.operators import graph as G


def walked(after):
    out, rings = {}, {}
    for v in after:
        seen, at = [v], after[v]
        while at in after and at != v:
            seen.append(at)
            at = after[at]
        if at == v:
            rings[v] = min(seen)
        else:
            out[v] = (at, seen[-1], len(seen))
    return out, rings


def test_paths_across_batches(spark):
    names = [f"n{i:03}" for i in range(120)]
    mixed = names[40:]
    random.Random(1).shuffle(mixed)
    after = dict(zip(names[:25], names[1:26])) | dict(zip(names[26:40], [*names[27:40], names[26]]))  # neighbours: a path, and a ring
    for i, size in ((0, 1), (1, 2), (3, 17), (20, 30)):  # any order: rings, then a path
        part = mixed[i : i + size]
        after |= dict(zip(part, [*part[1:], part[0]]))
    after |= dict(zip(mixed[50:79], mixed[51:80]))
    thin = spark.createDataFrame(list(after.items()), "v string, next string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("5", "1000"):
            spark.conf.set(key, size)
            out, rings = G._followed(thin)
            assert ({r["v"]: (r["to"], r["last"], r["steps"]) for r in out.collect()}, {r["v"]: r["root"] for r in rings.collect()}) == walked(after)
    finally:
        spark.conf.set(key, before)


def test_neighbours_leave_few_heads(spark):
    thin = spark.range(5000).selectExpr("format_string('q%06d', id) AS v", "format_string('q%06d', id + 1) AS next")
    short = G._shortened(thin)
    assert short.count() == 5000 and short.where("head").count() <= 100


def test_rounds_are_not_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    assert "BroadcastHashJoin" not in G._peeled(edges)._jdf.queryExecution().executedPlan().toString()
