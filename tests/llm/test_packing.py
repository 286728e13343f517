"""Packing keeps every word, its capacity and its conflicts, and takes the tightest bin."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from loam.llm.packing import pack, pack_shard
from tests.llm.common import LOWER, docs, table, words


def test_pack(spark):
    rows = docs(5, 300)
    found = pack(table(spark, rows), capacity=50, per_source=2, shard_docs=64).collect()
    size = Counter()
    for r in rows:
        size[r[0]] += len(words(r[1]))
    packed, filled, sources, clusters = Counter(), Counter(), defaultdict(Counter), defaultdict(Counter)
    by_id = {r[0]: r for r in rows}
    for r in found:
        packed[r["doc_id"]] += r["size"]
        filled[r["bin_id"]] += r["size"]
        if r["doc_id"] is not None:
            sources[r["bin_id"]][by_id[r["doc_id"]][3]] += 1
            clusters[r["bin_id"]][(by_id[r["doc_id"]][1] or "").translate(LOWER)] += 1
        assert r["start"] == r["part"] * 50
    assert packed == size and {r["doc_id"] for r in found} == set(by_id)
    assert max(filled.values()) <= 50
    assert max(n for c in sources.values() for n in c.values()) <= 2 and max(n for c in clusters.values() for n in c.values()) == 1
    assert pack(table(spark, rows).where("false")).count() == 0


def brute(rows, capacity, per_source):
    bins, out = [], {}
    for r in sorted(rows, key=lambda r: (-r["size"], r["id"])):
        fits = [b for b in bins if b["left"] >= r["size"] and r["cluster"] not in b["clusters"] and b["sources"][r["source"]] < per_source]
        b = min(fits, key=lambda b: (b["left"], b["n"]), default=None)
        if b is None:
            b = {"left": capacity, "clusters": set(), "sources": Counter(), "n": len(bins)}
            bins.append(b)
        b["left"] -= r["size"]
        b["clusters"].add(r["cluster"])
        b["sources"][r["source"]] += 1
        out[r["id"]] = b["n"]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tightest_compatible_bin(seed):
    rnd = random.Random(seed)
    rows = [{"id": i, "size": rnd.randint(1, 20), "source": rnd.choice("ab"), "cluster": f"c{rnd.randrange(40)}", "shard": 0} for i in range(200)]
    packed = pack_shard(pd.DataFrame(rows), 20, 3)
    assert dict(zip(packed["id"], packed["bin"])) == brute(rows, 20, 3)
