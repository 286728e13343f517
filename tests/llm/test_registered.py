"""Registered queries without SQL against brute force, or against one process that scores with the trained model."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard

from loam.llm import langid, quality
from loam.llm.queries import QUERIES, table as load
from tests.llm.common import words
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_suffix import brute as brute_repeats


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in load(spark, sf, "documents").select("doc_id", "text").collect()}


def test_op1(spark, sf):
    prints = {i: brute_print(t) for i, t in texts(spark, sf).items()}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, sf).collect()}
    component = brute_components(prints, 4)
    assert found == {i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def test_op7(spark, sf):
    expected = []
    for row in brute_repeats(list(texts(spark, sf).items()), 200):
        i, n, removed, spans, kept = eval(row)  # noqa: S307  it is this test's own repr
        expected.append((i, n, removed, spans, hashlib.sha256(kept).hexdigest()))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, QUERIES["op7_suffix_dedup"](spark, sf).select(*columns).collect())) == sorted(expected)


def test_op9(spark, sf):
    rows = {r["doc_id"]: r for r in load(spark, sf, "documents").collect()}
    size = {i: len(words(r["text"])) for i, r in rows.items()}
    found = QUERIES["op9_packing"](spark, sf).collect()
    bins = defaultdict(set)
    packed = Counter()
    for r in found:
        packed[r["doc_id"]] += r["size"]
        bins[r["bin_id"]].add((r["doc_id"], r["part"]))
        assert r["start"] == 4096 * r["part"]
    assert packed == size
    # the rests of all documents, largest first, each into the fullest bin that takes it
    expected, open_ = [], []
    for i, n in sorted(size.items(), key=lambda x: (-(x[1] % 4096), x[0])):
        rest, whole = n % 4096, n // 4096
        expected += [{(i, part)} for part in range(whole)]
        if not rest and whole:
            continue
        text, source = hashlib.sha256(" ".join(words(rows[i]["text"])).encode()).digest(), rows[i]["source"]
        text = (rows[i]["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [b for b in open_ if b["left"] >= rest and text not in b["texts"] and b["sources"][source] < 4]
        b = min(fits, key=lambda b: (b["left"], b["nth"]), default=None)
        if b is None:
            b = {"left": 4096, "texts": set(), "sources": Counter(), "parts": set(), "nth": len(open_)}
            open_.append(b)
        b["left"] -= rest
        b["texts"].add(text)
        b["sources"][source] += 1
        b["parts"].add((i, whole))
    expected += [b["parts"] for b in open_]
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, expected))


def ngram_slots(text, bits):
    """Hash slots of the 1- to 3-grams of letters, runs of anything else being one space; counted by plain integers."""
    codes, last = [], None
    for c in text.lower():
        code = ord(c) if c.isalpha() else 32
        if code != 32 or last != 32:
            codes.append(code)
        last = code
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = n
            for code in codes[i : i + n]:
                h = (h ^ code) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
            found[(h * 0x85EBCA6B % (1 << 32)) >> (32 - bits)] += 1
    return found, any(c != 32 for c in codes)


def test_op6(spark, sf):
    documents = load(spark, sf, "documents")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learn = documents.where(~langid.held_out("doc_id", 4, 2)).selectExpr("doc_id AS id", "text", "lang AS label")
    model = langid.train(learn)
    found = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, sf).collect()}
    for i, text in texts(spark, sf).items():
        counts, letters = ngram_slots(text or "", model.bits)
        assert found[i]["held_out"] == out(i)
        if not letters:
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        weights = {s: (1 + math.log(n)) * model.idf[s] for s, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        logits = [sum(w / norm * float(model.weights[s, k]) for s, w in weights.items()) + float(model.weights[-1, k]) for k in range(len(model.labels))]
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        best = max(range(len(e)), key=e.__getitem__)
        assert found[i]["lang_pred"] == model.labels[best] and abs(found[i]["score"] - e[best] / sum(e)) < 1e-4


def test_op10(spark, sf):
    model = quality.train(load(spark, sf, "documents"), load(spark, sf, "labels"))
    found = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, sf).collect()}
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    assert model.good and model.bad
    for i, text in texts(spark, sf).items():
        data = (text or "").encode()
        good, bad = (sum(len(p.compress(data[at : at + 512])) for at in range(0, len(data), 512)) for p in packers)
        score = 1 / (1 + math.exp(-(model.intercept + model.slope * (bad - good) / max(1, len(data)))))
        assert abs(found[i]["score"] - score) < 1e-9 and found[i]["predicted"] == (found[i]["score"] >= 0.3)
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_no_query_is_left_out():
    assert np.all([name in QUERIES for name in ("op1_simhash", "op6_language_id", "op7_suffix_dedup", "op9_packing", "op10_quality")])
