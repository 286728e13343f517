"""Names that clash with working columns, sets that are too large to broadcast, long texts, and repeated ids."""

import gzip
import io
import random
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from loam.llm import common, exact, lines, simhash, suffix, warc
from loam.llm.langid import identify, keep_identified
from loam.llm.mixing import mixed
from loam.llm.quality import score_quality
from loam.llm.simhash import drop_near_duplicates
from loam.llm.topk import integer_scores, top_k
from tests.llm.common import LOWER, docs, table, words
from tests.llm.test_suffix import brute, found

WORKING = "uid may_go goes n candidate digest id_of_group bucket bits h taken copy unnamed name copies edge shift nearer total target loses node root least".split()


def clashing(spark):
    rows = docs(3, 80)
    df = table(spark, rows).drop("id", "size", "keep", "shard")
    for c in WORKING:
        if c not in df.columns:
            df = df.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("text"), F.lit("-"))))
    return df


@pytest.mark.parametrize("stage", [exact.drop_exact_duplicates, drop_near_duplicates, mixed, keep_identified])
def test_clashing_names(spark, stage):
    df = clashing(spark)
    made = stage(df)
    assert made.columns == df.columns
    rows = made.collect()
    assert rows and all(r[c] == f"{c}:{'-' if r['text'] is None else r['text']}" for r in rows for c in WORKING if c != "digest")
    assert stage(df.where("false")).count() == 0


def test_other_case_of_names(spark):
    df = table(spark, docs()).withColumnRenamed("text", "Text")
    assert keep_identified(df).columns == df.columns


def test_sets_too_large_to_broadcast(spark, monkeypatch):
    rows = docs(2, 60)
    df = table(spark, rows)
    expected = {name: sorted(map(repr, made.collect())) for name, made in results(df)}
    for module in (exact, lines, simhash, suffix):
        monkeypatch.setattr(module, "bitmap_of", partial(common.bitmap_of, most_slots=0))
    assert {name: sorted(map(repr, made.collect())) for name, made in results(df)} == expected


def results(df):
    yield "exact", exact.exact_dedup(df, digest_all=True)
    yield "kept", exact.drop_exact_duplicates(df).select("doc_id", "text")
    yield "lines", lines.apply_bitmaps(df, lines.line_dedup(df, min_chars=1, min_docs=2))
    yield "near", drop_near_duplicates(df).select("doc_id", "text")


def test_bitmaps(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"))
    bitmap = common.bitmap_of(keys)
    assert bitmap.slots == 1 << 17
    hit = common.probed(spark.range(20_000).withColumn("bits", F.lit(7)), bitmap, "hit", F.col("id"))
    n = {r["known"]: r["n"] for r in hit.groupBy((F.col("id") < 5000).alias("known")).agg(F.count_if("hit").alias("n")).collect()}
    assert n[True] == 5000 and n[False] < 0.1 * 15_000 and hit.columns == ["id", "bits", "hit"]
    assert common.bitmap_of(keys, most_slots=1000) is None
    assert common.bitmap_of(keys.where("false")).slots == 1 << 15


@pytest.mark.parametrize("options", [{"most_slots": 0}, {"class_items": 5}, {}])
def test_long_texts_and_crowds_of_repeats(spark, options):
    rnd = random.Random(4)
    line = "".join(rnd.choices("abcdefgh", k=60))
    own = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    rows = [(i, own(rnd.randint(0, 50)) + line + own(rnd.randint(0, 50))) for i in range(60)]
    rows += [(100, own(30_000) + line * 300 + "x" * 5000), (101, "x" * 100 + "yz" * 300), (102, line[5:30]), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, window=20, kmer=5, **options) == brute(rows, 20)


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choices("ab", k=700))) for i in range(4)]
    kept = suffix.Anchors(20, 5, __import__("numpy").zeros(0, "uint64"))
    for _, text in rows:
        h, a, s0, s1 = kept.of(text.encode())
        starts = [s for x, y in zip(s0, s1) for s in range(x, y + 1)]
        assert starts == list(range(len(text) - 19)) and all(x <= p <= x + 15 for p, x in zip(a, s1))


def test_lines_of_a_long_text(spark):
    rnd = random.Random(2)
    pool = [f"line number {i} that is long enough to count as one" for i in range(300)]
    rows = [(i, "\n".join(rnd.choices(pool, k=40)), None, None, 0, *"izkdh") for i in range(60)]
    rows += [(99, "\n".join(rnd.choices(pool, k=20_000)), None, None, 0, *"izkdh")]
    holders = defaultdict(set)
    for r in rows:
        for line in r[1].split("\n"):
            holders[line].add(r[0])
    kept = {r[0]: "\n".join(x for x in r[1].split("\n") if len(holders[x]) < 5 or max(holders[x]) == r[0]) for r in rows}
    df = table(spark, rows)
    assert {r["doc_id"]: r["kept_text"] for r in lines.apply_bitmaps(df, lines.line_dedup(df)).collect()} == kept


def test_first_occurrences(spark):
    text = "a line that is long enough to be counted here"
    rows = [(i, f"x\n{text}\n{text}" if i == 9 else text, None, None, 0, *"izkdh") for i in range(10)]
    made = [tuple(r)[2:] for r in lines.repeated_lines(table(spark, rows)).collect()]
    assert made == [(9, 1)]


# ---- vectors ----


def test_scores_are_exact_whatever_their_size(spark):
    rows = [(20, [float(1 << 24), 1.0]), *[(i, [float(1 << 24), i / 64]) for i in (1, 2, 3)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, F.col("id") % 20 == 0, k=3, scale=64).orderBy("rank").collect()]
    assert got == [(20, n + 1, i, (1 << 60) + 64 * i) for n, i in enumerate((3, 2, 1))]
    rnd = random.Random(0)
    values = [0.0, 0.3, -2.5, 2.0**20, -(2.0**33) - 0.75, 2.0**57, 1e30, -1e300, 1.7e308]
    q = [[rnd.choice(values) for _ in range(3)] for _ in range(40)]
    c = [[rnd.choice(values) for _ in range(3)] for _ in range(50)]

    def exact_score(x, y):
        import math

        whole = lambda v: math.floor(v * 64) if abs(v) < 1e300 else int(v) * 64
        return min(max(sum(whole(a) * whole(b) for a, b in zip(x, y)), -(1 << 63)), (1 << 63) - 1)

    import numpy as np

    assert integer_scores(np.array(q), np.array(c), 64).tolist() == [[exact_score(x, y) for y in c] for x in q]


def test_scores_beyond_a_long_and_repeated_ids(spark):
    rows = [(0, [1e300]), (7, [1e300]), (5, [-1e300]), (6, [1e200]), (8, [0.0]), (8, [0.0]), (0, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(tuple(r)[1:] for r in top_k(df.where("NOT (vec_id = 0 AND embedding[0] = 0)"), F.col("id") % 20 == 0, k=9, scale=64).collect())
    assert got == [(1, 6, (1 << 63) - 1), (2, 7, (1 << 63) - 1), (3, 8, 0), (4, 8, 0), (5, 5, -(1 << 63))]
    assert top_k(df, F.col("id") % 20 == 0, k=9, scale=64).where("vec_id = 0").count() == 0
    plain = top_k(spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<double>"), F.col("id") == 0)
    assert [tuple(r) for r in plain.collect()] == [(0, 1, 1, 0.125)]


# ---- models ----


def test_repeated_ids_and_other_columns(spark):
    rows = docs()
    found_ = identify(table(spark, rows + rows[:9]))
    assert found_.count() == len(rows) + 9
    labels = spark.createDataFrame([(i, i % 2, "x", 9) for i in range(100, 150)], "doc_id long, quality int, text string, score int")
    made = score_quality(table(spark, rows + rows[:9]), labels)
    assert made.count() == len(rows) + 9 and made.columns == ["doc_id", "held_out", "score", "predicted"]
    none = score_quality(table(spark, rows), labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5}


# ---- recall of the pipeline's near-duplicate stage ----


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def changed(rnd, base, edits):
    text = list(base)
    for at in rnd.sample(range(len(text)), edits):
        text[at] = f"new{rnd.randrange(10**6)}"
    return text


def test_recall_against_brute_force(spark):
    """Pairs of similarity 0.8 to 0.9, alone and in a crowd of texts that share a passage or come from one text."""
    rnd = random.Random(9)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(120):
        base = own(200)
        texts += [base, changed(rnd, base, rnd.randint(4, 8))]
    passage = own(150)
    for _ in range(80):
        base = passage + own(50)
        texts += [base, changed(rnd, base, rnd.randint(4, 8))]
    base = own(150)
    texts += [changed(rnd, base, rnd.randint(0, 10)) for _ in range(150)]
    texts = [" ".join(t) for t in texts]
    sets = [grams(t) for t in texts]
    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    shared = Counter((i, j) for ids in by_gram.values() for n, i in enumerate(ids) for j in ids[n + 1 :])
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    assert len(pairs) > 250
    rows = [(i, t, None, None, 0, *"izkdh") for i, t in enumerate(texts)]
    made = simhash.near_duplicates(table(spark, rows), shingle=5, lanes=3, max_distance=42, segments=12, min_similarity=0.8).collect()
    component = {r["doc_id"]: r["component_id"] for r in made}
    caught = sum(component[i] == component[j] for i, j in pairs)
    assert caught >= 0.97 * len(pairs)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[root(i)] = root(j)
    assert all(root(i) == root(component[i]) for i in component)  # nothing is linked that isn't similar


# ---- archives ----


def member_stream(data):
    return warc._Stream(io.BytesIO(data), True)


def test_members_are_left_without_inflating(monkeypatch):
    writer = warc.WarcWriter({"path": "x"})
    row = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "date": "d", "payload_digest": None, "refers_to": None}
    rnd = random.Random(0)
    payloads = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 10, 5000, 300_000, 3)]
    data = b"".join(writer.member({**row, "payload": p}) for p in payloads)
    read = [r[-1] for r in warc.records(member_stream(data), {}, True)]
    assert read == payloads
    seen = []
    monkeypatch.setattr(warc._Stream, "_extend", lambda self, want=0, old=warc._Stream._extend: (old(self, want), seen.append(len(self.buffer)))[0])
    assert [r[6] for r in warc.records(member_stream(data), {}, False)] == [len(p) for p in payloads]
    assert sum(seen) < 40_000
    assert list(warc.records(member_stream(data), {"record_type": frozenset(["revisit"])}, True)) == []
    assert gzip.decompress(data).count(b"WARC/1.0\r\n") == 5
    with pytest.raises(ValueError):
        list(warc.records(member_stream(data[: len(data) // 2]), {}, True))


def test_many_records_in_a_member_and_long_lines():
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nX: " + b"y" * 9000 + b"\r\nContent-Length: 6\r\n\r\nab\ncd\n\r\n\r\n"
    plain = b"".join(record % kind for kind in (b"a", b"b", b"a", b"c"))
    for stream in (member_stream(gzip.compress(plain)), warc._Stream(io.BytesIO(plain), False)):
        rows = list(warc.records(stream, {"record_type": frozenset(["a", "c"])}, True))
        assert [(r[0], r[-1]) for r in rows] == [("a", b"ab\ncd\n"), ("a", b"ab\ncd\n"), ("c", b"ab\ncd\n")]


def test_files_of_bounded_size(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.md5(F.col("id").cast("string")).alias("html")).coalesce(1)
    warc.register(spark)
    rows = pages.selectExpr("'response' AS record_type", "concat('<urn:loam:page:', page_id, '>') AS record_id", "url AS target_uri", "'d' AS date", "CAST(NULL AS string) AS payload_digest", "CAST(NULL AS string) AS refers_to", "32L AS payload_bytes", "CAST(html AS binary) AS payload")
    rows.write.format("warc").option("fileBytes", "1000").mode("append").save(str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) > 3
    assert warc.read_pages(spark, str(tmp_path / "a")).count() == 40
    assert spark.read.format("warc").load(str(tmp_path / "a")).where("record_type = 'warcinfo'").count() > 3


