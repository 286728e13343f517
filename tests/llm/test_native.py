"""Exact dedup, mixing and line dedup against brute force, and as native plans."""

import hashlib
import io
from collections import defaultdict
from contextlib import redirect_stdout

import pytest

from loam.llm.exact import drop_exact_duplicates, exact_dedup
from loam.llm.lines import apply_bitmaps, line_dedup
from loam.llm.mixing import mix, mixed
from loam.session import written
from tests.llm.common import LOWER, docs, table, words

key = lambda i: (i is not None, i or 0)  # noqa: E731  null is the least id


@pytest.mark.parametrize("seed", [0, 1])
def test_exact(spark, seed):
    rows = docs(seed)
    rows += rows[:2]  # whole rows again
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    expected = []
    for r in rows:
        text = (r[1] or "").translate(LOWER)
        keep = max(groups[text], key=key)
        expected.append((r[0], keep, len(groups[text]), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    found = exact_dedup(table(spark, rows), digest_all=True, prefix_chars=4).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    kept = drop_exact_duplicates(table(spark, rows))
    assert kept.columns == [f.split()[0] for f in "doc_id text lang source n_chars id size keep digest shard".split()]
    assert sorted((r["text"] or "").translate(LOWER) for r in kept.collect()) == sorted(groups)


def test_only_survivors_are_hashed(spark):
    rows = [(i, t, None, None, 0, *"izkdh") for i, t in enumerate(["aa", "aA", "b", "cccc"])]
    assert {r["doc_id"]: r["digest"] is not None for r in exact_dedup(table(spark, rows)).collect()} == {0: True, 1: True, 2: False, 3: False}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mixing(spark, seed):
    rows = docs(seed, 300)
    sizes, by_source = {}, defaultdict(list)
    for r in rows:
        by_source[r[3]].append(len(words(r[1])))
    sizes = {s: sum(v) for s, v in by_source.items()}
    target = brute_targets(sizes)
    df = table(spark, rows).withColumnRenamed("keep", "target")
    found = df.select("doc_id", "source").distinct().join(mix(df), "doc_id").collect()
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= max(by_source[s]) + 2
    again = sorted(map(repr, map(tuple, mix(df.repartition(7), bits=3).collect())))
    assert again == sorted(map(repr, map(tuple, mix(df).collect())))
    copies = defaultdict(int)
    for r in mixed(df).collect():
        copies[r["doc_id"]] += 1
    assert copies == {r["doc_id"]: r["copies"] for r in mix(df).where("copies > 0 AND doc_id IS NOT NULL").collect()} | ({None: copies[None]} if None in copies else {})


@pytest.mark.parametrize("seed", [0, 1])
def test_lines(spark, seed):
    import random

    rnd = random.Random(seed)
    pool = ["short", "a line of more than forty characters, number one", "A LINE of more than forty characters, number two", "é" * 40, ""]
    rows = []
    for i in range(80):
        lines = [rnd.choice(["", " ", "\t"]) + rnd.choice([p, p.upper(), p]) + rnd.choice(["", "\r", " "]) for p in rnd.choices(pool, k=rnd.randint(0, 90))]
        rows.append((i, "\n".join(lines), None, None, 0, *"izkdh"))
    rows += [(200, None, None, None, 0, *"izkdh"), (201, "", None, None, 0, *"izkdh"), (202, "\n".join([pool[1]] * 70), None, None, 0, *"izkdh")]
    norm = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[norm(line)].add(r[0])
    expected = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(norm(x)) < 40 or len(holders[norm(x)]) < 5 or max(holders[norm(x)]) == r[0]]
        expected.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    df = table(spark, rows)
    bitmaps = line_dedup(df)
    assert sorted(map(tuple, apply_bitmaps(df, bitmaps).collect())) == sorted(expected)
    assert all(w["bits"] < (1 << 63) - 1 for r in bitmaps.collect() for w in r["kept"])


def test_lines_of_repeated_ids(spark):
    """Two rows of one id: each loses only its own lines."""
    shared, own = "a line of more than forty characters that all share", "a line of more than forty characters of its own"
    texts = [(i, shared) for i in range(10, 16)] + [(1, f"{shared}\n{own} one\nend"), (1, f"{own} two\n{shared}\nend")]
    df = table(spark, [(i, t, None, None, 0, *"izkdh") for i, t in texts])
    found = [(r["doc_id"], r["n_dropped"], r["kept_text"]) for r in apply_bitmaps(df, line_dedup(df)).collect()]
    assert sorted(found) == [(1, 1, f"{own} one\nend"), (1, 1, f"{own} two\nend"), *[(i, 1, "") for i in range(10, 15)], (15, 0, shared)]


def test_awkward_lines(spark):
    df = table(spark, docs())
    assert apply_bitmaps(df, line_dedup(df, min_chars=1, min_docs=2)).count() == df.count()


def test_empty_tables(spark):
    none = table(spark, docs()).where("false")
    for made in (exact_dedup(none), drop_exact_duplicates(none), mix(none), mixed(none), line_dedup(none), apply_bitmaps(none, line_dedup(none))):
        assert made.count() == 0


def test_plans_are_native(spark):
    df = written(table(spark, docs()))
    for made in (exact_dedup(df), mix(df), apply_bitmaps(df, line_dedup(df))):
        out = io.StringIO()
        with redirect_stdout(out):
            made.explain("formatted")
        assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow", "Cartesian"))
