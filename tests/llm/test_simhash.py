"""SimHash near-dedup against brute force."""

import random

import pytest
import xxhash

from loam.llm.simhash import drop_near_duplicates, fingerprint, linked_fingerprints, near_duplicates, set_fingerprint
from tests.llm.common import docs, table, words


def brute_print(text, k=4):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    component = {}
    for start in sorted(prints):
        if start in component:
            continue
        stack = [start]
        component[start] = start
        while stack:
            i = stack.pop()
            for j in prints:
                if j not in component and (prints[i] ^ prints[j]).bit_count() <= most:
                    component[j] = start
                    stack.append(j)
    return component


@pytest.mark.parametrize("seed", [0, 1])
def test_documents(spark, seed):
    rows = [r for r in docs(seed, 40) if r[0] is not None]
    prints = {r[0]: brute_print(r[1]) for r in rows}
    found = near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: r["f0"] % (1 << 64) for r in found} == prints
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(prints, 4)


@pytest.mark.parametrize("seed,tile_rows", [(0, 4096), (1, 8)])
def test_links_reach_all(spark, seed, tile_rows):
    """Chains and crowds of near fingerprints, with tiles so small that crowded keys are split."""
    rnd = random.Random(seed)
    prints = set()
    for _ in range(6):
        one = rnd.getrandbits(64)
        for _ in range(60):
            for _ in range(rnd.randint(0, 4)):
                one ^= 1 << rnd.randrange(64)
            prints.add(one)
    prints = {i: p for i, p in enumerate(sorted(prints))}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints.values()], "f0 long").repartition(3)
    links = {(r["a"]["f0"] % (1 << 64), r["b"]["f0"] % (1 << 64)) for r in linked_fingerprints(df, tile_rows=tile_rows).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    of = {p: i for i, p in prints.items()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(of[a]), find(of[b])
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in prints} == brute_components(prints, 4)


def test_long_text_in_pieces():
    text = " ".join(str(i % 977) for i in range(150_000))
    assert fingerprint(text, 4, 1)[0] == brute_print(text)


def test_null_ids_and_repeats(spark):
    rows = docs()
    found = near_duplicates(table(spark, rows + rows[:3]))
    assert found.count() == len(rows) + 3
    blank = {r["component_id"] for r in found.collect() if r["f0"] == 0}
    assert len(blank) == 1 and None not in blank
    assert near_duplicates(table(spark, rows).where("false")).count() == 0


def test_one_of_each_class_stays(spark):
    rnd = random.Random(3)
    rows, i = [], 0
    for _ in range(20):
        base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        for copy in range(3):
            text = list(base)
            if copy:
                text[rnd.randrange(200)] = "changed"
            rows.append((i, " ".join(text), None, None, 0, *"izkdh"))
            i += 1
    rows += [(None, None, None, None, 0, *"izkdh"), (None, "", None, None, 0, *"izkdh"), rows[0], (7, "entirely other words in here", None, None, 0, *"izkdh")]
    kept = drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    texts = [r["text"] for r in kept.collect()]
    base_of = {r[1]: r[0] // 3 for r in rows[:60]}
    assert sorted(base_of[t] for t in texts if t in base_of) == list(range(20))
    assert sum(not t for t in texts) == 1 and "entirely other words in here" in texts
    assert drop_near_duplicates(table(spark, rows).where("false")).count() == 0


def own_words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def as_rows(texts):
    return [(i, t, None, None, 0, *"izkdh") for i, t in enumerate(texts)]


def test_texts_of_one_print_are_compared(spark):
    """Long texts with one word changed mostly share a print, and are less similar than is asked."""
    rnd = random.Random(5)
    base = own_words(rnd, 3000)
    texts = [" ".join(base[:at] + ["changed"] + base[at + 1 :]) for at in range(100, 2900, 200)]
    assert len({set_fingerprint(t, 5, 1)[0] for t in texts}) < len(texts)
    assert all(0.99 < similarity(a, b) < 0.999 for a in texts for b in texts if a != b)
    found = near_duplicates(table(spark, as_rows(texts + texts[:2])), shingle=5, min_similarity=0.999).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i % len(texts) for i in range(len(texts) + 2)}


def test_one_repeated_line_decides_nothing(spark):
    rnd = random.Random(6)
    texts = ["\n".join(["a line of five words"] * 200 + [" ".join(own_words(rnd, 50))]) for _ in range(40)]
    assert drop_near_duplicates(table(spark, as_rows(texts))).count() == 40


def test_repeats_hide_no_copy(spark):
    rnd = random.Random(7)
    texts = []
    for times in (5, 10, 30) * 5:
        text, line = " ".join(own_words(rnd, 200)), " ".join(own_words(rnd, 10))
        texts += ["\n".join([text, line, line]), "\n".join([text] + [line] * times)]
    kept = [r["doc_id"] for r in drop_near_duplicates(table(spark, as_rows(texts))).collect()]
    assert sorted(i // 2 for i in kept) == list(range(15))


@pytest.mark.parametrize("tile_rows", [4096, 64])
def test_pairs_among_refused_neighbours(spark, tile_rows):
    """All texts share a passage and are not similar by that; pairs that are similar hide among them."""
    rnd = random.Random(8)
    passage, texts = own_words(rnd, 180), []
    for i in range(160):
        more = own_words(rnd, 30)
        texts.append(" ".join(passage + (texts[-1].split()[180:192] + more[12:] if i % 4 == 1 else more)))
    prints = [sum(p << 64 * n for n, p in enumerate(set_fingerprint(t, 5, 3)[:3])) for t in texts]

    def meet(i, j):
        differ = prints[i] ^ prints[j]
        return differ.bit_count() <= 42 and any((differ >> at & 0xFFFF).bit_count() <= 1 for at in range(0, 192, 16))

    pairs = [(i, j) for j in range(160) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(pairs) == 40 and all(j == i + 1 for i, j in pairs)
    expected = {j: i for i, j in pairs if meet(i, j)}
    assert len(expected) >= 38
    df = table(spark, as_rows(texts))
    found = near_duplicates(df, shingle=5, lanes=3, max_distance=42, segments=12, tile_rows=tile_rows, min_similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: expected.get(i, i) for i in range(160)}


@pytest.mark.parametrize("shingles", [1, 2, 4, 5, 7, 9, 10])
def test_short_texts_are_joined_in_full(spark, shingles):
    """Of texts of few shingles every similar pair is found: words added at the end, and one that is another, among unlike ones."""
    rnd = random.Random(shingles)
    words_ = [f"w{i}" for i in range(4000)]
    texts, expected = [], []
    for _ in range(120):
        own = rnd.sample(words_, shingles + 4)
        other = own[:-1] + ["other"] if rnd.random() < 0.5 else own + ["more"]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (own, other)]
        texts += [" ".join(own), " ".join(other)]
        expected.append(len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]))
    rows = [(i, f"  {t}\n" if i % 3 else t, *[None] * 8) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows), shingle=5, lanes=3, max_distance=42, segments=12, min_similarity=0.8).collect()}
    assert [found[2 * i + 1] == 2 * i for i in range(120)] == expected and (shingles < 4 or any(expected))
