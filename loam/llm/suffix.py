"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

A *window* is a string of ``window`` bytes. The repeated ones are found in five steps:

1. Anchors. Every window names one position in it, that of its least-hashed k-mer, so equal windows
   name equal k-mers at equal offsets. A document has an anchor for about every
   ``(window - kmer) / 2`` bytes, with the range of window starts that name it and the *region*
   that those windows cover. k-mers that very many anchors have are named only where a window
   has no other, which splits what would all meet at them.
2. Pruning. Anchors are counted by their k-mer's hash. A window whose k-mer nobody else has is not
   repeated. Hashes decide nothing else: from here on bytes are compared.
3. Runs. Of all other anchors, each task sorts the suffixes that start there, and the reversed prefixes
   that end there, and sends them as front-coded runs to ranges of k-mers. Regions that a task
   holds twice, byte for byte, are repeated; one of them goes on for all.
4. Merge. Loser trees that carry known common prefixes merge the runs of a range in both
   orders. The orders and their common prefix lengths tell, for each offset, which regions
   share a window.
5. Removal. The ranges of repeated window starts meet their document's text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loam.llm.common import MOST_SLOTS, PER_KEY, ROW_SLOTS, bitmap_of, probed
from loam.session import discard, small_batches, written

#: Window starts of a document that are handled at once.
CHUNK = 1 << 20
#: Different regions that a task sorts at once.
SORTED = 50_000
#: k-mers that are named last; the limit for being one grows so that they are never more.
MOST_CROWDED = 1 << 20
#: Bits of an anchor's sort key that hold its position in the chunk.
_POS = np.uint64((1 << 24) - 1)
_LAST = np.uint64(1 << 63)
#: Multiplier of the rolling hash, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: An anchor: its document, its position, how many bytes before it its windows start (``lo`` to ``hi``), and whether its
#: region is new to the task that sends it.
ITEM = np.dtype([("u", "<i8"), ("v", "<i8"), ("a", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("alone", "?")])
MARK = np.dtype([("u", "<i8"), ("v", "<i8"), ("first", "<i4"), ("last", "<i4")])
MARKS = "u long, v long, first int, last int"


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Finds the anchors of texts; ``crowded`` are the hashes of the k-mers that are named last, in order."""

    def __init__(self, window: int, kmer: int, crowded: np.ndarray):
        self.window, self.kmer, self.crowded = window, kmer, crowded
        self.up, self.down = _powers(_BASE, CHUNK + window), _powers(_UNBASE, CHUNK + window)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[crowded & np.uint64(0xFFFF)] = True

    def of(self, data: bytes | memoryview) -> tuple[np.ndarray, ...] | None:
        """(k-mer hash, anchor, first start, last start) arrays."""
        text = np.frombuffer(data, np.uint8)
        found = []
        for at in range(0, len(text) - self.window + 1, CHUNK):
            h, a, s0, s1 = self._chunk(text[at : at + CHUNK + self.window - 1])
            found.append((h, a + at, s0 + at, s1 + at))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else None

    def _chunk(self, text: np.ndarray) -> tuple[np.ndarray, ...]:
        n, k, span = len(text), self.kmer, self.window - self.kmer + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        kmers = _mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        # the least key of each window of ``span`` k-mers, leftmost if hashes tie
        keys = ((kmers >> np.uint64(1)) & ~_POS) | np.arange(len(kmers), dtype=np.uint64)
        if len(self.crowded):
            at = np.flatnonzero(self.maybe[kmers & np.uint64(0xFFFF)])
            at = at[np.isin(kmers[at], self.crowded)]
            keys[at] |= _LAST
        blocks = np.r_[keys, np.full(-len(keys) % span, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.window + 1
        named = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & _POS).astype(np.int64)
        s0 = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
        a = named[s0]
        return kmers[a], a, s0, np.r_[s0[1:], starts] - 1


def _count_kmers(window: int, kmer: int, crowded: np.ndarray):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(data) to how often each k-mer is an anchor, a batch at a time."""
        anchors = Anchors(window, kmer, crowded)
        for batch in it:
            found = [anchors.of(memoryview(data.as_buffer())) for data in batch.column(0)]
            hashes = [f[0] for f in found if f is not None]
            if hashes:
                h, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return batches


def shared_kmers(texts: DataFrame, window: int, kmer: int, class_items: int, rounds: int = 2) -> tuple[DataFrame, int, np.ndarray]:
    """(h, n) of the k-mers that two and more anchors have, the sum of n, and the k-mers that are named last.

    Where more than ``class_items`` anchors share a k-mer it joins those named last, and anchors are
    counted anew, once. Anchors that still share one after that are windows
    without a rarer k-mer, so mostly copies of each other, which tasks fold before they send them.
    """
    crowded = np.zeros(0, np.uint64)
    while True:
        counted = texts.select("data").mapInArrow(_count_kmers(window, kmer, crowded), "h long, n long")
        company = written(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "kmers")
        total = company.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        most = max(class_items, total // MOST_CROWDED)
        more = company.where(F.col("n") > most).select("h").toArrow()["h"].to_numpy().view(np.uint64)  # at most MOST_CROWDED
        rounds -= 1
        if not rounds or np.isin(more, crowded).all():
            return company, total, crowded
        crowded = np.union1d(crowded, more)
        discard(company)


def _kmer_bitmap(company: DataFrame, most_slots: int) -> np.ndarray | None:
    """The k-mers that have company as bits at their hash modulo a power of two, in 64 MB at most; None if they are too many."""
    n = company.count()
    if 4 * n > most_slots:
        return None
    slots = min(most_slots, max(ROW_SLOTS, 1 << (PER_KEY * max(1, n) - 1).bit_length()))
    slot = (F.pmod("h", F.lit(slots)) + 1).alias("slot")
    rows = company.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    found = rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()
    bits = np.zeros(slots // 8, np.uint8)
    for bucket, own in zip(found["bucket"].to_pylist(), found["bits"].to_pylist()):
        bits[(bucket - 1) * ROW_SLOTS // 8 :][: ROW_SLOTS // 8] = np.frombuffer(own, np.uint8)
    return bits


def _anchor_rows(window: int, kmer: int, crowded: np.ndarray):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, kmer, crowded)
        for batch in it:
            for u, v, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (found := anchors.of(memoryview(data.as_buffer()))) is not None:
                    h, a, s0, s1 = found
                    columns = [np.full(len(h), u), np.full(len(h), v), h.view(np.int64), *[x.astype(np.int32) for x in (a, s0, s1)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "h", "a", "s0", "s1"])

    return batches


def _front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(order, lengths of the prefixes shared with the predecessor, the remaining bytes of all)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared, rests, last = np.zeros(len(order), np.int16), [], b""
    for n, i in enumerate(order):
        own = strings[i]
        shared[n] = _common(last, own, 0)
        rests.append(own[shared[n] :])
        last = own
    return np.array(order, np.int32), shared, b"".join(rests)


def _common(x: bytes, y: bytes, known: int) -> int:
    """The length of the common prefix of two strings that agree in the first ``known`` bytes."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Run:
    """Reads a front-coded run: the current string, and how much of it the last output shared."""

    __slots__ = ("order", "shared", "rests", "lengths", "at", "place", "string", "common")

    def __init__(self, order: list[int], shared: list[int], rests: bytes, lengths: list[int]):
        self.order, self.shared, self.rests, self.lengths = order, shared, rests, lengths
        self.at, self.place, self.string, self.common = -1, 0, b"", 0

    def advance(self) -> bool:
        self.at += 1
        if self.at >= len(self.order):
            return False
        shared = self.shared[self.at]
        end = self.place + self.lengths[self.order[self.at]] - shared
        self.string = self.string[:shared] + self.rests[self.place : end]
        self.place, self.common = end, shared
        return True


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, item, length of the prefix shared with the item before), in order, by a loser tree.

    Each run knows how long a prefix its current string shares with the last output. Of two
    strings the one that shares more comes first; only if both share the same length are bytes
    compared, from there on, and the loser keeps the length at which it lost.
    """
    live = [run.advance() for run in runs]

    def before(x: int, y: int) -> bool:
        """Whether x wins over y; sets the loser's shared length."""
        if not live[y]:
            return True
        if not live[x]:
            return False
        p, q = runs[x], runs[y]
        if p.common != q.common:
            return p.common > q.common
        both = _common(p.string, q.string, p.common)
        wins = p.string[both:] <= q.string[both:]
        (q if wins else p).common = both
        return wins

    size = 1
    while size < len(runs):
        size *= 2
    live += [False] * (size - len(runs))
    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        x, y = build(2 * node), build(2 * node + 1)
        if before(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    for run in runs:
        run.common = 0
    winner = build(1)
    while live[winner]:
        run = runs[winner]
        yield winner, run.order[run.at], run.common
        live[winner] = run.advance()
        node = (winner + size) // 2
        while node:
            if not before(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


RUNS = "class long, marks binary, items binary, right binary, right_shared binary, right_rest binary, left binary, left_shared binary, left_rest binary"


class _Sorter:
    """Collects regions, folds equal ones, and makes a sorted run of them for each range of k-mers."""

    def __init__(self, classes: int):
        self.classes = classes
        self.regions: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}

    def add(self, h: int, u: int, v: int, a: int, s0: int, region: bytes) -> None:
        h = h * _BASE % (1 << 64)  # anchors are the least hashes of their windows; ranges need them spread
        self.regions.setdefault((h, a - s0, region), []).append((u, v, a))

    def runs(self, window: int) -> Iterator[list]:
        by_class: dict[int, tuple[list, list, list, list]] = {}
        for (h, hi, region), places in self.regions.items():
            items, marks, right, left = by_class.setdefault(h * self.classes >> 64, ([], [], [], []))
            lo = hi - (len(region) - window)
            u, v, a = places[0]
            items.append((u, v, a, lo, hi, len(places) == 1))
            if len(places) > 1:
                marks += [(u, v, a - hi, a - lo) for u, v, a in places]
            head = h.to_bytes(8, "big")
            right.append(head + region[hi:])
            left.append(head + region[:hi][::-1])
        for number, (items, marks, right, left) in by_class.items():
            row: list = [number, np.array(marks, MARK).tobytes(), np.array(items, ITEM).tobytes()]
            for strings in (right, left):
                order, shared, rest = _front_coded(strings)
                row += [order.tobytes(), shared.tobytes(), rest]
            yield row
        self.regions = {}


def _sort_runs(window: int, kmer: int, classes: int, crowded: np.ndarray, shared):
    """(u, v, data) to sorted runs of the anchors whose k-mer ``shared``, a broadcast bitmap, has; or (u, v, data, items) of the items."""
    names, kinds = [c.split()[0] for c in RUNS.split(", ")], [pa.int64(), *[pa.binary()] * 8]

    def sent(sorter: _Sorter) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in sorter.runs(window):
            rows.append(row)
            size += sum(len(x) for x in row[1:])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(classes)
        if shared is not None:
            anchors, bits = Anchors(window, kmer, crowded), shared.value
            mask = np.uint64(8 * len(bits) - 1)
        for batch in it:
            for n, (u, v, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if shared is None:
                    items = [(i["h"] % (1 << 64), i["a"], i["s0"], i["s1"]) for i in batch.column(3)[n].as_py()]
                elif (found := anchors.of(data)) is None:
                    continue
                else:
                    slot = found[0] & mask
                    has = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    items = zip(*[x[has].tolist() for x in found])
                for h, a, s0, s1 in items:
                    sorter.add(h, u, v, a, s0, data[s0 : s1 + window])
                if len(sorter.regions) > SORTED:
                    yield from sent(sorter)
        yield from sent(sorter)

    return batches


def _merge_runs(window: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """The runs of a range of k-mers to the ranges of window starts that occur in two of its regions."""
        tables = [np.frombuffer(x, ITEM) for x in rows["items"]]
        base = np.r_[0, np.cumsum([len(t) for t in tables])]
        items = np.concatenate(tables)
        a, lo, hi = (items[c].astype(np.int64) for c in ("a", "lo", "hi"))
        n = len(items)

        def ranked(order: str, shared: str, rest: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            runs = [
                Run(
                    np.frombuffer(o, np.int32).tolist(),
                    np.frombuffer(s, np.int16).tolist(),
                    r,
                    lengths[base[i] : base[i + 1]].tolist(),
                )
                for i, (o, s, r) in enumerate(zip(rows[order], rows[shared], rows[rest]))
            ]
            walk = np.array([(base[run] + item, common) for run, item, common in merged(runs)], np.int64)
            return walk[:, 0], walk[:, 1] - 8

        by_right, right_shared = ranked("right", "right_shared", "right_rest", 8 + window - lo)
        by_left, left_shared = ranked("left", "left_shared", "left_rest", 8 + hi)
        least, most = int(lo.min()), int(hi.max())
        repeated = np.zeros((n, most - least + 2), bool)  # by bytes before the anchor; the last column stays empty
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for before in range(least, most + 1):
            # regions that share the bytes after the anchor are neighbours by suffix, and those before it by prefix
            right[by_right] = np.cumsum(right_shared < window - before)
            left[by_left] = np.cumsum(left_shared < before)
            has = np.flatnonzero((lo <= before) & (before <= hi))
            _, place, count = np.unique(right[has] * (n + 1) + left[has], return_inverse=True, return_counts=True)
            repeated[has[count[place] > 1], before - least] = True
        repeated[~items["alone"]] = False  # their windows are marked already
        edges = np.diff(np.concatenate([np.zeros((n, 1), np.int8), repeated.astype(np.int8)], axis=1), axis=1)
        item, first = np.nonzero(edges == 1)
        _, past = np.nonzero(edges == -1)
        found = {"u": items["u"][item], "v": items["v"][item], "first": a[item] - (past - 1 + least), "last": a[item] - (first + least)}
        marks = np.concatenate([np.frombuffer(x, MARK) for x in rows["marks"]])
        return pd.DataFrame({c: np.concatenate([marks[c], found[c].astype(marks[c].dtype)]) for c in MARK.names})

    return merge


def _remove(window: int):
    kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in it:
            for id_, data, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = np.frombuffer(data.as_buffer(), np.uint8)
                edges = np.zeros(len(text) + 1, np.int32)
                if spans.is_valid and len(spans.values):
                    first, last = (x.to_numpy() for x in spans.values.flatten())
                    np.add.at(edges, first, 1)
                    np.add.at(edges, last + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = text[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((id_, len(text), int(gone.sum()), runs, kept))
                size += len(kept) + 64
                if size > 8 << 20:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)

    return batches


def repeated_starts(texts: DataFrame, window: int = 200, kmer: int = 50, class_items: int = 20_000, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(u, v, first, last): ranges of window starts that are repeated, from (u, v, data).

    The k-mers that have company reach the texts' second scan as a bitmap of 64 MB at most. Beyond
    that, their anchors are joined to the texts instead, which moves those texts once more.
    """
    long = texts.where(F.octet_length("data") >= window).select("u", "v", "data")
    company, total, crowded = shared_kmers(long, window, kmer, class_items)
    classes = -(-total // max(class_items, total // MOST_CROWDED)) or 1
    bits = _kmer_bitmap(company, most_slots)
    if bits is None:
        anchors = long.mapInArrow(_anchor_rows(window, kmer, crowded), "u long, v long, h long, a int, s0 int, s1 int")
        items = anchors.join(company.select("h"), "h", "left_semi").groupBy("u", "v").agg(F.collect_list(F.struct("h", "a", "s0", "s1")).alias("items"))
        long, shared = long.join(items, ["u", "v"]).select("u", "v", "data", "items"), None
    else:
        shared = texts.sparkSession.sparkContext.broadcast(bits)
    runs = long.mapInArrow(_sort_runs(window, kmer, classes, crowded, shared), RUNS)
    parts = max(classes, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a class or two to a task, as rows are large
    return runs.repartition(parts, "class").groupBy("class").applyInPandas(_merge_runs(window), MARKS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, kmer: int = 50, **options) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): texts as bytes without what is repeated.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same
    document or in another; strings are judged on the input. ``n_spans`` counts the maximal runs
    of removed bytes, and ``kept`` is the rest, joined; it may cut through a character.

    A null text is empty. Texts shorter than ``window`` stay whole, and long ones are read whole,
    a megabyte at a time. Rows that repeat a text lose all of it that is long enough, as every
    string of one occurs in the other; that holds for rows that repeat an id as well. Ids are
    carried only, so they may be null. An empty table gives an empty result, and columns other
    than the two named are ignored.

    Texts move only where something may be removed from them; the others pass in place.
    """
    small_batches(docs.sparkSession)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    texts = texts.withColumns({"u": F.xxhash64("id", "data"), "v": F.xxhash64("data", "id")})  # 128 bits tell rows apart
    marks = repeated_starts(texts.select("u", "v", "data"), window, kmer, **options)
    marks = written(marks.groupBy("u", "v").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "marks")
    marked = probed(texts, bitmap_of(marks.select("u", "v")), "loses", F.col("u"), F.col("v"))
    met = marked.where("loses").join(marks, ["u", "v"], "left").select("id", "data", "spans")
    cut = met.mapInArrow(_remove(window), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    whole = marked.where("NOT loses").select("id", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("data").alias("kept"))
    return whole.union(cut).withColumnRenamed("id", id_col)
