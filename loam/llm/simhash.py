"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loam.llm.common import WORD, ascii_lower, bitmap_of, fresh, probed, text_or_empty
from loam.operators.components import connected_components
from loam.session import discard, small_batches, written

_WORD = re.compile(WORD)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Shingles that are hashed at once.
_CHUNK = 1 << 16
#: Rows of keys that are compared at once.
_AT_ONCE = 1 << 16
#: Where a key holds the number of its deleted bit.
_BIT = 40
#: Runs up to this length are compared by shifting, longer ones node by node.
_SHORT_RUN = 32


def _byte_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])


def _hashes(grams: list[str], lanes: int) -> Iterator[np.ndarray]:
    """A 64-bit hash of each shingle for each lane: XXH64 for one lane, halves of 128-bit XXH3 for more."""
    if lanes == 1:
        yield np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
        return
    for lane in range(0, lanes, 2):
        seed = 42 + lane
        halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(g, seed) for g in grams]), np.uint64).reshape(-1, 2)
        for half in range(min(2, lanes - lane)):
            yield np.ascontiguousarray(halves[:, half])


def fingerprint(lowered: str, shingle: int, lanes: int) -> list[int]:
    """The SimHash of one lower-cased text, 64 bits a lane."""
    words = _WORD.findall(lowered)
    if not words:
        return [0] * lanes
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, total, _CHUNK):
        grams = [" ".join(words[i : i + shingle]) for i in range(at, min(total, at + _CHUNK))]
        for lane, hashes in enumerate(_hashes(grams, lanes)):
            counts[lane] += _byte_counts(hashes)
    return [int(np.packbits(2 * c > total, bitorder="little").view(np.uint64)[0]) for c in counts]


def set_fingerprint(lowered: str, shingle: int, lanes: int) -> list[int]:
    """The SimHash of the different shingles of a lower-cased text, each counted once, and a hash of their set."""
    words = _WORD.findall(lowered)
    if not words:
        return [0] * (lanes + 1)
    total, found = max(1, len(words) - shingle + 1), []
    for at in range(0, total, _CHUNK):
        grams = {" ".join(words[i : i + shingle]) for i in range(at, min(total, at + _CHUNK))}
        found.append(np.stack(list(_hashes(list(grams), lanes))))
    hashes = np.concatenate(found, axis=1)
    hashes = np.ascontiguousarray(hashes[:, np.unique(hashes[0], return_index=True)[1]])
    counts = [_byte_counts(h) for h in hashes]
    prints = [int(np.packbits(2 * c > hashes.shape[1], bitorder="little").view(np.uint64)[0]) for c in counts]
    return [*prints, xxhash.xxh3_64_intdigest(hashes[0].tobytes())]


def fingerprints(rows: DataFrame, shingle: int = 4, lanes: int = 1, sets: bool = False) -> DataFrame:
    """(id, f0 .. f<lanes-1>) of (id, text): a 64-bit SimHash a lane over word shingles, repeats included.

    A bit is set if it is in over half of the shingles' hashes. Fewer words than ``shingle`` are
    one shingle; no words give zero. With ``sets``, each different shingle counts once, and a last
    column ``g`` is a hash of the set of shingles.
    """
    names = [f"f{i}" for i in range(lanes)] + ["g"] * sets
    made = set_fingerprint if sets else fingerprint

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([made(t.as_py(), shingle, lanes) for t in batch.column(1)], np.uint64).reshape(-1, len(names))
            columns = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    lowered = rows.select("id", ascii_lower(F.col("text")).alias("text"))
    return lowered.mapInArrow(batches, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def _segments(lanes: int, segments: int) -> list[tuple[int, int, int]]:
    """(lane, first bit, width) of each segment; a segment stays in one lane."""
    per_lane = -(-segments // lanes)
    edges = [round(64 * i / per_lane) for i in range(per_lane + 1)]
    return [(lane, a, b - a) for lane in range(lanes) for a, b in zip(edges, edges[1:])]


def _linked(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A least spanning forest of the links among some fingerprints, without a list of all pairs.

    It links nearest fingerprints first, so it connects what any smaller distance connects, too.
    """
    left, right, unseen = [], [], np.arange(1, len(fps))
    node, near, by = 0, np.full(len(unseen), 1 << 30), np.zeros(len(unseen), np.int64)
    while len(unseen):
        away = np.bitwise_count(fps[unseen] ^ fps[node]).sum(axis=1)
        closer = away < near
        near, by = np.where(closer, away, near), np.where(closer, node, by)
        at = int(near.argmin())
        node = int(unseen[at])
        if near[at] <= most:
            left.append(int(by[at]))
            right.append(node)
        unseen, near, by = (np.delete(x, at) for x in (unseen, near, by))
    return np.array(left, np.int64), np.array(right, np.int64)


def _nearest(fps: np.ndarray, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint to its k nearest ones within reach."""
    left, right, k = [], [], min(k, len(fps) - 1)
    for at in range(0, len(fps), 256):
        away = np.bitwise_count(fps[at : at + 256, None] ^ fps[None]).sum(axis=2)
        row = np.arange(len(away))
        away[row, row + at] = 1 << 30
        best = np.argpartition(away, k - 1, axis=1)[:, :k]
        i, n = np.nonzero(np.take_along_axis(away, best, axis=1) <= most)
        left.append(i + at)
        right.append(best[i, n])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _first_shared(x: np.ndarray, y: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """The number of the first deleted bit under which each pair of fingerprints shares a key."""
    differ, found, bit = x ^ y, np.full(len(x), -1), 0
    for lane, first, width in cuts:
        part = (differ[:, lane] >> np.uint64(first)) & np.uint64((1 << width) - 1)
        near = (found < 0) & (np.bitwise_count(part) <= 1)
        found[near] = bit + np.where(part[near] > 0, np.log2(np.maximum(part[near], np.uint64(1))).astype(np.int64), 0)
        bit += width
    return found


def _held_runs(it: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and the columns after them of rows sorted by key, many at a time, no run of equal keys cut."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in it:
        rows = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(columns)], axis=1)
        held.append((batch.column(0).to_numpy(zero_copy_only=False), rows.view(np.uint64)))
        size += batch.num_rows
        if size >= _AT_ONCE:
            keys, rows = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            yield keys[:last], rows[:last]
            held, size = [(keys[last:], rows[last:])], len(keys) - last
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _pair_batch(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for x in (a, b) for i in range(len(names))]
    return pa.RecordBatch.from_arrays(columns, [f"a{n}" for n in names] + [f"b{n}" for n in names])


def _link_runs(lanes: int, most: int, cuts: list[tuple[int, int, int]], spares: int, names: list[str]):
    """For rows sorted by key: verified links within each run of equal keys.

    A link counts under the first key that its ends share only. Under a later one the forest may
    skip it: in the earlier run the two are linked, or connected by links no longer than theirs. So
    all fingerprints within reach of each other that share a key are connected by links. Of a long
    run there are the links of a forest and of each row's ``spares`` nearest.
    """
    deleted = [(lane, np.uint64(first + i), i) for lane, first, width in cuts for i in range(width)]

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for bits, a, b in all_links(keys, fps):
            own = _first_shared(a, b, cuts) == bits
            yield a[own], b[own]

    def all_links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bit, prints = keys >> _BIT, fps[:, :lanes]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths = np.diff(np.r_[starts, len(keys)])
        run = np.repeat(np.arange(len(starts)), lengths)
        short = np.repeat(lengths <= _SHORT_RUN, lengths)
        for step in range(1, min(_SHORT_RUN, int(lengths.max(initial=1)))):
            i = np.flatnonzero(short[:-step] & (run[:-step] == run[step:]))
            if not len(i):
                break
            i = i[np.bitwise_count(prints[i] ^ prints[i + step]).sum(axis=1) <= most]
            yield bit[i], fps[i], fps[i + step]
        for r in np.flatnonzero(lengths > _SHORT_RUN):
            own = fps[starts[r] : starts[r] + lengths[r]]
            lane, place, nth = deleted[int(bit[starts[r]])]
            side = (own[:, lane] >> place) & np.uint64(1)
            if nth and (side == side[0]).all():
                continue  # all are equal in this segment, so they share its first key
            a, b = _linked(own[:, :lanes], most)
            if spares:
                near = _nearest(own[:, :lanes], most, spares)
                a, b = (np.concatenate(x) for x in zip((a, b), near))
            yield np.full(len(a), bit[starts[r]]), own[a], own[b]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _held_runs(it, len(names)):
            pairs = [p for p in links(keys, fps) if len(p[0])] if len(keys) else []
            if pairs:
                yield _pair_batch(*(np.concatenate(x) for x in zip(*pairs)), names)

    return batches


def _pair_schema(names: list[str]) -> str:
    return ", ".join(f"{side}{n} long" for side in "ab" for n in names)


def _ends(names: list[str]) -> list[Column]:
    return [F.struct(*[F.col(f"{side}{n}").alias(n) for n in names]).alias(side) for side in "ab"]


def linked_fingerprints(
    distinct: DataFrame, lanes: int = 1, max_distance: int = 4, segments: int = 3, tile_rows: int = 4096
) -> DataFrame:
    """(a, b) structs of linked distinct fingerprints: enough links to connect all that reach each other.

    Fingerprints are cut into ``segments``; if those are more than half of ``max_distance``, of
    any two fingerprints at most that many bits apart some segment differs by one bit or none.
    Each segment is indexed once for each of its bits with that bit deleted, so such a pair
    shares a key; rows meet by equality of keys and are verified by their whole distance. With fewer
    segments the search misses some pairs.

    Keys that very many fingerprints share are dealt in tiles: rows get a block by hash, and a
    task compares two blocks. Long runs of equal keys give a spanning forest, not all pairs.
    """
    names = [f"f{i}" for i in range(lanes)]
    ordered = _by_key(distinct, names, lanes, segments, tile_rows)
    pairs = ordered.mapInArrow(_link_runs(lanes, max_distance, _segments(lanes, segments), 0, names), _pair_schema(names))
    return pairs.select(*_ends(names))


def _by_key(distinct: DataFrame, names: list[str], lanes: int, segments: int, tile_rows: int) -> DataFrame:
    """(key, names), sorted by key in each partition: the rows of ``distinct`` under each of their keys."""
    cuts = _segments(lanes, segments)

    def segment(lane: int, first: int, width: int) -> Column:
        return F.shiftrightunsigned(f"f{lane}", first).bitwiseAND(F.lit((1 << width) - 1))

    # counts of whole segments bound those of their variants, and are far fewer
    whole = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), segment(*c).alias("v")) for n, c in enumerate(cuts)]))
    crowded = distinct.select(whole.alias("s")).groupBy("s.n", "s.v").count().where(F.col("count") > tile_rows // 2)
    bit = 0
    variants, crowded_variants = [], F.lit(None)
    for n, (lane, first, width) in enumerate(cuts):
        value = segment(lane, first, width)
        own = []
        for i in range(width):
            deleted = F.lit(~(1 << i) & ((1 << width) - 1))
            variants.append(value.bitwiseAND(deleted) + F.lit(bit << _BIT))
            own.append(F.col("v").bitwiseAND(deleted) + F.lit(bit << _BIT))
            bit += 1
        crowded_variants = F.when(F.col("n") == n, F.array(*own)).otherwise(crowded_variants)
    crowded = written(
        crowded.select(F.explode(crowded_variants).alias("key"), "count")
        .groupBy("key")
        .agg(F.ceil(F.sum("count") / tile_rows).cast("int").alias("blocks"))
        .where("blocks > 1"),
        "crowded",
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = bool(crowded.limit(1).count())
    if not split and len(names) > lanes:
        return _late_keys(distinct, names, cuts, parts).sortWithinPartitions("key")
    rows = distinct.select(F.explode(F.array(*variants)).alias("key"), *names)
    if split:
        tiled = rows.join(crowded, "key", "left").withColumn("block", F.pmod(F.xxhash64(*names), F.coalesce("blocks", F.lit(1))))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1))
        tiled = tiled.withColumn("other", other)
        tile = F.least("block", "other") * 65536 + F.greatest("block", "other")
        mixed = F.xxhash64("key", tile).bitwiseAND(F.lit((1 << _BIT) - 1))
        tile_key = F.shiftleft(F.shiftright("key", _BIT), _BIT).bitwiseOR(mixed)  # keys that meet by chance only compare more
        rows = tiled.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(tile_key).alias("key"), *names)
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def _late_keys(distinct: DataFrame, names: list[str], cuts: list[tuple[int, int, int]], parts: int) -> DataFrame:
    """(key, names), all rows of a key in one of ``parts`` partitions.

    Keys without one bit of the same quarter of a segment agree in its other bits, so a row is dealt by
    those once for each quarter and gets its keys after the shuffle.
    """
    quarters, at, bit = [], [], 0
    for lane, first, width in cuts:
        value = F.shiftrightunsigned(f"f{lane}", first).bitwiseAND(F.lit((1 << width) - 1))
        edges = sorted({round(width * q / 4) for q in range(5)})
        for low, high in zip(edges, edges[1:]):
            at.append(value + F.lit(len(quarters) << _BIT))
            quarters.append((bit + low, low, high - low, ~(((1 << (high - low)) - 1) << low)))
        bit += width
    number = F.shiftright("at", _BIT).cast("int")
    bits, lows, widths, others = ([F.lit(q[i]).cast("long") for q in quarters] for i in range(4))
    rows = distinct.select(F.explode(F.array(*at)).alias("at"), *names)
    rows = rows.repartition(parts, F.col("at").bitwiseAND(F.get(F.array(*others), number)))
    rows = rows.withColumns({n: F.get(F.array(*x), number).cast("int") for n, x in (("bit", bits), ("low", lows), ("width", widths))})
    value = f"(at & {(1 << _BIT) - 1}L)"
    key = f"shiftleft(cast(bit + i AS bigint), {_BIT}) | ({value} & ~shiftleft(1L, low + i))"
    return rows.select(F.explode(F.expr(f"transform(sequence(0, width - 1), i -> {key})")).alias("key"), *names)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, grams): the different word shingles of (id, text) as 32-bit hashes; no words give none.

    Two shingles of a text that meet by chance, one in ten thousand texts or so, shift a similarity by one shingle.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text in batch.column(1):
                words = _WORD.findall(text.as_py())
                grams = {xxhash.xxh32_intdigest(" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))}
                out.append(np.fromiter(grams if words else (), np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "grams"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", ascii_lower(F.col("text")).alias("text")).mapInArrow(batches, f"id {kind}, grams array<int>")


def _sets_of(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """:func:`shingle_sets` of the documents in ``ids``, written.

    They are told by a bitmap while it is small enough to broadcast, so that no other text is shuffled.
    """
    wanted = probed(docs, bitmap_of(ids.select("id").distinct()), "needed", F.col("id")).where("needed")
    return written(shingle_sets(wanted.select("id", "text").dropDuplicates(["id"]), shingle), "shingles")


def _pairs_alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, ia, b, ib) whose sets have a Jaccard similarity of ``least`` or more, written."""
    both = pairs.join(sets.select(F.col("id").alias("ia"), F.col("grams").alias("ga")).hint("merge"), "ia")
    both = both.join(sets.select(F.col("id").alias("ib"), F.col("grams").alias("gb")).hint("merge"), "ib")
    shared = F.size(F.array_intersect("ga", "gb"))
    alike = both.where(shared >= F.lit(float(least)) * (F.size("ga") + F.size("gb") - shared))
    return written(alike.select("a", "b"), "similar")


def across_components(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between all similar ones of the ``members`` (node, id, c) whose components ``c`` differ.

    A similarity join by prefixes, so that not all pairs of a crowd are made. Shingles are ordered from
    rare to frequent. Two sets that are similar share one of their rarest ``n - least * n + 1``, and
    the first that they share is early enough in both to leave room for what they must have in
    common. Rows meet at such shingles only, and not at those that one component has for itself.
    """
    held = members.join(sets, "id").select("node", "c", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    known = written(held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("df > 1"), "grams")
    met = held.join(known.select("gram", "df").hint("merge"), "gram").groupBy("node", "c", "n")  # tables of shingles stay off the driver
    ordered = met.agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    # shingles of its own come before all others of a set
    placed = ordered.select("node", "c", "n", F.posexplode("grams").alias("i", "g"), (F.col("n") - F.size("grams")).alias("own"))
    placed = placed.select("node", "c", "n", "g.gram", (F.col("own") + F.col("i")).alias("at"))
    early = placed.where(F.col("at") + F.lit(float(least)) * F.col("n") <= F.col("n") + 1e-9)
    early = written(early.join(known.where("c0 < c1").select("gram").hint("merge"), "gram", "left_semi"), "prefixes")
    one, two = (early.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "c", "n", "at")]) for side in "ab")
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    fits = (F.col("a_c") != F.col("b_c")) & (F.col("a_n") * F.lit(float(least)) <= F.col("b_n") + 1e-9)
    fits &= (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") > F.col("b_node")))
    fits &= room + 1e-9 >= F.lit(least / (1 + least)) * (F.col("a_n") + F.col("b_n"))
    pairs = one.join(two.hint("merge"), (one["gram"] == two["gram"]) & fits).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    ids = members.select("node", "id")
    pairs = pairs.join(ids.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a")
    pairs = written(pairs.join(ids.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b"), "pairs")
    similar = _pairs_alike(pairs, sets, least)
    discard(known, early, pairs)
    return similar


#: Shingles of a text that is joined by them in any case: what is 0.8 similar to one of nine has eleven at most.
SHORT = 12


def _similar(
    nodes: DataFrame,
    texts: DataFrame,
    names: list[str],
    shingle: int,
    lanes: int,
    max_distance: int,
    segments: int,
    tile_rows: int,
    least: float,
    spares: int = 4,
) -> DataFrame:
    """(a, b): similar nodes, enough of them to connect all that share a key and are similar.

    Candidates are the links of :func:`_link_runs`. That connects groups of near copies at a cost in
    proportion to them. In long runs these are not all pairs, so what has any candidate is then
    joined with its like by its shingles, across the components found so far. So are all texts of up to SHORT
    shingles, whose fingerprints tell too little, whether they have a candidate or not: each similar pair of which
    one has under ten is found. A node's smallest id stands for it, and only texts that some link needs are cut into shingles, once.
    """
    cuts = _segments(lanes, segments)
    ordered = _by_key(nodes.select(*names), names, lanes, segments, tile_rows)
    found = ordered.mapInArrow(_link_runs(lanes, max_distance, cuts, spares, names), _pair_schema(names))
    links = written(found.select(*_ends(names)).distinct(), "links")
    by_node = nodes.where(F.col("least").isNotNull()).select(F.struct(*names).alias("node"), F.col("least").alias("id"))
    pairs = links.join(by_node.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a")
    pairs = written(pairs.join(by_node.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b"), "pairs")
    words = F.split(F.trim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", SHORT + shingle)  # no more than this many parts are made
    short = by_node.join(texts.where(F.size(words) < SHORT + shingle).select("id").distinct(), "id").select("node", "id")
    either = pairs.select(F.col("a").alias("node"), F.col("ia").alias("id")).union(pairs.select("b", "ib")).union(short).distinct()
    sets = _sets_of(either, texts, shingle)
    similar = _pairs_alike(pairs, sets, least)
    reached = connected_components(similar, "a", "b").select("node", F.xxhash64("component").alias("c"))
    members = written(either.join(reached, "node", "left").select("node", "id", F.coalesce("c", F.xxhash64("node")).alias("c")), "members")
    more = across_components(members, sets, least)
    discard(links, pairs, members, sets)
    return similar.union(more)


def _classes(
    rows: DataFrame, shingle: int, lanes: int, max_distance: int, segments: int, tile_rows: int, min_similarity: float | None
) -> tuple[DataFrame, DataFrame]:
    """For (id, text): the prints of every row, and (node, component_id, n) of the nodes.

    Rows of one fingerprint, or with ``min_similarity`` of one set of shingles, are one node from
    the start, so a group of copies costs one row.
    """
    names = [f"f{i}" for i in range(lanes)]
    small_batches(rows.sparkSession)
    sets = min_similarity is not None
    prints = written(fingerprints(rows, shingle, lanes, sets), "prints")
    nodes_by = names + ["g"] * sets
    nodes = written(prints.groupBy(*nodes_by).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    if sets:
        links = _similar(nodes, rows, nodes_by, shingle, lanes, max_distance, segments, tile_rows, min_similarity)
    else:
        links = written(linked_fingerprints(nodes.select(*names), lanes, max_distance, segments, tile_rows).distinct(), "links")
    reached = connected_components(links, "a", "b")
    labelled = nodes.select(F.struct(*nodes_by).alias("node"), "least", "n").join(reached, "node", "left")
    root = F.coalesce("component", "node")
    labelled = written(labelled.select(root.alias("root"), "node", "least", "n"), "labelled")
    smallest = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = written(labelled.join(smallest, "root").select("node.*", "least", "n", "component_id"), "classes")
    discard(labelled, smallest, nodes)
    return prints, classes


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    lanes: int = 1,
    max_distance: int = 4,
    segments: int = 3,
    tile_rows: int = 4096,
    min_similarity: float | None = None,
) -> DataFrame:
    """(id_col, f0 .. , component_id): each row's fingerprint and the smallest id that it reaches.

    Rows link where their fingerprints differ in ``max_distance`` bits or fewer and, with
    ``min_similarity``, where also their shingle sets are as similar as that. Rows of one
    fingerprint are one node of the graph from the start, so a group of copies costs one row. With
    ``min_similarity`` a node is the rows of one set of shingles, and fingerprints count each
    different shingle once.

    A null or blank text has fingerprint zero and is linked like any other; long texts are hashed
    whole, in pieces. Rows with a null id get a fingerprint; they take part in links and in no
    minimum, and their component is null only if no row of it has an id. Rows that repeat an id
    stay rows of their own. An empty table gives an empty result.
    """
    names = [f"f{i}" for i in range(lanes)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    prints, classes = _classes(rows, shingle, lanes, max_distance, segments, tile_rows, min_similarity)
    nodes_by = [c for c in prints.columns if c != "id"]
    return prints.join(classes.drop("least", "n"), nodes_by).select(F.col("id").alias(id_col), *names, "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    lanes: int = 3,
    max_distance: int = 42,
    segments: int = 12,
    min_similarity: float = 0.8,
) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, in the columns of ``docs``.

    Two texts that share 0.8 of their shingles of five words differ in about 29 of 192 bits, give or
    take 5; up to 42 are candidates, and the similarity itself decides. Twelve segments don't
    guarantee that a pair 42 bits apart shares a key; README states the measured recall. Of texts under ten
    shingles no similar pair is missed.

    Rows are told apart by their id and a hash of their text, so ids may be null or repeat; of rows
    that repeat both, one stays. Texts without words are one class, null texts included. Texts of
    any length count whole. An empty table gives an empty result.

    Only rows that may have to go meet the list of those that do; a bitmap lets the others pass.
    """
    uid, may_go, goes, n = fresh(docs, "uid", "may_go", "goes", "n")
    text = text_or_empty(text_col)
    own = F.struct(
        F.col(id_col).isNull().alias("null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h")
    )
    rows = docs.select(own.alias("id"), text.alias("text"))
    prints, classes = _classes(rows, shingle, lanes, max_distance, segments, 4096, min_similarity)
    nodes_by = [c for c in prints.columns if c != "id"]
    crowd = classes.where("n > 1 OR component_id <> least").drop("least", "n")
    found = prints.join(crowd, nodes_by).groupBy("id").agg(F.min(F.col("id") != F.col("component_id")).alias("goes"), F.count(F.lit(1)).alias("n"))
    found = written(found.where("goes OR n > 1"), "found")
    marked = probed(docs.withColumn(uid, own), bitmap_of(found.select("id")), may_go, F.col(uid))
    out = marked.where(~F.col(may_go)).select(*docs.columns)
    met = marked.where(may_go).join(found.select(F.col("id").alias(uid), F.col("goes").alias(goes), F.col("n").alias(n)), uid, "left")
    met = met.where(~F.coalesce(goes, F.lit(False)))
    if found.where("NOT goes AND n > 1").limit(1).count():
        out = out.union(met.where(F.col(n) > 1).dropDuplicates([uid]).select(*docs.columns))
        met = met.where(F.col(n).isNull())
    return out.union(met.select(*docs.columns))
