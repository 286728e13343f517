"""Repair of conversations' structure at least cost, by auctions on a lattice of rows and roles.

A conversation may open with a system turn and then alternates user and assistant turns, ending with
an assistant's; an empty one is allowed. Rows are kept, given another role or deleted, and empty
turns inserted; each edit has a whole cost. Rows and what may come next span a lattice in which each path
to its end is a repair. Long conversations are cut into blocks that are solved apart and
chained, so that no task solves a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.operators.ordinals import numbered
from loam.session import small_batches, written

#: What a repaired conversation has so far: nothing, a system turn, or a user's or an assistant's turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What an initial leads to from each of these.
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of a block.
BLOCK = 64
_PIECE = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"

#: An arc of the lattice: its edit's letter, cost and the node that it leads to.
Arc = tuple[str, int, int]


def _node(row: int, state: int) -> int:
    return 4 * row + state


def lattice(rows: Sequence[tuple[str, int]], exits: dict[int, int], inserts_at_end: bool) -> list[list[Arc]]:
    """The arcs of each node, from rows of (role's initial, fault); the last node is the goal.

    Node 4 * i + state has i rows behind it. ``exits`` are the costs of going on from each state after the
    last row. Turns are inserted after the last row only if ``inserts_at_end``: otherwise the next
    block inserts them, so that no repair is two paths.
    """
    n = len(rows)
    goal = 4 * (n + 1)
    arcs: list[list[Arc]] = [[] for _ in range(goal + 1)]
    for i in range(n + 1):
        for state in range(4):
            out = arcs[_node(i, state)]
            spoken = USER if state != USER else ASSISTANT  # the one turn that a user or assistant may add
            if i < n or inserts_at_end:
                out.append(("I", INSERT, _node(i, spoken)))
            if i == n:
                if state in exits:
                    out.append(("", exits[state], goal))
                continue
            initial, fault = rows[i]
            out.append(("D", DELETE, _node(i + 1, state)))
            if fault not in (BLANK, DUPLICATE):
                cut = CUT if fault == TRUNCATED else 0
                out.append(("R", RETAG + cut, _node(i + 1, spoken)))
                if (kept := NEXT.get(initial, {}).get(state)) is not None:
                    out.append(("K", cut, _node(i + 1, kept)))
    return arcs


def _leading(arcs: list[list[Arc]], goal: int, allowed=lambda node, arc: True) -> set[int]:
    """The nodes from which arcs that are allowed lead to the goal."""
    into: dict[int, list[int]] = {}
    for node, out in enumerate(arcs):
        for arc in out:
            if allowed(node, arc):
                into.setdefault(arc[2], []).append(node)
    found, todo = {goal}, [goal]
    while todo:
        for node in into.get(todo.pop(), ()):
            if node not in found:
                found.add(node)
                todo.append(node)
    return found


def auction(arcs: list[list[Arc]], origin: int, goal: int, prices: list[int]) -> None:
    """Raises ``prices`` until the origin's is its distance to the goal, whose price stays 0.

    The prices must keep ``price(i) <= cost + price(j)`` on all arcs, as zeros do, and still do afterwards. A path grows
    from the origin: if its last node's price is that of its best arc, it is extended along it, and
    otherwise the price is raised to that and the path contracted by a node. The goal must be
    within reach of each node that an arc leads to. No cycle costs nothing, so the path never
    meets itself.
    """
    path = [origin]
    while path[-1] != goal:
        last = path[-1]
        best, to = min((cost + prices[j], j) for _, cost, j in arcs[last])
        if prices[last] < best:
            prices[last] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(arcs: list[list[Arc]], origin: int, goal: int, prices: list[int]) -> tuple[str, int]:
    """(letters, last node before the goal) of the least of all cheapest paths, letters compared as ASCII.

    After an auction each arc of a cheapest path is tight: its cost is the difference of its ends'
    prices. Of the tight arcs those that lead on to the goal by tight arcs are walked, the least letter
    first; an edit and a state have one successor, so one walk decides.
    """
    tight = lambda node, arc: prices[node] == arc[1] + prices[arc[2]]
    leading = _leading(arcs, goal, tight)
    letters, at = [], origin
    while True:
        letter, _, to = min(arc for arc in arcs[at] if tight(at, arc) and arc[2] in leading)
        if to == goal:
            return "".join(letters), at
        letters.append(letter)
        at = to


def transfer(rows: Sequence[tuple[str, int]], entries: Sequence[int], exits: Sequence[int], inserts_at_end: bool) -> list[list[int]]:
    """The least cost from each entry state to each exit state, -1 where there is no way; prices stay from one entry to the next."""
    goal = 4 * (len(rows) + 1)
    costs = [[-1] * len(exits) for _ in entries]
    for k, state in enumerate(exits):
        arcs = lattice(rows, {state: 0}, inserts_at_end)
        leading = _leading(arcs, goal)
        arcs = [[arc for arc in out if arc[2] in leading] for out in arcs]
        prices = [0] * (goal + 1)
        for e, entry in enumerate(entries):
            if _node(0, entry) in leading:
                auction(arcs, _node(0, entry), goal, prices)
                costs[e][k] = prices[_node(0, entry)]
    return costs


def repairs(rows: Sequence[tuple[str, int]], entries: Sequence[int], exits: dict[int, int], inserts_at_end: bool) -> list[tuple[int, str, int]]:
    """Of each entry state (cost with what the exit costs, letters, exit state)."""
    goal = 4 * (len(rows) + 1)
    arcs = lattice(rows, exits, inserts_at_end)
    leading = _leading(arcs, goal)
    arcs = [[arc for arc in out if arc[2] in leading] for out in arcs]
    prices, found = [0] * (goal + 1), []
    for entry in entries:
        origin = _node(0, entry)
        auction(arcs, origin, goal, prices)
        letters, last = trace(arcs, origin, goal, prices)
        found.append((prices[origin], letters, last % 4))
    return found


def apply_edit(letter: str, state: int, role: str) -> tuple[str | None, int]:
    """(the repaired turn's role, None if there is none, and the state after it)."""
    if letter == "D":
        return None, state
    if letter == "K":
        return role, NEXT[role[:1]][state]
    spoken = USER if state != USER else ASSISTANT
    return ROLES[spoken], spoken


# ---- rows and their faults --------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space there.

    0 drops the row, 1 empties its text, 2 removes each of ``.!?`` from it, 3 repeats it, 4 makes it a
    user's. conv_id and turn stay null where they are. An empty table stays empty.
    """
    space = F.lit(" ")
    told = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    found = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return found.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _key(column: str) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, block, turns, initials, faults, first, last) from numbered rows; a duplicate is found by its first row's number."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    own = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    slim = rows.select("key", "nth", "turn", F.substring("role", 1, 1).alias("initial"), own.alias("fault"), "digest")
    first = slim.groupBy("key", "digest").agg(F.min("nth").alias("nth"))
    none = F.lit(None)
    sent = slim.select("key", "nth", F.struct("nth", "turn", "initial", "fault").alias("row"), none.cast("long").alias("origin"))
    sent = sent.union(first.select("key", "nth", none.cast(sent.schema["row"].dataType), F.col("nth")))
    found = sent.groupBy("key", F.expr(f"nth div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list("row")).alias("rows"), F.collect_set("origin").alias("origins"))
    fault = F.transform("rows", lambda r: F.when((r["fault"] != BLANK) & ~F.array_contains("origins", r["nth"]), DUPLICATE).otherwise(r["fault"]))
    order = Window.partitionBy("key").orderBy("block")  # a row for each block
    ends = {"first": F.lag("block").over(order).isNull(), "last": F.lead("block").over(order).isNull()}
    return found.select("key", "block", F.col("rows.turn").cast("array<string>").alias("turns"), F.col("rows.initial").alias("initials"), fault.alias("faults")).withColumns(ends)


# ---- blocks, chained --------------------------------------------------------------------------


def _rows(record: dict) -> list[tuple[str, int]]:
    return list(zip(record["initials"], record["faults"]))


def _mapped(rows: DataFrame, function, schema: str) -> DataFrame:
    """``rows`` through a function from an iterator of dictionaries to one of tuples, by Arrow batches."""
    arrow = rows.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        for row in function(record for batch in batches for record in batch.to_pylist()):
            made.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(made) >= 1000 or size >= 4 * _PIECE:
                yield _batch(made, wanted)
                made, size = [], 0
        yield _batch(made, wanted)

    return rows.mapInArrow(run, arrow)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _solve_whole(records: Iterator[dict]) -> Iterator[tuple]:
    for r in records:
        cost, letters, _ = repairs(_rows(r), [NOTHING], dict.fromkeys(ENDS, 0), True)[0]
        yield r["key"], r["block"], NOTHING, letters, cost


def _transfers(records: Iterator[dict]) -> Iterator[tuple]:
    for r in records:
        entries, exits = [NOTHING] if r["first"] else range(4), ENDS if r["last"] else range(4)
        costs = transfer(_rows(r), list(entries), list(exits), r["last"])
        whole = [[-1] * 4 for _ in range(4)]
        for e, row in zip(entries, costs):
            for x, cost in zip(exits, row):
                whole[e][x] = cost
        yield r["key"], r["block"], [c for row in whole for c in row]


def _exit_prices(records: Iterator[dict]) -> Iterator[tuple]:
    """From the last block of each conversation back: what it costs to go on from each state after a block, the least of them being taken off."""
    key, price = None, {}
    for r in records:
        if r["key"] != key:
            key, price = r["key"], dict.fromkeys(ENDS, 0)
        least = min(price.values())
        yield r["key"], r["block"], [price[s] - least if s in price else -1 for s in range(4)], least
        costs = [r["costs"][4 * e : 4 * e + 4] for e in range(4)]
        ways = {e: [cost + price[x] for x, cost in enumerate(row) if cost >= 0 and x in price] for e, row in enumerate(costs)}
        price = {e: min(found) for e, found in ways.items() if found}


def _solve_parts(records: Iterator[dict]) -> Iterator[tuple]:
    for r in records:
        entries = [NOTHING] if r["first"] else list(range(4))
        exits = {s: p for s, p in enumerate(r["exits"]) if p >= 0}
        found = repairs(_rows(r), entries, exits, r["last"])
        yield r["key"], r["block"], [f[1] for f in found], [f[2] for f in found], found[0][0] + r["least"]


def _choose(records: Iterator[dict]) -> Iterator[tuple]:
    """From the first block of each conversation on: the letters from the state that the block before ends in."""
    key, state, cost = None, NOTHING, 0
    for r in records:
        if r["key"] != key:
            key, state, cost = r["key"], NOTHING, r["cost"]
        yield r["key"], r["block"], state, r["letters"][state], cost
        state = r["ends"][state]


_SOLVED = "key string, block long, state int, letters string, cost long"


def _solved(blocks: DataFrame) -> DataFrame:
    """(key, block, state, letters, cost): the edits of each block, the state before it, and the whole conversation's cost.

    Conversations of one block are solved at once. Of longer ones each block first gets the costs from
    state to state, which are chained from the last block back to prices of the states after each; with these the block
    is solved from each state that it may begin in, and a pass from the first block on
    picks one. Both passes see a row of fixed size for each block, in order, and hold one.
    """
    whole = _mapped(blocks.where("first AND last"), _solve_whole, _SOLVED)
    parts = blocks.where("NOT (first AND last)")
    costs = _mapped(parts, _transfers, "key string, block long, costs array<long>")
    back = _mapped(costs.repartition("key").sortWithinPartitions("key", F.desc("block")), _exit_prices, "key string, block long, exits array<long>, least long")
    ways = _mapped(parts.join(back, ["key", "block"]), _solve_parts, "key string, block long, letters array<string>, ends array<int>, cost long")
    chosen = _mapped(ways.repartition("key").sortWithinPartitions("key", "block"), _choose, _SOLVED)
    return whole.union(chosen)


# ---- repaired texts ---------------------------------------------------------------------------


def _render(records: Iterator[dict]) -> Iterator[tuple]:
    """(key, block, part, turns) of each block: its (role, text) turns after the edits, in parts of bounded size.

    A block's first record has its edits, and its rows follow in order.
    """

    def edits(letters: str, row_at: int) -> int:
        """Where the letter of the next row is: past the inserted turns before it."""
        while letters[row_at] == "I":
            row_at += 1
        return row_at

    at, place, state, part = None, 0, NOTHING, 0
    letters, made, size = "", [], 0

    def line(role: str, text: str) -> None:
        nonlocal size
        made.append((role, text))
        size += len(role) + len(text)

    def flush() -> Iterator[tuple]:
        nonlocal made, size, part
        if made:
            yield *at, part, made
            made, size, part = [], 0, part + 1

    def insert(upto: int) -> None:
        nonlocal state, place
        while place < upto:
            role, state = apply_edit("I", state, "")
            line(role, "")
            place += 1

    for r in records:
        if r["nth"] < 0:
            if at is not None:
                insert(len(letters))
                yield from flush()
            at, place, state, part, letters = (r["key"], r["block"]), 0, r["state"], 0, r["letters"]
            continue
        insert(edits(letters, place))
        role, state = apply_edit(letters[place], state, r["role"])
        place += 1
        if role is not None:
            line(role, r["text"])
        if size >= _PIECE:
            yield from flush()
    if at is not None:
        insert(len(letters))
        yield from flush()


def _turns_of(records: Iterator[dict]) -> Iterator[tuple]:
    for key, block, part, turns in _render(records):
        for i, (role, text) in enumerate(turns):
            yield key, block, part, i, role, text


def _lines_of(records: Iterator[dict]) -> Iterator[tuple]:
    for key, block, part, turns in _render(records):
        yield key, block, part, "\n".join(f"{role}:{text}" for role, text in turns).encode("utf-8", "surrogatepass")


def _close(records: Iterator[dict]) -> Iterator[tuple]:
    """A row for each conversation, from its blocks and its parts of text in order; a hash and the row's counts are held, not the text."""
    key, out = None, None
    before: tuple = ()

    def done() -> tuple:
        letters, counts, cost, low, high, different = out[1:]
        gaps = 0 if low is None else high - low + 1 - different
        return key, gaps, *counts, cost, "".join(letters), out[0].hexdigest()

    for r in records:
        if r["key"] != key:
            if key is not None:
                yield done()
            key, out, before, empty = r["key"], [hashlib.sha256(), [], [0, 0, 0, 0], r["cost"], None, None, 0], (), True
        if r["part"] < 0:  # the block itself comes before its text
            out[1].append(r["letters"])
            for fault in r["faults"]:
                if fault != FINE:
                    out[2][fault - 1] += 1
            for turn, initial in zip(r["turns"], r["initials"]):
                if before and before[1] + initial not in ("su", "ua", "au"):
                    out[2][3] += 1
                if turn is not None and (not before or before[0] != turn):
                    number = int(turn)
                    out[4:] = [number if out[4] is None else min(out[4], number), number if out[5] is None else max(out[5], number), out[6] + 1]
                before = (turn, initial)
        else:
            out[0].update(r["lines"] if empty else b"\n" + r["lines"])
            empty = False
    if key is not None:
        yield done()


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows after damage with key and number, their blocks, and the blocks' edits; all written."""
    small_batches(rows.sparkSession)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = damaged(rows).select(_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), "role", "text", digest.alias("digest"))
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    at = written(numbered(keyed, order, "nth", "turns").withColumn("block", F.expr(f"nth div {BLOCK}")), "turns")
    blocks = written(_blocks(at), "blocks")
    return at, blocks, written(_solved(blocks), "edits")


def _ordered(at: DataFrame, edits: DataFrame) -> DataFrame:
    """Each block's edits and then its rows, in one partition. A join could be split or broadcast and leave a block in two."""
    none = F.lit(None)
    rows = at.select("key", "block", "nth", "role", "text", none.cast("int").alias("state"), none.cast("string").alias("letters"))
    heads = edits.select("key", "block", F.lit(-1).cast("long"), none.cast("string"), none.cast("string"), "state", "letters")
    return rows.union(heads).repartition("key", "block").sortWithinPartitions("key", "block", "nth")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(key, block, part, place, role, text): the turns of each repaired conversation, to be read in that order.

    ``key`` is the conversation's id after an equals sign, or empty for the null id; see :func:`repair`.
    """
    at, _, edits = _prepared(rows)
    return _mapped(_ordered(at, edits), _turns_of, "key string, block long, part int, place int, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after damage.

    ``rows`` has conv_id, turn, role and text; other columns are not read. Rows of a conversation stand
    in order of their turn, null turns first; those of one turn by role and a hash of role and text. ``gaps`` are
    turns that are missing between the least and the largest, ``illegal`` neighbours whose roles don't
    follow each other, and the others count rows by their first fault. ``audit`` has the letters of the
    cheapest edits, Delete, Insert, Keep and Rerole, the least of them in ASCII, and the hash is that of the
    repaired ``role:text`` lines.

    Rows are numbered in sorted ranges and cut into blocks of at most 64, in which auctions find the edits; see
    :func:`auction` and :func:`_solved`. A conversation of any length is many tasks' work until its
    texts are hashed, one stream in order, which no other way gives.

    Null roles and texts are one space, which is a blank text and no known role; null turns are no gap; the null
    conversation is one of its own; conversations without rows after damage have zeros, an empty
    audit and the hash of nothing. Empty and very long texts count whole; repeated rows are duplicates of
    the first. An empty table stays empty.
    """
    at, blocks, edits = _prepared(rows)
    lines = _mapped(_ordered(at, edits), _lines_of, "key string, block long, part int, lines binary")
    none = F.lit(None)
    own = blocks.join(edits, ["key", "block"]).select("key", "block", F.lit(-1).alias("part"), none.cast("binary").alias("lines"), "letters", "cost", "turns", "initials", "faults")
    kinds = dict(own.dtypes)
    both = own.union(lines.select("key", "block", "part", "lines", *[none.cast(kinds[c]) for c in own.columns[4:]]))
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    closed = _mapped(both.repartition("key").sortWithinPartitions("key", "block", "part"), _close, f"key string, {counts}, audit string, repaired_sha256 string")
    asked = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", _key("conv_id").alias("key"))
    found = asked.join(closed, "key", "left").drop("key")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.na.fill(0, numbers).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
