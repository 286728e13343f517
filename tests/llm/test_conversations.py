"""Conversation repair: auctions against all repairs of small rows and a plain search of long ones."""

import hashlib
import random
import zlib
from functools import lru_cache

from loam.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def best(rows, at=0, state="", most=99):
    """The cheapest (cost, letters) by trying every edit; rows are (initial, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def rest(i, state):
        # inserts are at most three between two rows, as four turn in a circle
        found = []
        for inserted in range(4):
            s, letters = state, ""
            for _ in range(inserted):
                s = "a" if s == "u" else "u"
                letters += "I"
            cost = 2 * inserted
            if i == len(rows):
                if s in ("", "a"):
                    found.append((cost, letters))
                continue
            initial, fault = rows[i]
            tails = [(3, "D", s)]
            if fault not in (C.BLANK, C.DUPLICATE):
                cut = 1 if fault == C.TRUNCATED else 0
                tails.append((2 + cut, "R", "a" if s == "u" else "u"))
                if initial and initial in follows[s]:
                    tails.append((cut, "K", initial))
            for c, letter, to in tails:
                more = rest(i + 1, to)
                if more:
                    found.append((cost + c + more[0], letters + letter + more[1]))
        return min(found) if found else None

    return rest(at, state)


def test_auctions_find_the_least_repair():
    rnd = random.Random(5)
    for _ in range(600):
        rows = [(rnd.choice("suax "), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 9))]
        cost, letters, end = C.repairs(rows, [C.NOTHING], dict.fromkeys(C.ENDS, 0), True)[0]
        assert (cost, letters) == best(rows) and end in C.ENDS


def test_blocks_are_chained():
    """Blocks of any size give what the whole gives."""
    rnd = random.Random(6)
    for size in (1, 2, 5):
        rows = [(rnd.choice("suau "), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(23)]
        blocks = [rows[i : i + size] for i in range(0, len(rows), size)]
        made = [{"key": "k", "block": i, "first": i == 0, "last": i == len(blocks) - 1, "initials": [r[0] for r in b], "faults": [r[1] for r in b]} for i, b in enumerate(blocks)]
        costs = [dict(zip(("key", "block", "costs"), x)) for x in C._transfers(iter(made))]
        exits = {x[1]: x for x in C._exit_prices(iter(costs[::-1]))}
        for m in made:
            m.update(exits=exits[m["block"]][2], least=exits[m["block"]][3])
        ways = [dict(zip(("key", "block", "letters", "ends", "cost"), x)) for x in C._solve_parts(iter(made))]
        chosen = list(C._choose(iter(ways)))
        assert ("".join(c[3] for c in chosen), chosen[0][4]) == best(rows)[::-1]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            stripped = text.strip(SPACE)
            faults.append(C.BLANK if not stripped else C.DUPLICATE if (role, text) in seen else C.FINE if stripped[-1] in ".!?" else C.TRUNCATED)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = best(tuple(zip(initials, faults)))
        lines, state, i = [], "", 0
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            state = own[i][2][:1] if letter == "K" else "a" if state == "u" else "u"
            role = own[i][2] if letter == "K" else {"a": "assistant", "u": "user"}[state]
            lines.append(f"{role}:{'' if letter == 'I' else own[i][3]}")
            i += letter != "I"
        found[conv] = (gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def awkward():
    rnd = random.Random(9)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rnd.randint(1, 7)):
            text = rnd.choice(["Well.", "no end", " ", "", None, "Same!", "Line\nbreak? \n", "é.", "long " * 2000 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn + 3, None]), rnd.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), text))
    # one conversation that has over half of all rows, and so many blocks
    rows += [(77, t, "user" if rnd.random() < 0.4 else "assistant", rnd.choice([f"Turn {t}.", "cut", f"cut {t}", "Same."])) for t in range(400)]
    return rows


def test_repair_of_awkward_rows(spark):
    rows = awkward()
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, block long").repartition(5)
    expected = brute(rows)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r["conv_id"]: tuple(r[c] for c in columns) for r in C.repair(given).collect()}
    assert found == expected
    turns = C.repaired_turns(given).orderBy("key", "block", "part", "place").collect()
    for conv, row in expected.items():
        lines = [f"{r['role']}:{r['text']}" for r in turns if r["key"] == ("" if conv is None else f"={conv}")]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row[-1]


def test_nothing_is_left(spark):
    """Conversations whose rows are all dropped, and no conversations."""
    gone = [c for c in range(4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    given = spark.createDataFrame([(c, 0, "user", "Gone.") for c in gone], "conv_id long, turn long, role string, text string")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert sorted(tuple(r) for r in C.repair(given).collect()) == sorted((c, *nothing) for c in gone)
    assert C.repair(given.where("false")).collect() == []
