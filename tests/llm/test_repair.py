"""Conversation repair: searches against all paths, conversations in pieces against whole ones, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from quillspark.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, piece string, place int, cost string, `_c` int"


def cheapest(rows):
    """Of all paths the cheapest, and of those the ASCII-least."""
    best = None

    def go(i, q, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and q in C.ENDS and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if not audit.endswith("III"):
            for name, price, to, state in C._edits(rows, True, i, q):
                go(to, state, cost + price, audit + name)

    go(0, 0, 0, "")
    return best


@pytest.mark.parametrize("seed", range(8))
def test_search_against_all_paths(seed):
    rng = random.Random(seed)
    for _ in range(40):
        rows = [(rng.choice("ssuuaat "), rng.choice("----bdt")) for _ in range(rng.randint(0, 6))]
        want = cheapest(rows)
        assert C.search(rows) == want
        for size in (1, 2, 4):
            parts, tables = [rows[i : i + size] for i in range(0, len(rows), size)], []
            for n, part in enumerate(parts):
                last, table = n == len(parts) - 1, {}
                for start in (0,) if n == 0 else range(4):
                    for end in (None,) if last else range(4):
                        found = C.search(part, start, end)
                        assert last or (found is not None) == C._reachable(part, start, end)
                        if found:
                            table[start, -1 if end is None else end] = found
                tables.append(table)
            if parts:
                out = C.compose(tables)
                assert (sum(c for _, c, _ in out), "".join(a for *_, a in out)) == want


def brute(rows):
    """What repair_conversations gives for one conversation, from rows (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[:1] or " " for _, r, _ in rows]
    cost, audit = C.search(list(zip(initials, faults, strict=True)))
    lines = "\n".join(C.repaired_lines([(r, x) for _, r, x in rows], audit, 0))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


@pytest.fixture(scope="module")
def said():
    rng = random.Random(4)
    role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
    text = lambda: rng.choice([f"Say {rng.randint(0, 30)}.", "cut off", "", " \n", "ok!", None, "é? ", "x" * 3000 + "."])
    turn = lambda n: rng.choice([rng.randint(0, n), rng.randint(0, n), None])
    out = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(300)]  # several pieces, nothing to repair
    out += [(2, turn(250), role(), text()) for _ in range(260)]
    out += [(c, turn(8), role(), text()) for c in range(3, 40) for _ in range(rng.randint(1, 7))]
    out += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (41, None, "user", "x"), (42, 5, "", ""), (42, 5, "", "")]
    return out


def test_conversations_against_brute_force(spark, said):
    d = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in said], SCHEMA).repartition(5)
    every = d.select("conv_id").union(spark.createDataFrame([(99,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in C.repair_conversations(d, every).collect()}
    want = {c: brute([r[1:] for r in said if r[0] == c]) for c in {r[0] for r in said}}
    assert got == want | {99: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert C.repair_conversations(d.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t, r, x in ((0, "user", "A? b. c!"), (1, None, None), (None, "system", "s."))]
    d = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    want = []
    for c, t, r, x in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said(x)) if kind == 2 else said(x)
        want += [(c, t, "user" if kind == 4 else said(r), text)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(tuple, C.damage(d).collect()), key=str) == sorted(want, key=str)
