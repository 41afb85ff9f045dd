import hashlib
import random
import re
import zlib

import pytest

from offerlake.llm import queries, repair

FOLDER = "/root/testdata/sf0.01"
SHAPE = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def brute_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            kept += [row, row] if code == 3 else [row]
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in found.items()}


def brute(rows):
    """The least (cost, audit) over all edits, ties by the audit's text."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))

    def allowed(tail, initial):
        return tail + initial in ("s", "u", "su", "ua", "au")

    names, best = {"u": "user", "a": "assistant"}, {}
    for at in range(len(rows), -1, -1):
        later, best = best, {}
        for tail in ("", "s", "u", "a"):  # the last initial so far
            options = []
            for inserts in ("", "u", "a", "ua", "au"):
                chain = tail + inserts
                if not all(allowed(chain[i - 1 : i] if i else "", chain[i]) for i in range(len(tail), len(chain))):
                    continue
                spent, begun, end = 5 * len(inserts), "I" * len(inserts), chain[-1:]
                lines = tuple(f"{names[i]}:" for i in inserts)
                if at == len(rows):
                    if end in ("", "a"):
                        options.append((spent, begun, lines))
                    continue
                _, role, text = rows[at]
                edits = [(2, "D", end, ())]
                if faults[at] not in ("blank", "duplicate"):
                    more = 5 * (faults[at] == "truncated")
                    edits += [(1 + more, "R", i, (f"{n}:{text}",)) for i, n in names.items() if allowed(end, i)]
                    edits += [(more, "K", role[0], (f"{role}:{text}",))] if role[:1] and allowed(end, role[0]) else []
                for cost, edit, new, line in edits:
                    rest = later[new]
                    options.append((spent + cost + rest[0], begun + edit + rest[1], lines + line + rest[2]))
            best[tail] = min(options, key=lambda o: o[:2])
    cost, audit, lines = best[""]
    assert SHAPE.fullmatch("".join(line[:1] for line in lines))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame).collect()}
    want = {k: brute(tuple(v)) for k, v in brute_damage(rows).items()}
    assert found == want


def test_repair_equals_brute_force(llm):
    rng, rows = random.Random(7), []
    roles = ["user", "assistant", "system", "tool", None, "", "u", "Assistant", "\U0001f600"]
    texts = ["Yes.", "No", "  ", "", None, "What? ", "Go!\n", "Yes.", "é.", " ", "." * 3]
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles[:2] if rng.random() < 0.7 else roles)
            rows.append((conv if conv % 30 else None, rng.choice([turn, turn, turn * 3, None]), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    rows += [(7, 1, "user", "Same.")] * 5 + [(8, 2**62, "user", "far."), (9, -5, "system", "x." * 50_000)]
    check(llm, rows)


def test_one_conversation_over_all_ranges(llm, monkeypatch):
    """One conversation holds nearly all rows, with one row that repeats hundreds of times."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["a.", "b", f"c {t}.", f"d {t}"])) for t in range(300)]
    rows += [(1, 77, "user", "again and again.")] * 150 + [(2, 0, "user", "Hi."), (3, 0, None, None)]
    check(llm, rows)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_runs_and_blocks(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        runs = [[rng.randrange(12), rng.randint(1, 7)] for _ in range(rng.randint(0, 6))]
        vector = repair.FINAL
        for symbol, n in reversed(runs):
            for _ in range(n):
                vector = repair.applied(repair.power(symbol, 0), vector)
        assert repair.settle(runs)[0] == vector[repair.EMPTY]
    assert repair.settle([[4, 10**4]])[1].count("R") + repair.settle([[4, 10**4]])[1].count("D") > 0


def test_empty_table(llm):
    assert repair.repair(llm.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_covers_the_table(llm):
    table = llm.read.parquet(f"{FOLDER}/conversations.parquet")
    want = {k: brute(tuple(v)) for k, v in brute_damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]).items()}
    assert {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](llm, FOLDER).collect()} == want
