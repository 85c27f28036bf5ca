"""Conversation repair against exhaustive search, and on odd rows."""

import hashlib
import random
import re
import zlib

from taxloom.llm import queries
from taxloom.llm.repair import FINE, TRUNCATED, cheapest, edited, faults, gather, repair, suffix_bounds


def exhaustive(initials, found, most):
    """All edits of all rows, with any turns between, of up to `most` turns put out."""
    best = [(10**9, "")]

    def go(i, out, cost, audit):
        if cost > best[0][0]:
            return
        if i == len(found) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit))
        if len(out) < most:
            for role in "ua":
                go(i, out + role, cost + 5, audit + "I")
        if i < len(found):
            go(i + 1, out, cost + 2, audit + "D")
            if found[i] in (FINE, TRUNCATED):
                more = 5 if found[i] == TRUNCATED else 0
                for role in "ua":
                    go(i + 1, out + role, cost + more + 1, audit + "R")
                go(i + 1, out + (initials[i] or "?"), cost + more, audit + "K")

    go(0, "", 0, "")
    return best[0]


def by_rows(initials, found):
    """The same, row by row: of each end of the initials so far ("", "s", "u", "a") the cheapest and least audit."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    now = {"": (0, "")}
    for i in range(len(found) + 1):
        for _ in range(3):
            for end, (cost, audit) in list(now.items()):
                for role in set(follows[end]) & {"u", "a"}:
                    now[role] = min(now.get(role, (10**9, "")), (cost + 5, audit + "I"))
        if i == len(found):
            return min(v for end, v in now.items() if end in ("", "a"))
        after = {}
        for end, (cost, audit) in now.items():
            ways = [(end, 2, "D")]
            if found[i] in (FINE, TRUNCATED):
                more = 5 if found[i] == TRUNCATED else 0
                ways += [(role, 1 + more, "R") for role in set(follows[end]) & {"u", "a"}]
                ways += [(initials[i], more, "K")] * (initials[i] != "" and initials[i] in follows[end])
            for to, price, letter in ways:
                after[to] = min(after.get(to, (10**9, "")), (cost + price, audit + letter))
        now = after


def random_chat(r, n):
    return [r.choice(["s", "u", "u", "a", "a", "x", ""]) for _ in range(n)], [r.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]


def test_cheapest_against_exhaustive_search():
    r = random.Random(3)
    for _ in range(120):
        initials, found = random_chat(r, r.randint(0, 5))
        assert cheapest(initials, found) == by_rows(initials, found) == exhaustive(initials, found, len(found) + 2)
    for _ in range(1500):
        initials, found = random_chat(r, r.randint(0, 40))
        assert cheapest(initials, found) == by_rows(initials, found)


def test_bounds_hold():
    r = random.Random(5)
    for _ in range(60):
        initials, found = random_chat(r, r.randint(0, 4))
        assert suffix_bounds(initials, found)[0][0] == exhaustive(initials, found, len(found) + 2)[0]


def test_ties_take_the_least_audit():
    assert cheapest(["u", "u", "a"], [0] * 3) == (2, "DKK")
    assert cheapest(["u"], [0]) == (2, "D") and cheapest([], []) == (0, "")
    assert cheapest(["u", "a"], [0, TRUNCATED]) == (4, "DD")


def test_long_conversations_end():
    r = random.Random(7)
    for initials, found in (random_chat(r, 3000), (["u"] * 3000, [0] * 3000), (["s", "u"] * 1500, [0, 3] * 1500)):
        cost, audit = cheapest(initials, found)
        assert (cost, audit) == by_rows(initials, found)
        out = edited([(x, "") for x in initials], audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in out)) and cost > 0


def test_faults():
    turns = [("user", "a."), ("user", "a."), ("assistant", "a."), ("user", " \n"), ("user", " \n"), ("user", "b "), ("user", "b! \t"), ("user", "b "), ("user", "b ")]
    assert faults(turns) == [0, 2, 0, 1, 1, 3, 0, 3, 2]


def expected(rows):
    """By the contract's words, from the rows of one conversation."""
    after = []
    for conv, turn, role, text in rows:
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        after += [(turn, "user" if at == 4 else role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
    after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    numbers = {x[0] for x in after} - {None}
    turns, seen, found = [x[1:] for x in after], [], []
    for role, text in turns:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.append((role, text))
    initials = [x[0][:1] for x in turns]
    cost, audit = by_rows(initials, found)
    left, out = iter(turns), []
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter in "IR":
            role = "assistant" if out and out[-1][0][0] == "u" else "user"
        out += [(role, text)] * (letter != "D")
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, found.count(1), found.count(2), found.count(3), illegal, cost, audit, sha)


def check(spark, rows, at):
    got = {x.conv_id: tuple(x)[1:] for x in queries.op12_repair(spark, at).collect()}
    chats = {}
    for row in rows:
        chats.setdefault(row[0], []).append(row)
    assert got == {k: expected(v) for k, v in chats.items()}
    return got


def test_query_against_exhaustive_search(spark, tmp_path):
    r = random.Random(11)
    rows = []
    for conv in range(120):
        turns = list(range(r.randint(1, 6)))
        rows += [(conv, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool"]) if r.random() < 0.3 else ["user", "assistant"][t % 2], r.choice(["a.", "b!", "c", "", " ", "d e?"]) + str(t) * r.randint(0, 1)) for t in turns]
    rows += [(200, None, "user", "x."), (200, None, None, None), (200, 4, "assistant", "y."), (None, 1, "user", "x."), (None, 1, "user", "x."), (201, 0, "", "z."), (202, None, "user", "q.")]
    assert any(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for c, t, *_ in rows)
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, turns string").repartition(5)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = check(spark, rows, str(tmp_path))
    # a conversation that loses all its rows stays
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "b" / "conversations.parquet"))
    assert check(spark, [(lost, 0, "user", "a.")], str(tmp_path / "b")) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert len(got) == 124


def test_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows, at)


def test_repaired_turns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "No."), (1, 3, "system", "x.")], "conv_id long, turn long, role string, text string")
    x = repair(gather(df)).first()
    assert (x.cost, x.audit) == (2, "KKRR") and [tuple(t) for t in x.repaired] == [("user", "Hi."), ("assistant", "Yes."), ("user", "No."), ("assistant", "x.")]
    assert repair(gather(df.limit(0))).count() == 0
