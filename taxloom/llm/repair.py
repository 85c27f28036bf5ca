"""Conversations repaired to (system? (user assistant)+)? by the cheapest edits, found by depth-first branch-and-bound.

A node is how many rows are read and where the turns put out so far stand: nothing yet, after a system, user or
assistant turn. A prefix of edits leads to a node. The search holds an explicit stack and

- a lower bound of each suffix, from each node: what its rows cost at least, whatever their letters, worked out from the last row back.
  Bounds that only count rows at fault and neighbours that clash leave a gap for every clash, and a conversation
  of some hundred turns isn't searched in minutes with them;
- the incumbent (cost, audit): a prefix whose cost and bound exceed its cost goes, and one that can only draw
  level goes if its audit is the greater;
- a table of dominance: of each node the best (cost, audit) so far. A letter costs the same wherever it leads, so of two prefixes that
  lead to one node and cost the same none begins with the other, and the lesser stays the lesser whatever follows.

The incumbent is optimal when the stack is empty. Prefixes are linked letters, so they share what they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads; and the role, with its state, that a new or reroled turn takes.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
PUT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
SPACE = " \t\n\v\f\r"
FIELDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def faults(turns: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text): blank, the same as one before, or not ended by a stop."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn in turns:
        said = turn[1].rstrip(SPACE)
        out.append(BLANK if not said else DUPLICATE if turn in seen else TRUNCATED if said[-1] not in ".!?" else FINE)
        seen.add(turn)
    return out


def clashes(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def ways(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """The letters that a row may have, with cost and where they lead."""
    stays = CUT if fault == TRUNCATED else 0
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        out.append(("R", REROLE + stays, PUT[state][1]))
        if initial in NEXT[state]:
            out.append(("K", stays, NEXT[state][initial]))
    return out


def suffix_bounds(initials: list[str], found: list[int]) -> list[list[int]]:
    """What the rows from each on cost at least, by where the turns before them stand."""
    ends = [0, 2 * INSERT, INSERT, 0]
    bounds = [ends]
    for initial, fault in zip(reversed(initials), reversed(found), strict=True):
        after = bounds[-1]
        row = [min(cost + after[to] for _, cost, to in ways(initial, fault, state)) for state in range(4)]
        # two inserted turns lead back, so no more than two need be tried
        for _ in range(2):
            row = [min(row[state], INSERT + row[PUT[state][1]]) for state in range(4)]
        bounds.append(row)
    return bounds[::-1]


class Prefix:
    """Edits so far: the last letter, and those before."""

    __slots__ = ("before", "cost", "depth", "letter")

    def __init__(self, before: Prefix | None, letter: str, cost: int):
        self.before, self.letter, self.cost, self.depth = before, letter, cost, before.depth + 1 if before else 0

    def less(self, other: Prefix) -> bool:
        """Whether the letters come first in ASCII; what begins another comes first."""
        a, b, first = self, other, self.depth < other.depth
        while a is not b:
            if a.depth > b.depth:
                a = a.before
            elif b.depth > a.depth:
                b = b.before
            else:
                if a.letter != b.letter:
                    first = a.letter < b.letter
                a, b = a.before, b.before
        return first

    def better(self, other: Prefix | None) -> bool:
        return other is None or self.cost < other.cost or self.cost == other.cost and self.less(other)

    def path(self) -> list[Prefix]:
        """This prefix and all that it begins with, shortest first."""
        out = [self]
        while out[-1].before is not None:
            out.append(out[-1].before)
        return out[::-1]


def cheapest(initials: list[str], found: list[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits (ties: the least audit): K(eep), R(erole) and D(elete) for each row, I(nsert) between."""
    n, bounds = len(found), suffix_bounds(initials, found)
    best: list[list[Prefix | None]] = [[None] * 4 for _ in range(n + 1)]
    root, incumbent, path = Prefix(None, "", 0), None, []
    best[0][NOTHING] = root
    stack = [(0, NOTHING, root)]

    def hopeless(i: int, state: int, prefix: Prefix) -> bool:
        if incumbent is None or prefix.cost + bounds[i][state] < incumbent.cost:
            return False
        return prefix.cost + bounds[i][state] > incumbent.cost or path[min(prefix.depth, incumbent.depth)].less(prefix)

    while stack:
        i, state, prefix = stack.pop()
        if best[i][state] is not prefix or hopeless(i, state, prefix):
            continue
        if i == n and state in (NOTHING, ASSISTANT) and prefix.better(incumbent):
            incumbent, path = prefix, prefix.path()
        moves = [("I", INSERT, i, PUT[state][1])]
        if i < n:
            moves += [(letter, cost, i + 1, to) for letter, cost, to in ways(initials[i], found[i], state)]
        # the most promising is pushed last and so looked at first
        for letter, cost, j, to in sorted(moves, key=lambda m: (m[1] + bounds[m[2]][m[3]], m[0]), reverse=True):
            child = Prefix(prefix, letter, prefix.cost + cost)
            if child.better(best[j][to]) and not hopeless(j, to, child):
                best[j][to] = child
                stack.append((j, to, child))
    return incumbent.cost, "".join(p.letter for p in path)


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that an audit leaves, changes and adds."""
    out, state, rows = [], NOTHING, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter in "IR":
            role, to = PUT[state]
        elif letter == "K":
            to = NEXT[state][role[0]]
        if letter != "D":
            out.append((role, text))
            state = to
    return out


def _repaired(rows: list[dict]) -> dict:
    turns = [(r["role"], r["text"]) for r in rows]
    initials, found, numbers = [role[:1] for role, _ in turns], faults(turns), {r["turn"] for r in rows} - {None}
    cost, audit = cheapest(initials, found)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(TRUNCATED),
        "illegal": sum(map(clashes, initials, initials[1:])), "cost": cost, "audit": audit, "repaired": [{"role": role, "text": text} for role, text in edited(turns, audit)],
    }


SCHEMA = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [{"conv_id": k} | _repaired(turns) for k, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def gather(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, turns): each conversation's rows in the order of turn (nulls first), then role and text, each as often as copies says (once).

    A null role or text is one space. Rows without a conv_id are one conversation. A conversation whose rows have no copies stays, with no turns.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", said("role"), said("text"), (F.lit(1) if copies is None else copies).alias("copies")).alias("row"))
    chats = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    one = lambda r: F.struct(r["turn"].cast("long").alias("turn"), r["role"].alias("role"), r["text"].alias("text"))
    return chats.select("conv_id", F.flatten(F.transform("rows", lambda r: F.array_repeat(one(r), r["copies"]))).alias("turns"))


def repair(chats: DataFrame) -> DataFrame:
    """What is wrong with each conversation of gather(), its cheapest repair as audit, and the repaired turns.

    gaps: turn numbers missing between the least and the greatest. blank, duplicate, truncated: rows by their first fault. illegal: neighbours
    whose roles can't follow one another. Edits: keep 0, rerole 1, delete 2 (a must for blank and duplicate rows), insert an empty user or assistant turn 5;
    a truncated row that stays adds 5. No turns: zeros, an empty audit, no repaired turns. A role counts by its first letter. Repeated
    rows are duplicates; other columns are ignored; an empty table gives no rows. A conversation is one row, as
    its audit and its repaired turns are; the search looks at a few numbers of each turn.
    """
    return chats.select("conv_id", "turns").mapInArrow(_run, FIELDS)


def damage(turns: DataFrame) -> DataFrame:
    """gather() of turns of which a twentieth each, chosen by crc32("conv_id:turn") (nulls: one space), is dropped, emptied, robbed of its stops, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(F.coalesce("text", F.lit(" ")), ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"))
    return gather(rows, F.col("_copies"))


def repair_digests(repaired: DataFrame) -> DataFrame:
    """repair()'s rows with the SHA-256 of the repaired turns in place of them."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")
