"""Cheapest edits that bring the turns of a conversation into order.

The edits of a conversation are paths through a lattice of nodes (turns read, state),
where the states accept ``(s?(ua)+)?`` over role initials:

    0 start    1 behind the system turn    2 behind a user turn    3 behind an answer

Its arcs are Keep (0), Rerole (3), Delete (4, forced on blank and repeated turns) and
Insert (3); a truncated turn that stays adds 3.  The auction algorithm finds the node
prices: a path grows from an origin along its cheapest arc as long as that arc is tight,
else the price of its last node rises to the cheapest arc and the path contracts by it.
Prices never leave ``price(a) <= cost(a, b) + price(b)``; when the path arrives, all its
nodes have their exact distance.  The origins are the nodes before blocks of turns, the
last block first, so that a path only ever crosses one block and work stays in proportion
to the turns.  Tight arcs of the converged prices are then traced from the first node, the
least letter first, leaving nodes that have turned out to be dead ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns between two origins of the auction.
BLOCK = 16
#: Conversations in one Arrow batch.
BATCH = 256

_BLANKS = "\x20\t\n\x0b\x0c\r"
_FIRST = re.compile(r"[^\x20\x09-\x0D]")
#: State behind an added or renamed turn, and the roles such a turn has in a state.
_NEXT = (2, 2, 3, 2)
_ROLES = ("user", "user", "assistant", "user")
#: States behind a kept turn by its initial.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): blank, duplicate, truncated or nothing."""
    seen, found = set(), []
    for row in rows:
        text = row[1]
        if not _FIRST.search(text):
            found.append("blank")
        elif row in seen:
            found.append("duplicate")
        elif text.rstrip(_BLANKS)[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append("")
        seen.add(row)
    return found


@dataclass
class Lattice:
    """Nodes ``4 * turns read + state`` and the goal; arcs by letter, cost and end."""

    initials: list[str]
    flaws: list[str]
    price: list[int] = field(default_factory=list)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """Arcs of a node in the order of their letters."""
        i, state = divmod(node, 4)
        out = []
        if i < len(self.flaws):
            out.append(("D", DELETE, node + 4))
        elif state in (0, 3):
            out.append(("", 0, self.goal))
        out.append(("I", INSERT, 4 * i + _NEXT[state]))
        if i < len(self.flaws) and self.flaws[i] not in ("blank", "duplicate"):
            more = TRUNCATED if self.flaws[i] == "truncated" else 0
            kept = _KEPT.get(self.initials[i], {}).get(state)
            if kept is not None:
                out.append(("K", KEEP + more, 4 * i + 4 + kept))
            out.append(("R", REROLE + more, 4 * i + 4 + _NEXT[state]))
        return out

    @property
    def goal(self) -> int:
        return 4 * len(self.flaws) + 4

    def converge(self) -> None:
        """Prices by the auction, from the last block of turns to the first."""
        n = len(self.flaws)
        self.price = [0] * (self.goal + 1)
        exact = bytearray(self.goal + 1)
        exact[self.goal] = 1
        for start in range(n - n % BLOCK, -1, -BLOCK):
            stop = min(start + BLOCK, n + 1)
            # No path leaves the block for less than its cheapest way on.
            least = min(self.price[4 * stop : 4 * stop + 4]) if stop <= n else 0
            block = range(4 * start, 4 * stop)
            for node in block:
                self.price[node] = least
            ways = {node: self.arcs(node) for node in block}
            for origin in block[:4]:
                self._auction(origin, ways, exact)

    def _auction(self, origin: int, ways: dict, exact: bytearray) -> None:
        price, path = self.price, [origin]
        while not exact[path[-1]]:
            node = path[-1]
            best, end = min((cost + price[to], to) for _, cost, to in ways[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(end)
        for node in path:
            exact[node] = 1

    def trace(self) -> str:
        """Letters of the cheapest path that is least in ASCII order."""
        dead = bytearray(self.goal + 1)
        nodes, letters, ways = [0], [], [self._tight(0, dead)]
        while nodes[-1] != self.goal:
            step = next(ways[-1], None)
            if step is None:
                dead[nodes.pop()] = 1
                ways.pop()
                letters.pop()
            else:
                letters.append(step[0])
                nodes.append(step[1])
                ways.append(self._tight(step[1], dead) if step[1] != self.goal else iter(()))
        return "".join(letters)

    def _tight(self, node: int, dead: bytearray) -> Iterator[tuple[str, int]]:
        for letter, cost, to in self.arcs(node):
            if self.price[node] == cost + self.price[to] and not dead[to]:
                yield letter, to


def cheapest_edits(initials: list[str], flaws: list[str]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, ties to the least letters."""
    if not flaws:
        return 0, ""
    lattice = Lattice(initials, flaws)
    lattice.converge()
    return lattice.price[0], lattice.trace()


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The conversation after the edits; added and renamed turns have the state's role."""
    out, i, state = [], 0, 0
    for letter in audit:
        if letter == "K":
            out.append(rows[i])
            state = _KEPT[rows[i][0][:1]][state]
        elif letter != "D":
            out.append((_ROLES[state], rows[i][1] if letter == "R" else ""))
            state = _NEXT[state]
        i += letter != "I"
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RESULT = pa.schema(
    [
        ("blank", pa.int64()),
        ("duplicate", pa.int64()),
        ("truncated", pa.int64()),
        ("illegal", pa.int64()),
        ("cost", pa.int64()),
        ("audit", pa.string()),
        ("repaired", _TURNS),
    ]
)


def _repair(rows: list[tuple[str, str]]) -> tuple:
    flaws = faults(rows)
    initials = [role[:1] for role, _ in rows]
    legal = {"su", "ua", "au"}
    illegal = sum(a + b not in legal for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest_edits(initials, flaws)
    repaired = [{"role": r, "text": t} for r, t in apply_edits(rows, audit)]
    counts = (flaws.count(kind) for kind in ("blank", "duplicate", "truncated"))
    return (*counts, illegal, cost, audit, repaired)


def one_turn(turn: str = "turn", role: str = "role", text: str = "text") -> Column:
    """A row as an array of one turn; null roles and texts are one space."""
    space = F.lit(" ")
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
    )
    return F.array(row)


def gather_turns(rows: DataFrame, turns: Column, conv: str = "conv_id") -> DataFrame:
    """``(conv, turns)``: the turns of each conversation by number, nulls first.

    ``turns`` gives each row's own turns (:func:`one_turn`, or an array of any length; a
    conversation whose rows have none stays, with an empty array).  Ties come by role and
    text, repeated rows side by side.  Rows with a null conversation form one.
    """
    return rows.groupBy(conv).agg(F.sort_array(F.flatten(F.collect_list(turns))).alias("turns"))


def repair_structure(gathered: DataFrame) -> DataFrame:
    """Add counts of faults, ``cost``, ``audit`` and ``repaired`` turns to each conversation.

    ``gathered`` has a column ``turns`` of structs with role and text (not null) in order;
    its other columns stay.  An empty array gives zeros and an empty audit; an empty
    table no rows.  A conversation is one row, so it has to fit one.  Work grows in
    proportion to the turns and the length of their texts.
    """
    kept = gathered.columns
    schema = gathered.limit(0).select(*kept, *[F.lit(None).cast(t).alias(f"_{n}") for n, t in _SPARK]).schema

    def solve(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = [
                    _repair([(t["role"], t["text"]) for t in turns])
                    for turns in part.column("turns").to_pylist()
                ]
                columns = zip(*found) if found else [[] for _ in _RESULT]
                arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _RESULT)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *arrays], names=[*kept, *[f"_{f.name}" for f in _RESULT]]
                )

    found = gathered.mapInArrow(solve, schema)
    new = [n for n, _ in _SPARK]
    return found.select(*[c for c in kept if c not in new], *[F.col(f"_{n}").alias(n) for n in new])


_SPARK = [
    *[(n, "bigint") for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", "string"),
    ("repaired", "array<struct<role:string,text:string>>"),
]
