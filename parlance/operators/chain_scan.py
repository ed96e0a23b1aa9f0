"""The chain scan: a greedy walk along a chat, cut into cells that tasks walk side by side.

For one cycle length the walk is always in one of two states: looking for a start from some row on, or inside a chain,
told by its last member and the texts that must follow. A cell begins in the state that a short lead-in through
the rows before it ends in; that guess is nearly always the state the cell before really leaves. Where it isn't, the cell
is walked again from the true state, until every cell begins as the one before it ended. A chain that runs on is a piece
in each cell, so no group grows with the length of a chain. From its start a chain also reaches back; where that
leaves a cell it goes on in the one before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.model import Profile
from parlance.session import materialize

SCAN_ROWS = 1 << 14
_FOUND = ("cell long, cycle_length int, kind string, start long, entry string, exit string, n long, first_pos long, last_pos long, "
          "runs array<struct<from:long,to:long>>, people array<string>, dull boolean")
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def similar(a: str, b: str, min_fuzzy_len: int) -> bool:
    """Equal, or one edit or one swap of neighbours apart; see functions.fuzzy for the column."""
    if not a or not b:
        return False
    if a == b:
        return True
    if min(len(a), len(b)) < min_fuzzy_len or abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    return max(len(a), len(b)) == 1 or (len(a) == 2 and a == b[::-1])


class _Piece:
    """Members of one chain found in one cell, as stretches of consecutive rows."""

    def __init__(self, start: int | None, dull: bool = False):
        self.start, self.dull, self.runs, self.n, self.people = start, dull, [], 0, {}

    def add(self, at: int, sender, most: int) -> None:
        if self.runs and self.runs[-1]["to"] == at - 1:
            self.runs[-1]["to"] = at
        elif self.runs and self.runs[-1]["from"] == at + 1:
            self.runs[-1]["from"] = at
        else:
            self.runs.append({"from": at, "to": at})
        self.n += 1
        if len(self.people) < most:
            self.people[sender] = None


class Cell:
    """The rows `low` to `high` - 1 of a chat with `margin` rows on either side; rows in no block count as empty."""

    def __init__(self, pos, texts, senders, low: int, high: int, rules: Profile):
        self.low, self.high, self.rules = low, high, rules
        self.reach = rules.chain_tolerance + 1
        self.margin = margin(rules)
        self.first = max(low - self.margin, 0)
        self.texts = [""] * (high + self.margin - self.first)
        self.senders = [None] * len(self.texts)
        for at, text, sender in zip(pos, texts, senders):
            self.texts[at - self.first], self.senders[at - self.first] = text, sender
        self.known: dict[tuple[str, str], bool] = {}
        self.most = max(rules.chain_min_participants, 2)

    def text(self, at: int) -> str:
        at -= self.first
        return self.texts[at] if 0 <= at < len(self.texts) else ""

    def like(self, a: str, b: str) -> bool:
        if a == b:
            return bool(a)
        if (a, b) not in self.known:
            self.known[a, b] = similar(a, b, self.rules.chain_min_fuzzy_len)
        return self.known[a, b]

    def step(self, want: str, at: int, way: int) -> int | None:
        """The nearest row that continues a pattern."""
        return next((j for j in range(at + way, at + way * (self.reach + 1), way) if self.like(want, self.text(j))), None)

    def opening(self, at: int, p: int) -> tuple[list[str], list[int]] | None:
        """The pattern and the first 2 * p members of a chain that starts here."""
        pattern = [self.text(j) for j in range(at, at + p)]
        members = list(range(at, at + p))
        for want in pattern:
            after = self.step(want, members[-1], +1) if all(pattern) else None
            if after is None:
                return None
            members.append(after)
        return pattern, members

    def repeats_itself(self, pattern: list[str]) -> bool:
        p = len(pattern)
        return any(all(self.like(pattern[i], pattern[i + q]) for i in range(p - q)) for q in range(1, p) if p % q == 0)

    def walk(self, p: int, at: int, want: list[str], until: int):
        """From one state to the first row at or beyond `until`: (at, want, pieces, the start of an open chain)."""
        pieces, slot = [], 0
        piece = _Piece(None) if want else None
        while True:
            if want:
                if at >= until:
                    break
                after = self.step(want[slot], at, +1)
                if after is None:
                    want, slot, at, piece = [], 0, at + 1, None
                    continue
                if not piece.n:
                    pieces.append((piece, None))
                piece.add(after, self.senders[after - self.first], self.most)
                at, slot = after, (slot + 1) % p
            else:
                while at < until + self.margin and not self.text(at):
                    at += 1
                if at >= until:
                    break
                found = self.opening(at, p)
                if found is None:
                    at += 1
                    continue
                want, members = found
                piece = _Piece(at, self.repeats_itself(want))
                for m in members:
                    piece.add(m, self.senders[m - self.first], self.most)
                pieces.append((piece, want))
                at, slot = members[-1], 0
        return at, want[slot:] + want[:slot], pieces, piece.start if want else None

    def back(self, start: int, at: int, want: list[str]):
        """Members before `at`, and the state to go on with if the rows at hand end."""
        piece, slot = _Piece(start), 0
        while at - self.reach >= self.first or self.first == 0:
            before = self.step(want[slot], at, -1)
            if before is None:
                return piece, None
            piece.add(before, self.senders[before - self.first], self.most)
            at, slot = before, (slot + 1) % len(want)
        return piece, (at, want[slot:] + want[:slot])

    def entry(self, p: int) -> tuple[int, list[str]]:
        """The state the lead-in ends in."""
        at, want, _, _ = self.walk(p, self.first, [], self.low)
        return at, want


def margin(rules: Profile) -> int:
    """Rows a cell sees beyond its own: more than an opening takes."""
    return 2 * rules.chain_max_cycle * (rules.chain_tolerance + 1)


def cells_together(cell_rows: int) -> int:
    """Cells that one call walks, each by itself: together at most the rows of one cell of the usual size."""
    return max(SCAN_ROWS // cell_rows, 1)


def _state(at: int, want: list[str]) -> str:
    return json.dumps([at, *want])


def _piece_row(cell, p, piece: _Piece) -> tuple:
    runs = sorted(piece.runs, key=lambda r: r["from"])
    return (cell, p, "piece", piece.start, None, None, piece.n, runs[0]["from"], runs[-1]["to"], runs, list(piece.people), piece.dull)


def _walked(cell: Cell, number: int, p: int, at: int, want: list[str]) -> Iterator[tuple]:
    """The rows that a walk through a cell leaves: its state, its pieces, and walks back that go on in the cell before."""
    begun = _state(at, want)
    at, want, pieces, opened = cell.walk(p, at, want, cell.high)
    yield (number, p, "state", opened, begun, _state(at, want), None, None, None, None, None, None)
    for piece, pattern in pieces:
        yield _piece_row(number, p, piece)
        if pattern and not piece.dull:
            yield from _walked_back(cell, number, p, piece.start, piece.start, pattern[::-1])


def _walked_back(cell: Cell, number: int, p: int, start: int, at: int, want: list[str]) -> Iterator[tuple]:
    piece, rest = cell.back(start, at, want)
    if piece.n:
        yield _piece_row(number, p, piece)
    if rest:
        yield (number, p, "walk", start, None, _state(*rest), None, None, rest[0], None, None, None)


def scan(blocks: DataFrame, profile: Profile, keys=("chat_id",), cell_rows: int = SCAN_ROWS) -> DataFrame:
    """(keys, cycle_length, start, n, first_pos, last_pos, runs, people, dull): all pieces of all chains that the walk
    meets, named by the row where the chain's first cycle starts. `blocks` holds the rows that a chain can touch."""
    keys = list(keys)
    edge = margin(profile)
    cell_rows = max(cell_rows, edge)
    here, inside = F.expr(f"pos div {cell_rows}"), F.expr(f"pos % {cell_rows}")
    cells = F.array_compact(F.array(here, F.when((inside < edge) & (here > 0), here - 1), F.when(inside >= cell_rows - edge, here + 1)))
    rows = materialize(blocks.select(*keys, "pos", "sender", "norm", F.explode(cells).alias("cell")), "chain-cells")
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def frame(key, found) -> pd.DataFrame:
        out = pd.DataFrame(list(found), columns=_NAMES).astype({"start": "Int64", "n": "Int64", "first_pos": "Int64", "last_pos": "Int64", "dull": "boolean"})
        for i, name in enumerate(keys):
            out.insert(i, name, key[i])
        return out

    def cell_of(number: int, part: pd.DataFrame) -> Cell:
        low = number * cell_rows
        return Cell(part["pos"].tolist(), part["norm"].tolist(), part["sender"].tolist(), low, low + cell_rows, profile)

    def first_walk(key, part):
        def found():
            for number, own in part.groupby("cell"):
                cell = cell_of(int(number), own)
                for p in range(1, profile.chain_max_cycle + 1):
                    yield from _walked(cell, int(number), p, *cell.entry(p))
        return frame(key, found())

    def again(key, part, asked):
        if part.empty:
            return frame(key, ())
        cell = cell_of(int(key[-1]), part)

        def found():
            for p, start, state in zip(asked["cycle_length"].tolist(), asked["start"].tolist(), asked["exit"]):
                at, *want = json.loads(state)
                if asked["kind"].iloc[0] == "state":
                    yield from _walked(cell, int(key[-1]), p, at, want)
                else:
                    yield from _walked_back(cell, int(key[-1]), p, int(start), at, want)
        return frame(key, found())

    def asked_again(asked: DataFrame, name: str) -> DataFrame:
        some = rows.join(asked.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi")
        pairs = some.groupBy(*keys, "cell").cogroup(asked.groupBy(*keys, "cell"))
        return materialize(pairs.applyInPandas(again, f"{named}, {_FOUND}"), name)

    near = F.expr(f"cell div {cells_together(cell_rows)}")
    found = materialize(rows.groupBy(*keys, near).applyInPandas(first_walk, f"{named}, {_FOUND}"), "chain-walks")
    spot = [*keys, "cycle_length", "cell"]
    while True:  # every cell begins as the one before it ended
        states = found.where("kind = 'state'")
        left = states.select(*keys, "cycle_length", (F.col("cell") + 1).alias("cell"), F.col("exit").alias("true_entry"))
        wrong = states.join(left, spot).where(F.col("entry") != F.col("true_entry"))
        wrong = materialize(wrong.select(*spot, "kind", "start", F.col("true_entry").alias("exit")), "chain-entries")
        if wrong.isEmpty():
            break
        found = materialize(found.join(wrong.select(*spot), spot, "left_anti").unionByName(asked_again(wrong, "chain-walks")), "chain-walks")
    walks = found.where("kind = 'walk'")
    while True:  # walks back that left their cell
        walks = materialize(walks.select(*keys, "cycle_length", F.expr(f"(last_pos - 1) div {cell_rows}").alias("cell"), "kind", "start", "exit"), "chain-walks-back")
        if walks.isEmpty():
            break
        more = asked_again(walks, "chain-walks-back")
        found, walks = found.unionByName(more.where("kind = 'piece'")), more.where("kind = 'walk'")
    # A piece without a start goes on with the chain that was open when its cell began.
    earlier = Window.partitionBy(*keys, "cycle_length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    opened = found.where("kind = 'state'").select(*spot, F.last("start", ignorenulls=True).over(earlier).alias("opened"))
    pieces = found.where("kind = 'piece'").join(opened, spot, "left").withColumn("start", F.coalesce("start", "opened"))
    return materialize(pieces.select(*keys, "cycle_length", "start", "n", "first_pos", "last_pos", "runs", "people", "dull"), "chain-pieces")


def chains_of(pieces: DataFrame, profile: Profile, keys=("chat_id",)) -> DataFrame:
    """(keys, cycle_length, start, members, first_pos, last_pos): chains that are long enough and have people enough."""
    name = [*keys, "cycle_length", "start"]
    whole = pieces.groupBy(*name).agg(F.sum("n").alias("members"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.max("dull").alias("dull"))
    people = pieces.select(*name, F.explode("people").alias("sender")).distinct().groupBy(*name).agg(F.count("*").alias("people"))
    enough = F.col("people") >= profile.chain_min_participants
    if profile.chain_allow_solo_cycles:
        enough = enough | ((F.col("people") == 1) & (F.col("cycle_length") > 1))
    kept = whole.where(~F.col("dull") & (F.col("members") >= profile.chain_min_length)).join(people, name)
    return kept.where(enough).drop("dull", "people")
