"""Conversation structure repair: faults of each row and the cheapest edits to a well-formed whole.

A conversation is well formed when its role initials read ``(s?(ua)+)?``. The edits are found by
dynamic programming over its rows and the four states of that automaton. Each cell holds a cost
and a linked node, the last edit of its script; scripts share their beginnings, nodes carry a
rolling hash and their ancestors at distances 1, 2, 4, …. Of equally cheap scripts the
ASCII-least stays: the search for their longest common prefix lifts both nodes to the first edit
in which they differ, and what the hashes call equal is verified edit by edit.

Conversations are cut where the range exchange cuts them, and every ``segment`` rows. What a piece
does is a table of its cheapest scripts from each state to each state; tables are chained
along a conversation, so that a hot one is worked on by many tasks, and only its digest and the
choice of a path are sequential, piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from contestry.llm.common import staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

#: States: nothing so far, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role initial leads to from each state.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Where the row that a state asks for leads, and the role that an edit gives it.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}

#: Rows of a conversation that one table covers at most.
SEGMENT_ROWS = 4096


class Trail:
    """The last edit of a script; ``ups[k]`` is the edit 2**k earlier, ``None`` the empty script."""

    __slots__ = ("edit", "depth", "hash", "ups")

    def __init__(self, before: Trail | None, edit: str, modulus: int = (1 << 61) - 1):
        self.edit = edit
        self.depth = before.depth + 1 if before else 1
        self.hash = ((before.hash if before else 0) * 1_000_003 + ord(edit)) % modulus
        ups = []
        at, k = before, 0
        while at is not None:
            ups.append(at)
            at, k = at.ups[k] if len(at.ups) > k else None, k + 1
        self.ups = ups

    @property
    def before(self) -> Trail | None:
        return self.ups[0] if self.ups else None

    def at(self, depth: int) -> Trail:
        """The edit that ends the prefix of that length."""
        node, away = self, self.depth - depth
        while away:
            k = away.bit_length() - 1
            node, away = node.ups[k], away - (1 << k)
        return node


def script(trail: Trail | None) -> str:
    out = []
    while trail is not None:
        out.append(trail.edit)
        trail = trail.before
    return "".join(reversed(out))


def _truly_equal(x: Trail | None, y: Trail | None) -> bool:
    """Whether scripts of equal length and hash are equal, walked back to where they share nodes."""
    while x is not y:
        if x is None or y is None or x.edit != y.edit:
            return False
        x, y = x.before, y.before
    return True


def precedes(x: Trail | None, y: Trail | None) -> bool:
    """Whether script x comes before y in ASCII order (a prefix before what it begins)."""
    if x is None or y is None:
        return x is None and y is not None
    n = min(x.depth, y.depth)
    a, b = x.at(n), y.at(n)
    if a.hash == b.hash:
        if _truly_equal(a, b):
            return x.depth < y.depth
        return script(x) < script(y)
    for k in reversed(range(max(len(a.ups), len(b.ups)))):
        if k < len(a.ups) and k < len(b.ups) and a.ups[k].hash != b.ups[k].hash:
            a, b = a.ups[k], b.ups[k]
    if not _truly_equal(a.before, b.before):  # a collision led the search astray
        return script(x) < script(y)
    return a.edit < b.edit


Cell = tuple[int, "Trail | None"]


def _cheapest(offers: list[tuple[int, Trail | None, str]], modulus: int) -> Cell:
    """The cheapest of (cost, script, further edit), the ASCII-least of equals; edit "" adds none."""
    least = min(o[0] for o in offers)
    best: Trail | None = None
    found = False
    for cost, trail, edit in offers:
        if cost == least:
            node = Trail(trail, edit, modulus) if edit else trail
            if not found or precedes(node, best):
                best, found = node, True
    return least, best


def inserted(cells: dict[int, Cell], modulus: int = (1 << 61) - 1) -> dict[int, Cell]:
    """Cells after inserts: a user row from any state but its own, then an assistant row."""
    out = dict(cells)
    for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        offers = [(*out[to], "")] if to in out else []
        offers += [(out[s][0] + INSERT_COST, out[s][1], INSERT) for s in sources if s in out]
        if offers:
            out[to] = _cheapest(offers, modulus)
    return out


def edited(cells: dict[int, Cell], initial: str, must_go: bool, truncated: bool, modulus: int = (1 << 61) - 1) -> dict[int, Cell]:
    """Cells after one more row, inserts before it included."""
    offers: dict[int, list[tuple[int, Trail | None, str]]] = {}
    for state, (cost, trail) in inserted(cells, modulus).items():
        offers.setdefault(state, []).append((cost + DELETE_COST, trail, DELETE))
        if not must_go:
            more = TRUNCATED_COST if truncated else 0
            if (to := STEPS[state].get(initial)) is not None:
                offers.setdefault(to, []).append((cost + more, trail, KEEP))
            offers.setdefault(NEXT[state][0], []).append((cost + more + REROLE_COST, trail, REROLE))
    return {state: _cheapest(o, modulus) for state, o in offers.items()}


def closed(cells: dict[int, Cell], modulus: int = (1 << 61) - 1) -> Cell:
    """The script of a whole conversation."""
    done = inserted(cells, modulus)
    return _cheapest([(*done[s], "") for s in (START, ASSISTANT) if s in done], modulus)


def repaired_lines(state: int, edits: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of each row that a script leaves, from the state in which it starts."""
    out, row = [], 0
    for edit in edits:
        if edit in (KEEP, REROLE):
            to, role = (STEPS[state][roles[row][:1]], roles[row]) if edit == KEEP else NEXT[state]
            out.append(f"{role}:{texts[row]}")
            state = to
        elif edit == INSERT:
            state, role = NEXT[state]
            out.append(f"{role}:")
        row += edit != INSERT
    return out


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = {"su", "ua", "au"}

_CELL = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_PLACE = [("conv", pa.string()), ("part", pa.int32()), ("number", pa.int32())]
_SUMS = [(k, pa.int64()) for k in ("first_turn", "last_turn", "turns", *COUNTS, "cost")]
_EDGES = [("head", pa.string()), ("tail", pa.string())]
_RESULT = [("audit", pa.string()), ("repaired_sha256", pa.string())]
_TEXTS = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
#: Tables that pass between the steps: pieces as cut, the script chosen for each, what it leaves, and whole conversations.
PIECES = pa.schema([*_PLACE, ("open", pa.bool_()), *_EDGES, *_SUMS, *_RESULT, ("cells", pa.list_(_CELL)), *_TEXTS])
CHOSEN = pa.schema([*_PLACE, ("state", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("more", pa.string())])
WRITTEN = pa.schema([*_PLACE, *_EDGES, *_SUMS, ("edits", pa.string()), ("lines", pa.list_(pa.string()))])
WHOLE = pa.schema([_PLACE[0], *_SUMS, *_RESULT])


class _Piece:
    """A run of rows of one conversation."""

    def __init__(self, conv: str | None, part: int, number: int, starts: list[int]):
        self.conv, self.part, self.number = conv, part, number
        self.tables = {s: {s: (0, None)} for s in starts}
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.sums = dict.fromkeys(("turns", *COUNTS), 0)
        self.turn: list[int | None] = [None, None]

    def add(self, turn, role: str, text: str, blank: bool, first: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if not first else "truncated" if truncated else None
        if fault:
            self.sums[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.sums["illegal"] += 1
        if turn is not None:
            self.sums["turns"] += turn != self.turn[1]
            self.turn = [turn if self.turn[0] is None else self.turn[0], turn]
        self.roles.append(role)
        self.texts.append(text)
        self.tables = {s: edited(t, role[:1], fault in ("blank", "duplicate"), fault == "truncated") for s, t in self.tables.items()}

    def row(self, open_: bool) -> dict:
        out = {"conv": self.conv, "part": self.part, "number": self.number, "open": open_, "head": self.roles[0][:1], "tail": self.roles[-1][:1],
               "first_turn": self.turn[0], "last_turn": self.turn[1], **self.sums}
        if open_:
            cells = [{"from": p, "to": q, "cost": c, "edits": script(t)} for p, table in self.tables.items() for q, (c, t) in table.items()]
            return out | {"cost": None, "audit": None, "repaired_sha256": None, "cells": cells, "roles": self.roles, "texts": self.texts}
        cost, trail = closed(self.tables[START])
        edits = script(trail)
        lines = repaired_lines(START, edits, self.roles, self.texts)
        return out | {"cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "cells": None, "roles": None, "texts": None}


def _batches(rows: Iterator[dict], schema: pa.Schema, held: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += 200 + sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if chars > held:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield from batch.slice(k, step).to_pylist()


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn once, with how often they occur, their faults, and whether the first
    of them is the first of the conversation with its role and text."""
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    least = F.min(F.struct(F.col("turn").isNotNull(), "turn"))
    firsts = same.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("text").alias("text_")).agg(least.alias("least"))
    firsts = firsts.select("conv_", "role_", "text_", F.col("least.turn").alias("turn_"), F.lit(True).alias("first"))
    match: list[Column] = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("conv", "turn", "role", "text")]
    met = same.join(firsts, match[0] & match[1] & match[2] & match[3], "left")
    return met.select(
        "conv", "turn", "role", "text", "times", F.coalesce("first", F.lit(False)).alias("first"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         segment: int = SEGMENT_ROWS) -> DataFrame:
    """One row for each ``conv_id``: ``gaps`` in the turns, rows by first fault (``blank``,
    ``duplicate`` of an earlier row, ``truncated``), ``illegal`` neighbours, and the cheapest edits:
    ``cost``, ``audit`` (their initials), ``repaired_sha256`` of what they leave.

    Rows go by turn (null first), equal turns by role and text. Edits cost: keep 0, rerole to what
    the place asks for 3, delete 4 (the only edit of blanks and duplicates), insert an empty row 3;
    a truncated row that stays 3 more. Null roles and texts count as empty; a null ``conv_id`` is a
    conversation of its own; other columns are not read; repeated rows are duplicates; an empty
    table gives no rows. Texts are taken whole; a conversation of any length is cut in pieces.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a prefix of the text only says where rows of one turn may be parted; rows are ordered by all of it
    placed = _faults(rows).repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    placed = placed.withColumn("conv", F.col("conv").cast("string"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[dict]:
            part, now, cuts = TaskContext.get().partitionId(), None, 0
            touches = True  # the first conversation may go on from the piece before, the last into the next
            for r in _rows(batches):
                if now is not None and now.conv != r["conv"]:
                    yield now.row(open_=touches)
                    now, cuts, touches = None, 0, False
                for k in range(r["times"]):
                    if now is not None and len(now.roles) >= segment:
                        yield now.row(open_=True)
                        now, cuts, touches = None, cuts + 1, True
                    if now is None:
                        now = _Piece(r["conv"], part, cuts, [START, SYSTEM, USER, ASSISTANT] if touches else [START])
                    now.add(r["turn"], r["role"], r["text"], r["blank"], r["first"] and k == 0, r["truncated"])
            if now is not None:
                yield now.row(open_=True)

        yield from _batches(pieces(), PIECES)

    done = staged(placed.mapInArrow(cut, from_arrow_schema(PIECES)))
    whole = done.filter("not open").select("conv", "first_turn", "last_turn", "turns", *COUNTS, "cost", "audit", "repaired_sha256")
    pieces = done.filter("open")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which each piece starts, the edits within it, and those after the last."""
        def chosen() -> Iterator[dict]:
            held: list[dict] = []
            for r in _rows(batches, 16):
                if held and held[0]["conv"] != r["conv"]:
                    yield from chained(held)
                    held = []
                held.append(r)
            if held:
                yield from chained(held)

        yield from _batches(chosen(), CHOSEN)

    order = ["conv", "part", "number"]
    dealt = lambda df: df.repartition("conv").sortWithinPartitions(*order)
    paths = dealt(pieces.select(*order, "cells")).mapInArrow(choose, from_arrow_schema(CHOSEN))
    named = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in order]
    ready = pieces.drop("cost", "audit", "repaired_sha256", "cells").join(
        paths.select(*[F.col(c).alias(f"{c}_") for c in order], "state", "edits", "cost", "more"), named[0] & named[1] & named[2])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written() -> Iterator[dict]:
            for r in _rows(batches, 16):
                edits = r["edits"] + r["more"]
                lines = repaired_lines(r["state"], edits, r["roles"], r["texts"])
                yield {k: r[k] for k in WRITTEN.names if k in r} | {"edits": edits, "lines": lines}

        yield from _batches(written(), WRITTEN)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> Iterator[dict]:
            now = None
            for r in _rows(batches, 16):
                if now is not None and now.conv != r["conv"]:
                    yield now.row()
                    now = None
                now = now or _Whole(r["conv"])
                now.add(r)
            if now is not None:
                yield now.row()

        yield from _batches(joined(), WHOLE)

    written = ready.select(*[c for c in ready.columns if not c.endswith("_")]).mapInArrow(write, from_arrow_schema(WRITTEN))
    rest = dealt(written).mapInArrow(join_up, from_arrow_schema(WHOLE))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return whole.unionByName(rest).select(
        F.col("conv").cast(turns.schema[conv_col].dataType).alias("conv_id"), gaps.alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")


class _Path:
    """A script made of whole pieces; ``ups`` as in :class:`Trail`."""

    __slots__ = ("edits", "state", "depth", "ups")

    def __init__(self, before: _Path | None, state: int, edits: str):
        self.edits, self.state, self.depth = edits, state, before.depth + 1 if before else 1
        self.ups = [before] if before else []
        while self.ups and len(self.ups[-1].ups) >= len(self.ups):
            self.ups.append(self.ups[-1].ups[len(self.ups) - 1])

    def since(self, shared: _Path | None) -> str:
        out, node = [], self
        while node is not shared:
            out.append(node.edits)
            node = node.ups[0] if node.ups else None
        return "".join(reversed(out))


def _shared(x: _Path, y: _Path) -> _Path | None:
    """The last piece in which two paths of equal length agree."""
    if x is y:
        return x
    for k in reversed(range(len(x.ups))):
        if k < len(x.ups) and x.ups[k] is not y.ups[k]:
            x, y = x.ups[k], y.ups[k]
    return x.ups[0] if x.ups else None


def chained(pieces: list[dict]) -> list[dict]:
    """For each piece of a conversation, in order, its part of the cheapest, ASCII-least script."""
    now: dict[int, tuple[int, _Path | None]] = {START: (0, None)}
    for piece in pieces:
        following: dict[int, tuple[int, _Path | None]] = {}
        for cell in piece["cells"]:
            if cell["from"] not in now:
                continue
            cost, path = now[cell["from"]]
            offer = (cost + cell["cost"], _Path(path, cell["from"], cell["edits"]))
            held = following.get(cell["to"])
            if held is None or offer[0] < held[0] or offer[0] == held[0] and _comes_first(offer[1], held[1]):
                following[cell["to"]] = offer
        now = following
    ends = []
    for state, (cost, path) in now.items():
        for more, to in (("", state), (INSERT, NEXT[state][0]), (INSERT * 2, NEXT[NEXT[state][0]][0])):
            if to in (START, ASSISTANT):
                ends.append((cost + INSERT_COST * len(more), more, path))
    best = ends[0]
    for end in ends[1:]:
        if end[0] < best[0] or end[0] == best[0] and _comes_first(end[2], best[2], end[1], best[1]):
            best = end
    cost, more, path = best
    out = []
    for piece in reversed(pieces):
        out.append({k: piece[k] for k in ("conv", "part", "number")} | {"state": path.state, "edits": path.edits, "cost": cost, "more": more})
        more, path = "", path.ups[0] if path.ups else None
    return out[::-1]


def _comes_first(x: _Path, y: _Path, more_x: str = "", more_y: str = "") -> bool:
    shared = _shared(x, y)
    return x.since(shared) + more_x < y.since(shared) + more_y


class _Whole:
    """A conversation of several pieces, read in order."""

    def __init__(self, conv: str | None):
        self.conv, self.sums, self.audit, self.tail = conv, dict.fromkeys(("turns", *COUNTS), 0), [], None
        self.first = self.last = self.cost = None
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, r: dict) -> None:
        for k in self.sums:
            self.sums[k] += r[k]
        if self.tail is not None and self.tail + r["head"] not in LEGAL:
            self.sums["illegal"] += 1
        if r["first_turn"] is not None:
            self.sums["turns"] -= self.last == r["first_turn"]
            self.first = r["first_turn"] if self.first is None else self.first
            self.last = r["last_turn"]
        self.tail, self.cost = r["tail"], r["cost"]
        self.audit.append(r["edits"])
        for line in r["lines"]:
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def row(self) -> dict:
        audit = "".join(self.audit)
        return {"conv": self.conv, "first_turn": self.first, "last_turn": self.last, **self.sums, "cost": self.cost, "audit": audit, "repaired_sha256": self.digest.hexdigest()}
