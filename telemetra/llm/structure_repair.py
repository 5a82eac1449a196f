"""Conversation structure repair: the cheapest edits that give a legal role order.

Every row is kept, reroled to user or assistant, or deleted, and empty rows may be inserted,
so that the role initials read ``(s?(ua)+)?``. A path through the graph of (rows read, role
state, letters written) weighs one integer: its high digits are the cost, its low digits the
audit letters at their places, a fixed number of digits wide, zeros behind the last letter.
Each edge adds its cost and its letter's digit at its place, the least integer at every node
survives, and the least at the end says cost and audit alike: of equal costs the audit that
comes first in ASCII.

Rows are shuffled once, by conversation, and stream through their task in order. A node also
carries the hash of the text repaired so far, so no text is kept; digits that all nodes share
are settled and leave the integers, and a node that costs more than another one plus the
dearest way between two states can no longer win. Memory is a few nodes, however long the
conversation.

Defined cases: a null conversation id is an id of its own; a null turn comes first, a null
role or text is one space; rows of one turn are ordered by role, then text; an empty role, or
one that starts with no s, u or a, cannot be kept; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
# Audit letters and their digits (three bits each), in ASCII order; zero is the end.
BITS, DELETE, INSERT, KEEP, REROLE = 3, 1, 2, 3, 4
LETTERS = " DIKR"
# Role states: nothing yet, system, user, assistant; what may follow and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The one of user and assistant that may follow a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
WIDTH = 64


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Repair:
    """The path graph of one conversation, layer by layer."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        # from one state to what another one still may do: at most two inserts and a deletion
        self.spread = 2 * costs.insert + costs.delete
        # settled: leading letters that are decided, their number and what every node has paid for
        self.width, self.row, self.settled, self.dropped, self.paid = WIDTH, 0, [], 0, 0
        # (state, inserts) -> (weight, hash of the repaired lines or None); letters written: rows + inserts
        self.nodes: dict[tuple[int, int], tuple] = {(START, 0): (0, None)}

    def _edge(self, inserts: int, cost: int, letter: int) -> int:
        place = self.row + inserts - self.dropped
        return (cost << (BITS * self.width)) + (letter << (BITS * (self.width - 1 - place)))

    def _prune(self) -> None:
        low = min(w for w, _ in self.nodes.values()) >> (BITS * self.width)
        limit = (low + self.spread + 1) << (BITS * self.width)
        self.nodes = {k: v for k, v in self.nodes.items() if v[0] < limit}

    def _make_room(self) -> None:
        """Settles the leading letters that all nodes share; widens the integers for the rest."""
        longest = max(k for _, k in self.nodes) + self.row - self.dropped
        if longest + 8 < self.width:
            return
        mask = (1 << (BITS * self.width)) - 1
        lows = [w & mask for w, _ in self.nodes.values()]
        differ = 0
        for low in lows[1:]:
            differ |= low ^ lows[0]
        shortest = min(k for _, k in self.nodes) + self.row - self.dropped
        same = min(shortest, self.width - -(-differ.bit_length() // BITS))
        if same:
            top = lows[0] >> (BITS * (self.width - same))
            self.settled.append("".join(LETTERS[(top >> (BITS * i)) & 7] for i in range(same - 1, -1, -1)))
            keep = (1 << (BITS * (self.width - same))) - 1
            least = min(w for w, _ in self.nodes.values()) >> (BITS * self.width)
            self.paid += least
            shift = BITS * self.width
            self.nodes = {k: ((((w >> shift) - least) << shift) | ((w & keep) << (BITS * same)), h) for k, (w, h) in self.nodes.items()}
            self.dropped += same
        if max(k for _, k in self.nodes) + self.row - self.dropped + 8 >= self.width // 2:
            more = self.width
            self.nodes = {k: (w << (BITS * more), h) for k, (w, h) in self.nodes.items()}
            self.width += more

    def _insert(self) -> None:
        """Relaxes the insert edges inside the layer, fewest inserts first."""
        todo = sorted(self.nodes, key=lambda k: k[1])
        low = min(w for w, _ in self.nodes.values()) >> (BITS * self.width)
        limit = (low + self.spread + 1) << (BITS * self.width)
        for state, inserts in todo:
            w, h = self.nodes[state, inserts]
            w += self._edge(inserts, self.costs.insert, INSERT)
            if w >= limit:
                continue
            key = NEXT[state], inserts + 1
            old = self.nodes.get(key)
            if old is None:
                todo.append(key)
            if old is None or w < old[0]:
                self.nodes[key] = w, _line(h, NAMES[key[0]], b"")

    def add(self, role: bytes, text: bytes, must_delete: bool, truncated: bool) -> None:
        self._make_room()
        self._insert()
        initial, extra = chr(role[0]) if role else "", self.costs.truncated if truncated else 0
        best: dict[tuple[int, int], tuple] = {}

        def offer(key, w, made):
            if key not in best or w < best[key][0]:
                best[key] = w, made

        for (state, inserts), (w, h) in self.nodes.items():
            offer((state, inserts), w + self._edge(inserts, self.costs.delete, DELETE), (h, None))
            if must_delete:
                continue
            if initial in FOLLOWS[state]:
                offer((FOLLOWS[state][initial], inserts), w + self._edge(inserts, extra, KEEP), (h, role))
            offer((NEXT[state], inserts), w + self._edge(inserts, self.costs.rerole + extra, REROLE), (h, NAMES[NEXT[state]]))
        self.row += 1
        self.nodes = {k: (w, made) for k, (w, made) in best.items()}
        self._prune()
        self.nodes = {k: (w, h if name is None else _line(h, name, text)) for k, (w, (h, name)) in self.nodes.items()}

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, hash of the repaired lines."""
        self._make_room()
        self._insert()
        w, h = min((v for k, v in self.nodes.items() if k[0] in (START, ASSISTANT)), key=lambda v: v[0])
        shift = BITS * self.width
        low = w & ((1 << shift) - 1)
        letters = "".join(LETTERS[(low >> (BITS * i)) & 7] for i in range(self.width - 1, -1, -1)).rstrip()
        return self.paid + (w >> shift), "".join(self.settled) + letters, (h or hashlib.sha256()).hexdigest()


def _line(before, role: bytes, text: bytes):
    h = before.copy() if before else hashlib.sha256()
    h.update((b"\n" if before else b"") + role + b":" + text)
    return h


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows of the query after its damage: ``conv, turn, role, text, gone, repeat``. A
    dropped row stays as ``gone`` without its text, so that its conversation is not lost."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(part(conv_col), F.lit(":"), part(turn_col)), "UTF-8")) % 20
    text, role = part("text"), part("role")
    rows = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), kind.alias("kind"),
    )
    return rows.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("repeat")).drop("kind")


def as_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Undamaged rows in the same shape."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text("role"), text("text"), F.lit(False).alias("gone"), F.lit(0).alias("repeat"))


RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
_SCHEMA = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Conversation:
    def __init__(self, conv, costs: Costs):
        self.conv, self.graph = conv, Repair(costs)
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        left = text.rstrip(SPACE)
        blank, cut = not left, left[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not (blank or seen)
        self.graph.add(role.encode(), text.encode(), blank or seen, cut)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.graph.result())


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``rows`` (``conv, turn, role, text, gone, repeat``).

    One shuffle, by conversation: the sort that finds rows seen before (equal role and text)
    and the sort by turn both stay inside it and spill. The hash of a conversation's text is
    a chain, so one task has to read a whole conversation, but holds none of it."""
    by_turn = [F.col("turn").asc_nulls_first(), "role", "text", "repeat"]
    same = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "repeat")
    marked = rows.repartition("conv").withColumn("seen", ~F.col("gone") & (F.row_number().over(same) > 1))
    ordered = marked.sortWithinPartitions("conv", *by_turn).select(F.col("conv").cast("bigint"), "turn", "role", "text", "gone", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, turn, role, text, gone, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv, costs)
                if not gone:
                    now.add(turn, role, text, seen)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(now.row(), _SCHEMA)], schema=_SCHEMA)

    return ordered.mapInArrow(run, RESULT)
