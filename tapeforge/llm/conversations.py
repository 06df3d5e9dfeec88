"""Repair of conversation structure by generalised LR parsing.

The roles of a sound conversation are ``(s? (u a)+)?``: perhaps a system row, then pairs of user
and assistant. The grammar is left-recursive, so its LR stacks stay shallow:

    conversation -> | pairs | s pairs        pairs -> pair | pairs pair        pair -> u a

A row that doesn't fit may be deleted, given another role, or have a row inserted before it. All
these ways are followed at once on a graph-structured stack: a cell is an LR state and the cell
below it, shared by every stack that grew from it. After each action stacks with equal tops
are merged, and the one with the least (cost, audit) goes on. Nothing is lost by that: an LR
state of this grammar fixes what may follow, whatever lies below it.

A conversation is read once, in order, holding a handful of stacks; each carries the digest of the
rows that it would give out, so texts are never kept. A digest over all rows of a conversation is
sequential by nature: the rows of one conversation, however many, stream through one task after
an external sort.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeforge.llm.common import schema_of, slices

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5  # added for a truncated row that stays
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}  # what a row may be given or inserted as
GRAMMAR = (("conversation", ()), ("conversation", ("pairs",)), ("conversation", ("s", "pairs")),
           ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
_COMMIT = 256  # rows after which the part of the audit that all stacks share is put aside


# --- the automaton ---------------------------------------------------------------------

def automaton(grammar=GRAMMAR) -> tuple[dict, dict, set[int]]:
    """(goto, reduce, accept): LR(0) item sets of the grammar, start state 0.

    ``goto[state, symbol]`` is the next state, ``reduce[state]`` the rule that a finished item of the
    state names; states in ``accept`` hold a finished rule of the start symbol.
    """
    start = grammar[0][0]

    def closure(items):
        items = set(items)
        while True:
            wanted = {rhs[dot] for r, dot in items for rhs in (grammar[r][1],) if dot < len(rhs)}
            more = {(r, 0) for r, (lhs, _) in enumerate(grammar) if lhs in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    states = [closure((r, 0) for r, (lhs, _) in enumerate(grammar) if lhs == start)]
    goto, reduce, accept = {}, {}, set()
    for k, state in enumerate(states):  # grows while it is read
        done = [r for r, dot in state if dot == len(grammar[r][1])]
        if any(grammar[r][0] == start for r in done):
            accept.add(k)
        reduce.update({k: r for r in done if grammar[r][0] != start})
        for symbol in sorted({grammar[r][1][dot] for r, dot in state if dot < len(grammar[r][1])}):
            to = closure((r, dot + 1) for r, dot in state if grammar[r][1][dot:dot + 1] == (symbol,))
            if to not in states:
                states.append(to)
            goto[k, symbol] = states.index(to)
    return goto, reduce, accept


class Parser:
    """Parses one conversation row by row; ``tops`` has the best stack for each LR state on top.

    A stack is a cell (state, cell below). With it go the cost, the audit since the last commit,
    and the digest of the rows given out.
    """

    def __init__(self):
        self.goto, self.reduce, self.accept = automaton()
        self.moves: dict = {}

    def start(self) -> None:
        self.rows, self.committed = 0, []
        self.tops = {0: (0, "", (0, None), None)}
        self._insert()

    def _shift(self, cell, terminal: str):
        """The stack after a terminal and the reductions that it brings; None if it doesn't fit."""
        if (cell, terminal) not in self.moves:
            state = self.goto.get((cell[0], terminal))
            if state is not None:
                to = (state, cell)
                while to[0] in self.reduce:
                    lhs, rhs = GRAMMAR[self.reduce[to[0]]]
                    for _ in rhs:
                        to = to[1]
                    to = (self.goto[to[0], lhs], to)
                self.moves[cell, terminal] = to
            else:
                self.moves[cell, terminal] = None
        return self.moves[cell, terminal]

    def _merge(self, tops: dict, cell, cost: int, audit: str, source, gives) -> bool:
        held = tops.get(cell[0])
        if held is not None and held[:2] <= (cost, audit):
            return False
        tops[cell[0]] = (cost, audit, cell, source, gives)
        return True

    def _digests(self, tops: dict) -> dict:
        """The winners with their digests: only now is any text hashed."""
        out = {}
        for state, (cost, audit, cell, source, gives) in tops.items():
            digest = source
            for role, text in gives:
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest = digest.copy()
                    digest.update(b"\n")
                digest.update(role + b":" + text)
            out[state] = (cost, audit, cell, digest)
        return out

    def _insert(self) -> None:
        """Rows inserted after the current tops, as long as that makes any top cheaper."""
        tops = {s: (*t, ()) for s, t in self.tops.items()}
        fresh = list(tops)
        while fresh:
            again = []
            for state in fresh:
                cost, audit, cell, source, gives = tops[state]
                for terminal, role in ROLES.items():
                    to = self._shift(cell, terminal)
                    if to and self._merge(tops, to, cost + COST[INSERT], audit + INSERT, source, (*gives, (role.encode(), b""))):
                        again.append(to[0])
            fresh = again
        self.tops = self._digests(tops)

    def row(self, role: str, text: bytes, must_go: bool, truncated: bool) -> None:
        """Follow every action on a row from every stack."""
        tops: dict = {}
        extra = TRUNCATED if truncated else 0
        ways = []
        if not must_go:
            ways = [(role[:1], KEEP, role)] + [(t, REROLE, r) for t, r in ROLES.items() if t != role[:1]]
        for cost, audit, cell, digest in self.tops.values():
            self._merge(tops, cell, cost + COST[DELETE], audit + DELETE, digest, ())
            for terminal, action, name in ways:
                if to := self._shift(cell, terminal):
                    self._merge(tops, to, cost + COST[action] + extra, audit + action, digest,
                                ((name.encode("utf-8", "surrogatepass"), text),))
        self.tops = self._digests(tops)
        self._insert()
        self.rows += 1
        if self.rows % _COMMIT == 0:
            shared = len(os.path.commonprefix([t[1] for t in self.tops.values()]))
            self.committed.append(next(iter(self.tops.values()))[1][:shared])
            self.tops = {s: (t[0], t[1][shared:], *t[2:]) for s, t in self.tops.items()}

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, sha256) of the cheapest whole parse."""
        cost, audit, _, digest = min((t for s, t in self.tops.items() if s in self.accept), key=lambda t: t[:2])
        return cost, "".join(self.committed) + audit, (digest or hashlib.sha256()).hexdigest()


# --- jobs --------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage that crc32 of ``conv_id:turn`` picks, a null being one space.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes out ``. ! ?``, 3 gives it twice, 4 makes it
    a user's; a null role or text becomes one space first. Repeated rows are all damaged alike.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    pick = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    d = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), pick.alias("_pick"))
    d = d.where("_pick <> 0").select(
        "conv_id", "turn", F.when(F.col("_pick") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("array_repeat(0, if(_pick = 3, 2, 1))")).alias("_copy"))
    return d.drop("_copy")


ORDER = ["conv_id", "turn", "role", "text"]


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, with ``seen``: role and text occurred in an earlier row.

    A conversation's order is by turn, nulls first, then by role and text. Both the window and the sort use one
    shuffle by conv_id, and both spill.
    """
    r = rows.select(*ORDER).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", F.md5(F.encode("text", "UTF-8"))).orderBy("turn")
    return r.withColumn("seen", F.row_number().over(same) > 1).sortWithinPartitions(*ORDER, F.col("seen"))


def _faults(text: str, seen: bool) -> str | None:
    end = text.rstrip(SPACE)[-1:]
    return "blank" if not end else "duplicate" if seen else "truncated" if end not in ".!?" else None


def _runs(batches) -> Iterator[tuple]:
    """Rows of the Arrow batches, each with whether it begins a conversation."""
    before: tuple | None = None
    for b in slices(batches):
        for values in zip(*(c.to_pylist() for c in b.columns)):
            yield before is None or values[0] != before[0], values
            before = values


RESULT = schema_of("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                              "cost long, audit string, repaired_sha256 string")


def _repair(batches) -> Iterator[pa.RecordBatch]:
    schema, parser, out = to_arrow_schema(RESULT), Parser(), []
    conv, turns, counts, before, held = None, [None, None, 0], {}, None, False

    def result() -> tuple:
        first, last, distinct = turns
        gaps = 0 if first is None else min(last - first + 1 - distinct, (1 << 63) - 1)
        return (conv, gaps, *(counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), *parser.finish())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for begins, (conv_id, turn, role, text, seen) in _runs(batches):
        if begins:
            if held:
                out.append(result())
            if len(out) >= 1000:
                yield batch()
                out = []
            conv, turns, before, held = conv_id, [None, None, 0], None, True
            counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            parser.start()
        if turn is not None and turn != turns[1]:  # in order, so a change is a new turn
            turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
        fault = _faults(text, seen)
        if fault:
            counts[fault] += 1
        if before is not None and before + role[:1] not in LEGAL:
            counts["illegal"] += 1
        before = role[:1]
        parser.row(role, text.encode("utf-8", "surrogatepass"), fault in ("blank", "duplicate"), fault == "truncated")
    if held:
        out.append(result())
    if out:
        yield batch()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row per conversation: its faults, and the cheapest edits that make its roles ``(s?(ua)+)?``.

    ``rows`` has conv_id and turn (integers), role and text; other columns are ignored, null roles and texts count as one
    space. A row's first fault counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and text
    of an earlier row), ``truncated`` (the last other character isn't ``. ! ?``). Keep costs 0, Rerole to user or
    assistant 1, Delete 2, Insert of an empty row 5; blank and duplicate rows must go, a truncated one that stays
    costs 5 more. ``audit`` has the edits' initials in order; of equal costs the ASCII-least audit wins.
    ``repaired_sha256`` is of the repaired ``role:text``, newline-joined. ``gaps`` counts missing turns between
    the least and the greatest. Null conv_ids are one conversation.
    ``conversations`` (conv_id), if given, names conversations that may have lost all rows: those get zeros.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = in_order(rows).mapInArrow(_repair, RESULT)
    if conversations is None:
        return found
    none = {f.name: F.lit("" if f.name == "audit" else hashlib.sha256().hexdigest()) if f.dataType == T.StringType()
            else F.lit(0).cast("long") for f in RESULT.fields[1:]}
    all_ids = conversations.select(F.col("conv_id").cast("long").alias("_all")).distinct()
    joined = all_ids.join(found, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("_all").alias("conv_id"),
                         *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()])


REPAIRED = schema_of("conv_id long, position long, role string, text string, action string")


def _apply(batches) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, head, turn, role, text, seen): the first of a conversation brings its audit as text."""
    schema, out = to_arrow_schema(REPAIRED), []
    edits, at, position, last = "", 0, 0, ""

    def give(conv, role, text, action):
        nonlocal position, last
        out.append((conv, position, role, text, action))
        position, last = position + 1, role[:1]

    def inserts(conv):
        nonlocal at
        while at < len(edits) and edits[at] == INSERT:
            give(conv, ROLES["a" if last == "u" else "u"], "", INSERT)
            at += 1

    for begins, (conv, head, _, role, text, _) in _runs(batches):
        if begins:
            edits, at, position, last = "", 0, 0, ""
        if head == 0:
            edits = text
        else:
            action = edits[at]
            at += 1
            if action != DELETE:
                give(conv, role if action == KEEP else ROLES["a" if last == "u" else "u"], text, action)
        inserts(conv)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, action): the conversations of ``rows`` after the audits of ``found`` (as ``repair`` gave it).

    An audit goes in front of its conversation's rows, and both are read once in order. A row that was given another
    role or inserted takes the role that the one before it asks for.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("head"),
                       F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("seen"))
    heads = found.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(False).alias("seen"))
    both = heads.unionAll(rows).repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "text")
    return both.mapInArrow(_apply, REPAIRED)
