"""Bounded-space online packing.

A task reads its documents once and keeps a fixed number of open windows. A document goes where it leaves the least
room; where none fits and all windows are in use, the fullest is topped up with the document's beginning and given
out, and the rest of the document goes on. What is still open when a task ends is merged: the open windows
of some tasks are packed together by the same rule, and so on until one group is left. Its last windows are laid end
to end and cut into whole sequences and then powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tapeforge.llm.common import schema_of, slices
from tapeforge.llm.tokens import encoder
from tapeforge.session import cut_lineage

CAPACITY = 4096
OPEN = 32   # windows that a task keeps open
MERGED = 32  # tasks whose open windows are packed together at the next level

PIECES = schema_of("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                              "offset long, group long, rank long, ids binary")
RESULT = [f.name for f in PIECES.fields[:7]]


class Piece:
    """Consecutive ids of a document, 4 bytes each."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.ids[:4 * n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.doc_tokens))


class Windows:
    """The open windows of a task; ``place`` gives out those that are full."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.held: list[tuple[int, list[Piece]]] = []  # (room, pieces)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) >= self.capacity:
            whole, piece = piece.cut(self.capacity)
            yield [whole]
        while len(piece):
            n = len(piece)
            fits = [(room, k) for k, (room, _) in enumerate(self.held) if room >= n]
            if fits:
                room, k = min(fits)
                self.held[k][1].append(piece)
                if room == n:
                    yield self.held.pop(k)[1]
                else:
                    self.held[k] = (room - n, self.held[k][1])
                return
            if len(self.held) < self.most:
                self.held.append((self.capacity - n, [piece]))
                return
            k = min(range(len(self.held)), key=lambda w: self.held[w][0])  # the fullest
            room, pieces = self.held.pop(k)
            head, piece = piece.cut(room)
            yield [*pieces, head]

    def end_to_end(self) -> Iterator[list[Piece]]:
        """All that is open as whole sequences, and the rest as falling powers of two."""
        left = sum(self.capacity - room for room, _ in self.held)
        pieces = [p for _, w in sorted(self.held, key=lambda w: w[0]) for p in w][::-1]
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                p = pieces.pop()
                if len(p) > size:
                    p, rest = p.cut(size)
                    pieces.append(rest)
                window.append(p)
                size -= len(p)
            yield window


class _Output:
    def __init__(self, task: int):
        self.schema, self.task, self.number, self.rows = to_arrow_schema(PIECES), task, 0, []

    def sequence(self, window: list[Piece]) -> None:
        at = 0
        for p in window:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.task + self.number, at,
                              None, None, None))
            at += len(p)
        self.number += 1

    def still_open(self, windows: Windows, group: int) -> None:
        rank = 0
        for _, pieces in windows.held:
            for p in pieces:
                self.rows.append((p.doc_id, p.start, len(p), None, p.doc_tokens, None, None, group, rank, p.ids))
                rank += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


def _first(batches, tokenizer: str, end_id: int, capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    """Encode and pack the documents of one task."""
    task, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
    windows, out = Windows(capacity, most), _Output(task << 40)
    for b in slices(batches):
        encoded = encoder(tokenizer, False).encode_batch(b.column(1).to_pylist())
        for doc, ids in zip(b.column(0).to_pylist(), encoded):
            ids += end
            for window in windows.place(Piece(doc, 0, ids, len(ids) // 4)):
                out.sequence(window)
        if out.rows:
            yield out.batch()
    out.still_open(windows, task)
    if out.rows:
        yield out.batch()


def _again(batches, capacity: int, most: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack the open pieces of groups that were merged; rows (merged, group, rank, doc_id, start, doc_tokens, ids) in order."""
    now, windows, out = None, Windows(capacity, most), None

    def done():
        if last:
            for window in windows.end_to_end():
                out.sequence(window)
        else:
            out.still_open(windows, now)

    for b in slices(batches):
        for merged, _, _, doc, start, doc_tokens, ids in zip(*(c.to_pylist() for c in b.columns)):
            if merged != now:
                if now is not None:
                    done()
                now, windows = merged, Windows(capacity, most)
                rows = out.rows if out else []
                out = _Output((level << 58) | (merged << 40))
                out.rows = rows
            for window in windows.place(Piece(doc, start, ids, doc_tokens)):
                out.sequence(window)
        if out and out.rows:
            yield out.batch()
    if now is not None:
        done()
        if out.rows:
            yield out.batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, most: int = OPEN, merged: int = MERGED,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in one piece.

    A null or empty text is the end id alone. Rows that repeat a doc_id, and rows with a null one, are packed each by
    itself. An empty table gives an empty result; other columns are ignored. All sequences are ``capacity`` long but for
    a dozen at most, whose lengths are different powers of two, whatever the table's size.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut_lineage(slim.mapInArrow(lambda b: _first(b, tokenizer, end_id, capacity, most), PIECES))
    out, level = rows.where("group is null"), 0
    while True:
        still = rows.where("group is not null").withColumn("merged", F.expr(f"group div {merged}"))
        groups = still.agg(F.max("merged")).first()[0]
        if groups is None:
            return out.select(RESULT)
        level += 1
        still = still.select("merged", "group", "rank", "doc_id", "start", "doc_tokens", "ids")
        still = still.repartition(groups + 1, "merged").sortWithinPartitions("merged", "group", "rank")
        rows = cut_lineage(still.mapInArrow(lambda b, k=level, e=groups == 0: _again(b, capacity, most, k, e), PIECES))
        out = out.unionByName(rows.where("group is null"))
