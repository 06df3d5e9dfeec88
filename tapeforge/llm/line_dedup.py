"""Substring deduplication by line or paragraph hashing.

Texts are cut into units: lines (or paragraphs), and the sentences of a line that has
several, so that a passage set into the middle of a line is found. Short units that follow
each other are joined into runs of words enough. A unit is normalised
(lower case, single spaces, no marks at its ends) and hashed to 128 bits. Digests are
grouped over the corpus, the occurrence that ranks first is kept, and every other one
is reported with its offsets in the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tapeforge.llm.common import slices
from tapeforge.session import cut_lineage

MIN_WORDS = 13  # shorter units (headings, licence lines, stock phrases) are left alone where they stand alone
_CUTS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r]*\n")}
_INNER = re.compile(r"(?<=[.!?])\s+|\s\|\s")  # ends of sentences and cells
ACROSS = -1  # in place of the line, for a run over several
UNITS = "row long, doc_id long, start long, end long, inside long, digest binary"


def _parts(text: str, cut: re.Pattern, at: int, end: int, min_words: int) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of what lies between the cuts and has words enough, blanks at the borders left out."""
    out = []
    for m in [*cut.finditer(text, at, end), None]:
        stop = m.start() if m else end
        body = text[at:stop]
        if len(words := body.split()) >= max(min_words, 1):
            out.append((at + len(body) - len(body.lstrip()), at + len(body.rstrip()), words))
        at = m.end() if m else stop
    return out


def units(text: str | None, unit: str, min_words: int, sentences: bool) -> list[tuple[int, int, int | None, bytes]]:
    """(start, end, start of the line that a sentence is inside, digest) of each unit with ``min_words`` at least;
    code points, end exclusive."""
    text, out = text or "", []
    for start, end, words in _parts(text, _CUTS[unit], 0, len(text), min_words):
        inner = _parts(text, _INNER, start, end, min_words) if sentences else []
        inner = [p for p in inner if (p[0], p[1]) != (start, end)]
        for a, z, w, line in [(start, end, words, None), *[(*p, start) for p in inner]]:
            out.append((a, z, line, _digest(w)))
    return out


def _digest(words: list[str]) -> bytes:
    plain = " ".join(words).lower().strip(" .,;:!?|")
    return xxhash.xxh128_digest(plain.encode("utf-8", "surrogatepass"))


def runs(text: str | None, unit: str, min_words: int, sentences: bool,
         whole: list[tuple[int, int, int | None, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """As ``units``, for consecutive units under ``min_words``: from each one on, and up to each one, as few as reach it.

    The third value is ACROSS for a run over several lines. A run that is a unit of ``whole`` already, or that overlaps
    a unit or an earlier run of the same digest (short units that repeat at once), is left out.
    """
    text, out = text or "", []
    taken: dict[bytes, list[tuple[int, int]]] = {}
    for a, z, _, digest in whole:
        taken.setdefault(digest, []).append((a, z))
    for spans in taken.values():
        spans.sort()

    def join(short: list[tuple[int, int, int, list[str]]]) -> None:
        spans, i, n = set(), 0, 0
        for j, s in enumerate(short):  # the shortest run that ends here
            n += len(s[3])
            while n - len(short[i][3]) >= min_words:
                n -= len(short[i][3])
                i += 1
            if n >= min_words:
                spans.add((i, j))
        j, n = 0, 0
        for i, s in enumerate(short):  # the shortest run that starts here
            while n < min_words and j < len(short):
                n += len(short[j][3])
                j += 1
            if n < min_words:
                break
            spans.add((i, j - 1))
            n -= len(s[3])
        for i, j in sorted(spans):
            start, end, line = short[i][0], short[j][1], short[i][2]
            digest = _digest([w for s in short[i:j + 1] for w in s[3]])
            held = taken.setdefault(digest, [])
            at = bisect_left(held, (start, end))
            if (at and held[at - 1][1] > start) or (at < len(held) and held[at][0] < end):
                continue
            held.insert(at, (start, end))
            out.append((start, end, line if short[j][2] == line else ACROSS, digest))

    short: list[tuple[int, int, int, list[str]]] = []
    for start, end, words in _parts(text, _CUTS[unit], 0, len(text), 1):
        for a, z, w in _parts(text, _INNER, start, end, 1) if sentences else [(start, end, words)]:
            if len(w) < min_words:
                short.append((a, z, start, w))
            else:
                join(short)
                short = []
    join(short)
    return out


def _list(unit: str, min_words: int, sentences: bool):
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                whole = units(text, unit, min_words, sentences)
                for start, end, line, digest in whole + runs(text, unit, min_words, sentences, whole):
                    for c, v in zip(out, (row, doc, start, end, line, digest)):
                        c.append(v)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["row", "doc_id", "start", "end", "inside", "digest"])

    return run


def repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """(doc_id, start, end, digest, first_doc_id, first_start) of every unit to remove.

    Occurrences rank by doc_id (nulls last), then offset; rows that repeat a doc_id rank in the order in which they
    are read, once. Sentences of a line that goes as a whole are not listed. Runs of short units may overlap. Null and empty texts have no units. Only digests and offsets are shuffled; the group of a unit
    that very many documents hold is reduced map-side to its first occurrence, and its members meet it in a join
    that Spark splits when skewed.
    """
    found = cut_lineage(docs.select("doc_id", "text").mapInArrow(_list(unit, min_words, sentences), UNITS))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    firsts = (found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
              .where("n > 1").select("digest", "first"))
    firsts = cut_lineage(firsts)
    again = (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))
    gone = found.join(firsts, "digest").where(again).select(
        "row", "inside", "doc_id", "start", "end", F.lower(F.hex("digest")).alias("digest"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
    if sentences:
        gone = cut_lineage(gone)
        lines = gone.where("inside is null").select("row", F.col("start").alias("inside"))
        gone = gone.join(lines, ["row", "inside"], "left_anti")
    return gone.select("doc_id", "start", "end", "digest", "first_doc_id", "first_start")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (unique, non-null doc_id) with ``text`` cleared of the units in ``found`` and ``removed``, their original
    offsets in order. The spans of a document, at most one for each of its units, are gathered in one row."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("removed").to_pylist()):
            if gone and text is not None:
                parts, at = [], 0
                for s in gone:
                    parts.append(text[at:s["start"]] if s["start"] > at else "")
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            texts.append(text)
        return b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))

    joined = docs.drop("removed").join(spans, "doc_id", "left")
    return joined.mapInArrow(lambda batches: (cut(b) for b in slices(batches)), joined.schema)
