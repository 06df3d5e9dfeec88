"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words differ by one inserted, deleted or replaced code point exactly if they differ and their common prefix and
common suffix together reach the longer length minus one. So they share either the first half or the last half of the
longer one's length: every word is filed under its first and last half, once for its own length and once for the length
above. A block's words become matrices of padded code points, one aligned left and one aligned right; tiles of
rows are compared with tiles of rows, and the lengths of common prefixes and suffixes are counted for whole tiles.
A pair is taken from its prefix block if the prefix reaches the half, else from its suffix block, so it is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeforge.llm.common import slices
from tapeforge.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10            # a form is at least so many times as frequent
DAMAGE = 31           # the remainder class whose runs lose a code point
TILE = 4096           # words of a block that one task compares with as many others
_TILE_CELLS = 1 << 22  # code points of a comparison held at once
_SHARED = 192         # words of small blocks that are compared in one tile
_COUNTED = 200_000    # distinct words after which a task gives out its counts


# --- counting ------------------------------------------------------------------------

def damaged_runs(doc_id: object, text: str | None, least: int = LEAST_LENGTH) -> Counter:
    """Counts of a text's lower-cased letter runs that keep at least ``least`` code points after damage.

    A run is damaged if 31 divides the unsigned crc32 h of ``doc_id:run``: it loses its code point h % length.
    """
    # Every letter of a run is one byte of Latin-1; anything beyond becomes a question mark, which no run holds.
    raw = (text or "").encode("latin-1", "replace").lower()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(re.findall(rb"[a-z\xc0-\xff]{%d,}" % least, raw)).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), head)
        if h % DAMAGE == 0:
            if len(word) == least:
                continue
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each word of at least seven code points occurs; counted in the tasks before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def give():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update(damaged_runs(i, t))
                if len(held) >= _COUNTED:
                    yield give()
                    held = Counter()
        yield give()

    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- comparing -----------------------------------------------------------------------

def _matrix(words: list[str], width: int) -> np.ndarray:
    """A row of zero-padded code points for each word."""
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of all rows of ``a`` with all rows of ``b`` where ``same`` holds, column by column."""
    same = same.copy()
    out = np.zeros(same.shape, np.uint16 if a.shape[1] < 1 << 16 else np.uint32)
    for c in range(a.shape[1]):
        same &= a[:, c, None] == b[None, :, c]
        if not same.any():
            break
        out += same
    return out


class Rows:
    """Words of one or more blocks with what the comparison needs; a block has one number, length and kind."""

    def __init__(self):
        self.words: list[str] = []
        self.counts: list[int] = []
        self.block: list[int] = []
        self.length: list[int] = []
        self.by_prefix: list[bool] = []

    def add(self, word: str, n: int, block: int, length: int, by_prefix: bool) -> None:
        self.words.append(word)
        self.counts.append(n)
        self.block.append(block)
        self.length.append(length)
        self.by_prefix.append(by_prefix)


def single_edits(left: Rows, right: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of words of the same block, one edit apart, the longer of them as long as the block says.

    A pair belongs to the prefix block if its prefix reaches half the length, else to the suffix block. Tiles of rows are
    compared with tiles of rows; a tile's matrices hold a bounded number of code points.
    """
    width = max(map(len, [*left.words, *right.words]), default=0)
    step = max(1, min(1024, int((_TILE_CELLS / max(1, width)) ** 0.5), _TILE_CELLS // max(1, width)))
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def tile(rows: Rows, k: int):
        words = rows.words[k:k + step]
        return (_matrix(words, width), _matrix([w[::-1] for w in words], width), np.array([len(w) for w in words]),
                np.array(rows.block[k:k + step]))

    for i in range(0, len(left.words), step):
        a, a_back, la, block = tile(left, i)
        length = np.array(left.length[i:i + step])[:, None]
        whole = np.array(left.by_prefix[i:i + step])[:, None]
        for j in range(0, len(right.words), step):
            b, b_back, lb, other = tile(right, j)
            longer, shorter = np.maximum(la[:, None], lb), np.minimum(la[:, None], lb)
            may = (block[:, None] == other) & (longer == length) & (longer - shorter <= 1)
            if not may.any():
                continue
            prefix = np.minimum(_common(a, b, may), shorter)  # equal padding is no common letter
            suffix = np.minimum(_common(a_back, b_back, may), shorter)
            # a prefix as long as both words is the word itself
            near = may & (prefix + suffix >= longer - 1) & (prefix < longer) & ((prefix >= longer // 2) == whole)
            x, y = np.nonzero(near)
            found_i.append(x + i)
            found_j.append(y + j)
    return np.concatenate(found_i), np.concatenate(found_j)


LINKS = "word string, other string, other_n long"
BLOCK = ["length", "by_prefix", "key"]


def _compare(batches) -> Iterator[pa.RecordBatch]:
    """Rows (word, n, length, by_prefix, key, a, b, own), sorted by all but the first two.

    Small blocks share a tile, which their numbers keep apart; a pair of tiles of a large block is compared by itself.
    """
    left, right, at, block = Rows(), Rows(), None, 0

    def links():
        other = right if right.words else left
        i, j = single_edits(left, other)
        rows = [(left.words[x], other.words[y], other.counts[y]) for x, y in zip(i.tolist(), j.tolist())]
        if right.words:
            rows += [(other.words[y], left.words[x], left.counts[x]) for x, y in zip(i.tolist(), j.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()))], ["word", "other", "other_n"])

    for batch in slices(batches, 4096):
        for word, n, *now, own in zip(*(c.to_pylist() for c in batch.columns)):
            if now != at:
                length, by_prefix, _, a, b = now
                if at is not None and (len(left.words) >= _SHARED or a != b or right.words):
                    yield links()
                    left, right = Rows(), Rows()
                at, block = now, block + 1
            (left if own == a else right).add(word, n, block, length, by_prefix)
    if at is not None:
        yield links()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, other, other_n): every ordered pair of words (word, n) that differ by exactly one edit, once.

    A word of length l is filed for the longer lengths l and l + 1, under the first half and under the rest. A block of
    more than ``tile`` words is cut into tiles by a hash, and every pair of its tiles is a task's unit of its own.
    """
    filed = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length"))
    filed = filed.select("word", "n", "length", F.explode(F.array(
        F.struct(F.lit(True).alias("by_prefix"), F.expr("left(word, cast(length div 2 as int))").alias("key")),
        F.struct(F.lit(False).alias("by_prefix"), F.expr("right(word, cast(length - length div 2 as int))").alias("key")))).alias("f"))
    filed = filed.select("word", "n", "length", "f.*")
    sized = filed.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("members")).where("members > 1")  # one word has no pair
    sized = sized.select(*BLOCK, F.ceil(F.col("members") / tile).cast("long").alias("tiles"))
    cut = filed.join(sized, BLOCK)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")))
    cut = cut.withColumn("opposite", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cut = cut.select("word", "n", *BLOCK, F.least("own", "opposite").alias("a"), F.greatest("own", "opposite").alias("b"), "own")
    return cut.repartition(*BLOCK, "a", "b").sortWithinPartitions(*BLOCK, "a", "b", "own").mapInArrow(_compare, LINKS)


# --- forms -----------------------------------------------------------------------------

def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` in whole texts (null: none), A-Z lower-cased, one in 31 damaged by crc32 of
    ``doc_id:run`` (a null doc_id reads as empty). Words have at least seven code points and two occurrences ``n``.
    ``n_near`` counts the words exactly one inserted, deleted or replaced code point away. ``form`` is the most
    frequent of them (ties: the first in code-point order) if it occurs ten times as often, else null; ``root``
    follows forms to the last. Repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    words = cut_lineage(word_counts(docs, doc_id, text))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))  # UTF-8 order is code-point order
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    d = words.join(near, "word", "left")
    fits = -F.col("best.less") >= RATIO * F.col("n")
    d = cut_lineage(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    return d.join(roots(d.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form. Counts grow tenfold along a chain, so a few doublings reach its end."""
    jump = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(jump.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jump = further.drop("moved")
        if further.where("moved").isEmpty():
            return jump
