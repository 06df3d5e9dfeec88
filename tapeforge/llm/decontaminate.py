"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Five-word seeds of the test items are looked up in every document. Where an item's
seeds could cover enough of it, the pair is tiled: the longest common run of unmarked
words is marked, then the next longest, down to the seed length. The share of the
item's words that lie in tiles is its coverage, whatever the order of the passages.

Items are handled in blocks of a bounded number of words. A block is collected and
broadcast as plain arrays, and the documents pass by it once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tapeforge.llm.common import map_rows, unused
from tapeforge.session import cut_lineage

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_BYTES = 8_000_000  # text of the items that are broadcast together
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PARTS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and control characters separate them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


class Rolling:
    """Hashes of all windows of a sequence of numbers, for any width, from one running sum."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.n = n
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        shrink = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), _INVERSE)])[:n]
        self.sums = np.r_[np.uint64(0), np.cumsum(ids.astype(np.uint64) * shrink)]

    def windows(self, width: int) -> np.ndarray:
        if width > self.n:
            return np.empty(0, np.uint64)
        return (self.sums[width:] - self.sums[:self.n - width + 1]) * self.power[width - 1:self.n]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Windows without a marked word."""
    total = np.r_[0, np.cumsum(marked)]
    return total[width:] == total[:len(marked) - width + 1]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in ``known``, which is sorted and not empty."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling: (doc position, item position, length), longest first, no word in two tiles.

    Equally long matches are taken in the order of their positions.
    """
    out: list[tuple[int, int, int]] = []
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    d_hash, i_hash = Rolling(doc), Rolling(item)
    width = max(least, min(len(item), len(doc)))
    while width >= least and len(item) >= width and len(doc) >= width:
        places = defaultdict(list)
        for q, (h, ok) in enumerate(zip(i_hash.windows(width).tolist(), _free(in_item, width))):
            if ok:
                places[h].append(q)
        if not places:
            if width == least:
                break
            width = max(least, width // 2)
            continue
        hashes = d_hash.windows(width)
        found = []
        for p in np.flatnonzero(_among(hashes, np.array(sorted(places), np.uint64)) & _free(in_doc, width)).tolist():
            for q in places[int(hashes[p])]:
                if p and q and not in_doc[p - 1] and not in_item[q - 1] and doc[p - 1] == item[q - 1]:
                    continue  # part of the match that begins one word earlier
                n = 0
                while (p + n < len(doc) and q + n < len(item) and not in_doc[p + n] and not in_item[q + n]
                       and doc[p + n] == item[q + n]):
                    n += 1
                if n >= width:
                    found.append((-n, p, q))
        hidden = False
        for n, p, q in sorted(found):
            if in_doc[p:p - n].any() or in_item[q:q - n].any():
                hidden = True
            else:
                in_doc[p:p - n] = in_item[q:q - n] = True
                out.append((p, q, -n))
        if hidden:
            continue  # what is left of a covered match may still be long enough
        if width == least:
            break
        width = max(least, width // 2)
    return out


class Block:
    """Some test items, with the seeds that lead to them. An item under ``least`` words is one seed of its own width.

    ``raw`` is what travels: the vocabulary as one string and sorted arrays, nothing that needs this package.
    """

    def __init__(self, raw: dict):
        self.least, self.names = raw["least"], raw["names"]
        self.vocabulary = {w: k for k, w in enumerate(raw["words"].split(b" "), 1)} if raw["words"] else {}
        self.items = np.split(raw["ids"], raw["ends"][:-1])
        self.seeds = raw["seeds"]  # width: (hashes in order, item and position of each)
        self.shortest = min(self.seeds, default=0)

    @staticmethod
    def pack(rows: list[tuple[int | None, str | None]], least: int) -> dict:
        vocabulary: dict[bytes, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int64) for _, text in rows]
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, ids in enumerate(items):
            if len(ids):
                width = min(least, len(ids))
                found[width].append((Rolling(ids).windows(width), k))
        seeds = {}
        for width, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            item = np.repeat([k for _, k in parts], [len(h) for h, _ in parts]).astype(np.int32)
            at = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts])
            order = np.lexsort((at, item, hashes))
            seeds[width] = (hashes[order], item[order], at[order])
        return {"least": least, "names": [r[0] for r in rows], "words": b" ".join(vocabulary), "seeds": seeds,
                "ids": np.concatenate([np.empty(0, np.int64), *items]), "ends": np.cumsum([len(i) for i in items])}

    def match(self, text: str | None, coverage: float) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, coverage, tiles) of the items that the text covers by the given share at least."""
        w = words(text)
        if not self.shortest or len(w) < self.shortest:
            return []
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w))
        rolling, unknown = None, ids == 0
        reach: dict[int, set[int]] = defaultdict(set)
        for width, (hashes, item, position) in self.seeds.items():
            at = np.flatnonzero(_free(unknown, width)) if len(ids) >= width else ()
            if not len(at):
                continue
            rolling = rolling or Rolling(ids)
            mine = np.unique(rolling.windows(width)[at])
            begin, end = (np.searchsorted(hashes, mine, side) for side in ("left", "right"))
            for x, y in zip(begin[begin < end].tolist(), end[begin < end].tolist()):
                for k, q in zip(item[x:y].tolist(), position[x:y].tolist()):
                    reach[k].update(range(q, q + width))
        out = []
        for k in sorted(reach):
            item = self.items[k]
            if len(reach[k]) < coverage * len(item):
                continue  # tiles lie within the seeds, so they can't cover more
            found = tiles(ids, item, min(self.least, len(item)))
            share = sum(t[2] for t in found) / len(item)
            if share >= coverage:
                out.append((k, share, found))
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in lists of ``block_bytes`` of text at most (or one larger item alone); the driver holds
    a partition and a list at a time."""
    out, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(r.text.encode("utf-8", "surrogatepass"))
        if out and size + n > block_bytes:
            yield out
            out, size = [], 0
        out.append((r.item_id, r.text))
        size += n
    if out:
        yield out


def _by_block(docs: DataFrame, benchmark: DataFrame, schema: str, least: int, rows_of) -> DataFrame:
    """Rows of ``schema`` for (doc_id, text) and each block of items in turn. A block's rows are written before the next is
    broadcast, so one block is held at a time, however large the benchmark."""
    out = None
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Block.pack(rows, least))
        held: list[Block] = []

        def run(b, shared=shared, held=held):
            if not held:
                held.append(Block(shared.value))
            found = [rows_of(held[0], *r) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            return list(zip(*(r for some in found for r in some))) or [[] for _ in schema.split(",")]

        part = cut_lineage(map_rows(docs.select("doc_id", "text"), schema, run))
        shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for each test item that a document covers by ``coverage`` at least.

    ``tiles`` lists doc word:item word:length in the order of marking. Null and empty
    texts match nothing; an item with fewer than ``least`` words matches where all of it stands
    word for word, one without words nowhere; repeated documents or items give a row each; other columns are ignored.
    """
    def rows_of(block, doc_id, text):
        return [(doc_id, block.names[k], share, ",".join("%d:%d:%d" % m for m in marked))
                for k, share, marked in block.match(text, coverage)]

    return _by_block(docs, benchmark, "doc_id long, item_id long, coverage double, tiles string", least, rows_of)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE,
                        least: int = SEED_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no test item by ``coverage``, with all their columns.

    Whether a row goes depends on its text alone, so the digests of texts that match are written, and the rows meet
    them in an anti-join; the digests are broadcast only if the written table is small.
    """
    def rows_of(block, _, text):
        return [(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest(),)] if block.match(text, coverage) else []

    name = unused("_digest", docs.columns)
    gone = cut_lineage(_by_block(docs, benchmark, "digest string", least, rows_of).distinct().withColumnRenamed("digest", name))
    return docs.withColumn(name, F.md5(F.encode("text", "UTF-8"))).join(gone, name, "left_anti").select(*docs.columns)
