"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has the majority bit of the XXH64 hashes of a text's word shingles.
Equal fingerprints are collapsed first. Two that differ in at most two bits agree on
two of four 16-bit quarters at least, so each distinct fingerprint is filed under the
six pairs of quarters. Inside a block the fingerprints are stored as vertical bit
planes: one long integer holds bit b of all of them. Shifting a plane by s and
xoring compares everything with its s-th neighbour at once; a two-bit carry-save
counter per lane adds the planes up, and a shift is abandoned as soon as every lane
has gone past the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.llm.common import map_rows, unused
from tapeforge.llm.components import components
from tapeforge.session import cut_lineage

RADIUS = 2  # the carry-save counters and the six tables are made for this radius
SHINGLE = 3
SEED = 42
TILE = 4096  # fingerprints of a block that one task compares; larger blocks are cut into pairs of tiles
_CHUNK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = [words[i + j:min(i + _CHUNK, n) + j] for j in range(k)]
        hashes = np.array([digest(b" ".join(w), SEED) for w in zip(*part)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(b: pa.RecordBatch) -> list[list]:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        return [b.column(0), fps.view(np.int64)]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id long, fp long", run)


# --- inside a block ---------------------------------------------------------------

def _pack(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _lanes(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=n))


def close_pairs(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of the same run that differ in at most two bits; ``run`` must be grouped."""
    size = np.unique(run, return_inverse=True, return_counts=True)
    length = size[2][size[1]]
    left, right = [], []
    rows, shift, packed_at = np.arange(len(fps)), 1, 0
    planes: list[int] = []
    while True:
        if shift >= 2 * packed_at:  # drop the rows of runs that are through, and pack the rest anew
            rows, packed_at = rows[length[rows] > shift], shift
            if len(rows) < 2:
                break
            bits = np.unpackbits(fps[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            planes = [_pack(bits[:, b]) for b in range(64)]
            packed_run = run[rows]
        if len(rows) <= shift:
            break
        active = _pack(packed_run[shift:] == packed_run[:-shift])
        if not active:
            if length[rows].max() <= shift:
                break
            shift += 1
            continue
        one = two = over = 0
        for b, plane in enumerate(planes):
            x = (plane ^ (plane >> shift)) & active
            two |= one & x
            one ^= x
            over |= one & two
            two &= ~over  # a lane that is over stays over; its counter no longer matters
            if b & 7 == 7 and not active & ~over:
                break
        if alive := active & ~over:
            i = _lanes(alive, len(rows))
            left.append(rows[i])
            right.append(rows[i + shift])
        shift += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The links that join two trees when added in turn: enough to keep a block connected."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _compare(batches):
    """Rows sorted by block: compare whole blocks, carry an unfinished one to the next batch."""
    held_fp, held_run = np.empty(0, np.uint64), np.empty((0, 3), np.int64)

    def links(fps, key):
        run = np.cumsum(np.r_[0, np.any(key[1:] != key[:-1], axis=1)]) if len(key) else np.empty(0, np.int64)
        kept = _forest(*close_pairs(fps, run))
        u, v = ([k[s] for k in kept] for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(fps[u].view(np.int64)), pa.array(fps[v].view(np.int64))], ["u", "v"])

    for b in batches:
        fps = np.r_[held_fp, b.column(0).to_numpy().view(np.uint64)]
        key = np.r_[held_run, np.stack([b.column(c).to_numpy() for c in (1, 2, 3)], axis=1)]
        if not len(fps):
            continue
        last = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1 if np.any(key != key[-1]) else 0
        held_fp, held_run = fps[last:], key[last:]
        if last:
            yield links(fps[:last], key[:last])
    if len(held_fp):
        yield links(held_fp, held_run)


def _quarters(fp: Column) -> Column:
    """Block keys: the table's number in the high bits, then two of the four quarters."""
    q = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return F.array(*[F.lit(t << 32) + F.shiftleft(q[a], 16) + q[b] for t, (a, b) in enumerate(combinations(range(4), 2))])


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column ``fp``; a spanning forest of every block.

    A block with more than ``tile`` members is cut into tiles by a hash, and each pair
    of tiles is a block of its own, so no task gets more than two tiles of a block
    and every pair is still compared.
    """
    filed = distinct.select("fp", F.explode(_quarters(F.col("fp"))).alias("key"))
    hot = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    hot = hot.select("key", F.ceil(F.col("n") / tile).alias("tiles"))
    filed = filed.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    cut = filed.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    cut = cut.select("fp", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    dealt = cut.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are what stands between ASCII white space, A-Z lower-cased; shingles are three
    words, repeats included. A null or empty text, or one without words, has fingerprint
    zero, which is linked like any other. ``component_id`` is the smallest doc_id
    reachable over links of at most two bits; rows with a null doc_id take part but never
    name a component. Rows that repeat a doc_id each get a row. Other columns are ignored.
    Groups of copies, however large, cost one fingerprint in the comparison.
    """
    fps = cut_lineage(fingerprints(docs, doc_id, text))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct), "u", "v")
    rooted = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut_lineage(rooted.join(named, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates of an earlier row: of each group the row with the smallest doc_id stays.

    Null doc_ids come after all others; among equal doc_ids the text with the smaller hash
    comes first, and of rows that repeat both one is kept. All columns are returned.
    """
    text_hash = F.xxhash64(text)
    slim = map_rows(docs.select(F.col(doc_id).alias("doc_id"), text_hash.alias("h"), F.col(text).alias("text")),
                    "doc_id long, h long, fp long",
                    lambda b: [b.column(0), b.column(1), np.array([fingerprint(t) for t in b.column(2).to_pylist()],
                                                                  np.uint64).view(np.int64)])
    slim = cut_lineage(slim)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    distinct = cut_lineage(slim.groupBy("fp").agg(F.min(rank).alias("rank")))
    return keep_first(docs, slim, distinct, "fp", components(links(distinct), "u", "v"), doc_id, text)


def keep_first(docs: DataFrame, slim: DataFrame, distinct: DataFrame, key: str, roots: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that rank first in their group: ``slim`` (doc_id, h) lists the rows, ``distinct`` (``key``, rank)
    what was grouped, ``roots`` (node, root) the groups."""
    roots = roots.withColumnRenamed("node", "root_of")
    keys = [unused(k, docs.columns) for k in ("_id", "_null", "_h")]
    stays = (distinct.join(roots, distinct[key] == roots.root_of, "left")
             .groupBy(F.coalesce("root", key).alias("root")).agg(F.min("rank").alias("rank"))
             .select(F.coalesce("rank.doc_id", F.lit(0)).alias(keys[0]), F.col("rank.last").alias(keys[1]),
                     F.col("rank.h").alias(keys[2])))
    stays = cut_lineage(stays)
    text_hash = F.xxhash64(text)
    marked = docs.select("*", F.coalesce(doc_id, F.lit(0)).cast("long").alias(keys[0]),
                         F.col(doc_id).isNull().alias(keys[1]), text_hash.alias(keys[2]))
    kept = marked.join(stays, keys, "left_semi")
    again = (slim.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if not again.isEmpty():
        kept = kept.dropDuplicates(keys)
    return kept.drop(*keys)
