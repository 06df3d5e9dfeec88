"""SimHash near-dedup on five-word shingles, for the stage of the pipeline.

Equal shingle sets are collapsed first. Sixteen bands of six min-hashes file each distinct set in buckets; two sets
of similarity 0.8 share a bucket with a probability of 0.992. Inside a bucket the sets' SimHash fingerprints are
compared bit-sliced: bit planes stand vertically in long integers, carry-save adders count the differing bits of every
lane at once, and a shift is abandoned as soon as all its lanes exceed the radius. Members that are left
with a partner form a candidate group of that bucket alone; groups never grow by way of other buckets. Inside a
group all pairs are counted exactly by their shingles, so a link never rests on an estimate.

A group is compared in tiles bounded by rows and by shingles. One of several tiles links its tiles' insides first, then
one set of each cluster found so far; after that only sets outside a group's largest cluster still have to meet the
others, so a group of very many copies of one text costs little more than its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tapeforge.llm.common import map_rows, slices, unused
from tapeforge.llm.components import components
from tapeforge.llm.simhash import SEED, _forest, _lanes, _pack
from tapeforge.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 16, 6
RADIUS = 20        # bits; of the pairs of similarity 0.8 or more on sf0.1 all lie within it (README)
BUCKET = 512       # members of a bucket that one task compares bit-sliced; larger buckets are cut into pairs of tiles
TILE_SETS, TILE_SHINGLES = 512, 1 << 18  # of a group that one task compares exactly
_CHUNK = 2048
_RND = np.random.default_rng(SEED)
_MUL = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


# --- a text --------------------------------------------------------------------------

def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text under five words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(w), SEED) for w in zip(*(words[j:len(words) - k + 1 + j] for j in range(k)))],
                              np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[i:i + _CHUNK, None] * _MUL + _ADD).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a shingle set: the bits that over half of the shingles have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _describe(b: pa.RecordBatch) -> list[list]:
    sets = [shingles(t) for t in b.column(2).to_pylist()]
    return [b.column(0), b.column(1), [xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], [len(s) for s in sets],
            [fingerprint(s) for s in sets], [band_keys(s) for s in sets]]


# --- a bucket, bit-sliced -------------------------------------------------------------

def _exceeds(counters: list[int], radius: int) -> int:
    """Lanes whose counter, least significant plane first, is greater than ``radius``."""
    greater, equal = 0, -1
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def _save(a: int, b: int, c: int) -> tuple[int, int]:
    """Carry-save adder: (sum, carry) of three planes, all lanes at once."""
    u = a ^ b
    return u ^ c, a & b | u & c


def close_pairs(fps: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of the same run whose fingerprints differ in at most ``radius`` bits; ``run`` must be grouped."""
    _, of, often = np.unique(run, return_inverse=True, return_counts=True)
    length = often[of]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
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
        one = two = four = 0
        eights = [0, 0, 0, 0]  # of 8, 16, 32 and 64 differing bits
        over = 0
        for at in range(0, 64, 8):
            x = [(p ^ p >> shift) & active for p in planes[at:at + 8]]
            one, two_a = _save(one, x[0], x[1])
            one, two_b = _save(one, x[2], x[3])
            two, four_a = _save(two, two_a, two_b)
            one, two_a = _save(one, x[4], x[5])
            one, two_b = _save(one, x[6], x[7])
            two, four_b = _save(two, two_a, two_b)
            four, carry = _save(four, four_a, four_b)
            for k in range(4):
                eights[k], carry = eights[k] ^ carry, eights[k] & carry
            over = _exceeds([one, two, four, *eights], radius)
            if not active & ~over:
                break  # every lane is beyond the radius
        if alive := active & ~over:
            i = _lanes(alive, len(rows))
            left.append(rows[i])
            right.append(rows[i + shift])
        shift += 1
    return np.concatenate(left), np.concatenate(right)


def _candidates(batches):
    """Rows (node, fp, key, a, b) sorted by the last three: the groups of close members of every bucket."""
    rows: list[tuple] = []

    def groups(rows):
        nodes, fps, *key = (np.array(c, np.int64) for c in zip(*rows))
        key = np.stack(key, axis=1)
        run = np.cumsum(np.r_[0, np.any(key[1:] != key[:-1], axis=1)])
        tree: dict[int, list[int]] = {}
        root: dict[int, int] = {}
        for x, y in _forest(*close_pairs(fps.view(np.uint64), run)):
            a, b = root.setdefault(x, x), root.setdefault(y, y)
            if len(tree.setdefault(a, [a])) < len(tree.setdefault(b, [b])):
                a, b = b, a
            for z in tree[b]:
                root[z] = a
            tree[a] += tree.pop(b)
        members = [sorted(nodes[t].tolist()) for t in tree.values()]
        names = [hashlib.blake2b(np.array(m, "<i8").tobytes(), digest_size=16).digest() for m in members]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.list_(pa.int64()))], ["name", "members"])

    for b in slices(batches, BUCKET):
        rows += zip(*(c.to_pylist() for c in b.columns))
        if len(rows) >= BUCKET:  # whole buckets only; the last one may go on
            last, cut = rows[-1][2:], len(rows)
            while cut and rows[cut - 1][2:] == last:
                cut -= 1
            if cut:
                yield groups(rows[:cut])
                rows = rows[cut:]
    if rows:
        yield groups(rows)


def candidate_groups(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(grp, node): members of a bucket of ``distinct`` (node, fp, bands) with a partner within the radius there.

    A bucket of more than ``bucket`` members is cut into tiles by a hash, and each pair of tiles is compared as a bucket
    of its own. Groups with the same members, from several buckets, are one.
    """
    filed = distinct.select("node", "fp", F.explode("bands").alias("key"))
    heads = filed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    heads = heads.select("key", F.ceil(F.col("members") / bucket).cast("long").alias("tiles"))
    filed = filed.join(heads, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    cut = filed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cut = cut.select("node", "fp", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    dealt = cut.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    found = dealt.mapInArrow(_candidates, "name binary, members array<long>").dropDuplicates(["name"])
    found = cut_lineage(found.select(F.monotonically_increasing_id().alias("grp"), "members"))
    return found.select("grp", F.explode("members").alias("node"))


# --- a group, exactly -------------------------------------------------------------------

def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of all sets that share 0.8 of their union at least."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, often = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(element, kind="stable")]
    end = np.cumsum(often)
    begin, bounds = end - often, np.r_[0, np.cumsum(sizes)]
    left, right = [], []
    for i in range(len(sets)):
        mine = element[bounds[i]:bounds[i + 1]]
        mine = mine[often[mine] > 1]
        if 5 * len(mine) < 4 * sizes[i] or not len(mine):
            continue  # too few of its shingles occur elsewhere
        shared = np.bincount(np.concatenate([holders[a:z] for a, z in zip(begin[mine], end[mine])]), minlength=len(sets))
        j = np.flatnonzero(9 * shared[i + 1:] >= 4 * (sizes[i] + sizes[i + 1:])) + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(batches):
    """Rows (node, set, grp, a, b) sorted by the last three: a forest of the links of each run of equal ones."""
    key, nodes, sets = None, [], []

    def links():
        kept = _forest(*similar(sets))
        u, v = ([nodes[k[s]] for k in kept] for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in slices(batches):
        for node, raw, *at in zip(*(c.to_pylist() for c in b.columns)):
            if at != key:
                if len(sets) > 1:
                    yield links()
                key, nodes, sets = at, [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
    if len(sets) > 1:
        yield links()


def _links(met: DataFrame) -> DataFrame:
    """(u, v) out of rows (grp, a, b, node, shingles): what meets in one (grp, a, b) is compared."""
    dealt = met.select("node", "shingles", "grp", "a", "b").repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    return dealt.mapInArrow(_compare, "u long, v long")


def links(groups: DataFrame, sets: DataFrame, tile_sets: int = TILE_SETS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(u, v): links that connect what any pair of similar members of a group connects. ``groups`` has (grp, node),
    ``sets`` (node, n, shingles)."""
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile_sets), F.ceil(F.sum("n") / tile_shingles)).cast("long")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles"))
    groups = groups.join(sets.select("node", "n"), "node")
    held = cut_lineage(groups.join(groups.groupBy("grp").agg(tiles.alias("tiles")), "grp").withColumn("tile", tile))
    shipped = sets.select("node", "shingles")
    inside = held.select("grp", F.col("tile").alias("a"), F.col("tile").alias("b"), "node")
    found = cut_lineage(_links(inside.join(shipped, "node")))
    large = held.where("tiles > 1")
    if large.isEmpty():
        return found

    def clusters(large: DataFrame) -> DataFrame:
        """``large`` with the cluster that a member is in so far; groups that are one cluster are done."""
        named = components(found, "u", "v").withColumnRenamed("root", "cluster")
        d = large.drop("cluster").join(named, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        open_ = d.groupBy("grp").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y").select("grp")
        return cut_lineage(d.join(open_, "grp", "left_semi"))

    large = clusters(large)  # one member for each cluster of a group, in tiles
    first = large.groupBy("grp", "cluster").agg(F.min(F.struct("node", "n")).alias("s")).select("grp", "s.*")
    first = first.join(first.groupBy("grp").agg(tiles.alias("tiles")), "grp").withColumn("a", tile)
    found = found.unionAll(cut_lineage(_links(first.select("grp", "a", F.col("a").alias("b"), "node").join(shipped, "node"))))
    large = clusters(large)
    # Members outside the largest cluster meet every tile; tiles of such members are made of them alone.
    count = large.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("grp").agg(F.max(F.struct("c", F.col("cluster").alias("main"))).alias("s")).select("grp", "s.main")
    large = large.join(main, "grp")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    outside = large.where("cluster <> main")
    with_tile = outside.select("grp", F.col("tile").alias("a"), every.alias("b"), "node")
    with_outside = large.select("grp", every.alias("a"), F.col("tile").alias("b"), "node").join(
        outside.select("grp", F.col("tile").alias("a")).distinct(), ["grp", "a"], "left_semi")
    cross = with_tile.unionAll(with_outside.select("grp", "a", "b", "node")).distinct()
    return found.unionAll(cut_lineage(_links(cross.join(shipped, "node"))))


# --- documents --------------------------------------------------------------------------

def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile_sets: int = TILE_SETS,
             tile_shingles: int = TILE_SHINGLES, bucket: int = BUCKET) -> DataFrame:
    """``docs`` without the near copies of an earlier row.

    Words are what stands between ASCII white space, A-Z lower-cased; two rows are linked
    if the sets of their five-word shingles share 0.8 of the union at least. A text of fewer words is one shingle; rows
    without words, null and empty ones too, are copies of each other. Of each group over such links the row with the smallest
    doc_id stays: null doc_ids come after all others, among equal doc_ids the text with the smaller hash comes first, and of
    rows that repeat both one is kept. All columns are returned, whatever their names; an empty table stays empty.
    """
    text_hash = F.xxhash64(text)
    slim = map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash.alias("h"), F.col(text).alias("text")),
                    "doc_id long, h long, name binary, n long, fp long, bands array<long>", _describe)
    slim = cut_lineage(slim)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    distinct = (slim.groupBy("name").agg(F.min(rank).alias("rank"), F.first("n").alias("n"), F.first("fp").alias("fp"),
                                         F.first("bands").alias("bands")))
    distinct = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    groups = candidate_groups(distinct, bucket)

    key = [unused(k, docs.columns) for k in ("_id", "_null", "_h")]
    marks = [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias(key[0]), F.col(doc_id).isNull().alias(key[1]), text_hash.alias(key[2])]

    def of(rank: str) -> list:
        return [F.coalesce(f"{rank}.doc_id", F.lit(0)).alias(key[0]), F.col(f"{rank}.last").alias(key[1]), F.col(f"{rank}.h").alias(key[2])]

    # Texts meet their keys in shuffled hash joins at every size: the keys are unique, and texts needn't be sorted.
    wanted = cut_lineage(groups.select("node").distinct().join(distinct.select("node", "rank"), "node").select("node", *of("rank")))
    texts = docs.select(F.col(text).alias("text"), *marks).join(wanted.hint("shuffle_hash"), key).select("node", "text")
    sets = cut_lineage(map_rows(texts, "node long, n long, shingles binary", _sets).dropDuplicates(["node"]))
    roots = components(links(groups, sets, tile_sets, tile_shingles), "u", "v")

    named = distinct.select("node", "name", "rank").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = named.groupBy("root").agg(F.min("rank").alias("stays"))
    named = cut_lineage(named.join(stays, "root").select("name", "stays"))
    # What goes: rows of a set whose first row isn't the one that stays, and of the others all rows but that one.
    gone = slim.join(named, "name").withColumn("own", rank).where(~F.col("own").eqNullSafe(F.col("stays")))
    gone = cut_lineage(gone.select(*of("own")).distinct())
    marked = docs.select("*", *marks)
    kept = marked.join(gone.hint("shuffle_hash"), key, "left_anti")
    if not slim.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(key)
    return kept.drop(*key)


def _sets(b: pa.RecordBatch) -> list[list]:
    sets = [shingles(t) for t in b.column(1).to_pylist()]
    return [b.column(0), [len(s) for s in sets], [s.tobytes() for s in sets]]
