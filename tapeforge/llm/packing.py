"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most one sequence. Only the lengths are packed.
Pieces are dealt into shards of bounded size by a hash, and every shard is evolved on
several islands, each a row of its own that another task may work on. An individual is
a list of bins. Crossover injects whole well-filled bins of one parent into the other,
takes out the bins that now hold a document twice, and best-fits the documents that
lost their place. After each epoch the best individual of every island moves on to the
next. Bins that stay poorly filled are dissolved, and their pieces, a small share of
all, are packed again together.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tapeforge.llm.common import map_rows
from tapeforge.llm.tokens import encoder
from tapeforge.session import cut_lineage

CAPACITY = 4096
SHARD = 4000                     # pieces that are evolved together, on average
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 6, 4
FEW = 8                          # items of a bin up to which pairs are swapped
LOOSE = 0.97                     # bins filled less are dissolved and their pieces packed again
Bins = list[list[int]]


# --- pieces -------------------------------------------------------------------------

def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' ids with ``end_id`` after each, cut only where
    longer than ``capacity``. A null or empty text is the end id alone; repeated rows each get their pieces."""

    def run(b: pa.RecordBatch) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        end = end_id.to_bytes(4, "little")
        encoded = encoder(tokenizer, False).encode_batch(b.column(1).to_pylist())
        for doc, ids in zip(b.column(0).to_pylist(), encoded):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                for c, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    c.append(v)
        return out

    return map_rows(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", run)


# --- one island -----------------------------------------------------------------------

def best_fit(bins: Bins, items: list[int], size: list[int], capacity: int) -> Bins:
    """Put each item, in the order given, where it leaves the least room; ``bins`` is changed and returned."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for b, held in enumerate(bins):
        r = capacity - sum(map(size.__getitem__, held))
        room[r].append(b)
        mask |= 1 << r
    for i in items:
        s = size[i]
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= s
        room[r].append(b)
        mask |= 1 << r
    return bins


def lower_bound(size: list[int], capacity: int) -> int:
    """Fewer bins can't hold the items (Martello and Toth): for each small size k, items that exclude each other by
    needing over half a bin or all but k of one, and the room that those leave."""
    s = np.sort(np.array(size, np.int64))
    total = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity / 2, "right")  # from here on larger than half a bin
    k = np.unique(np.r_[0, s[:half]])
    alone = np.searchsorted(s, capacity - k, "right")  # from here on no item of size k fits beside them
    alone = np.maximum(alone, half)
    small = np.searchsorted(s, k, "left")
    middle = total[alone] - total[half]
    spare = (alone - half) * capacity - middle
    more = np.maximum(0, -(-(total[half] - total[np.minimum(small, half)] - spare) // capacity))
    return int(max((len(s) - alone + (alone - half) + more).max(), -(-total[-1] // capacity))) if len(s) else 0


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how unevenly they are filled (full ones first)."""
    return len(bins), -sum((sum(map(size.__getitem__, b)) / capacity) ** 2 for b in bins)


def improve(bins: Bins, loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Swap one or two items of a bin with room for one or two loose ones that fill it better; the loose items that are left.

    A loose item as large as a pair that it replaces leaves smaller items behind, which are easier to place. Pairs are
    taken out of bins of a few items only, where they matter.
    """
    by_size: dict[int, list[int]] = {}
    for i in loose:
        by_size.setdefault(size[i], []).append(i)
    sizes = sorted(by_size)

    def give(i: int) -> None:
        if size[i] not in by_size:
            insort(sizes, size[i])
        by_size.setdefault(size[i], []).append(i)

    def take(s: int) -> int:
        i = by_size[s].pop()
        if not by_size[s]:
            del by_size[s]
            del sizes[bisect_left(sizes, s)]
        return i

    for held in bins:
        room = capacity - sum(map(size.__getitem__, held))
        if not room:
            continue
        if not sizes:
            break
        best: tuple | None = None  # (gain, out, in)
        for out in [(i,) for i in held] + (list(combinations(held, 2)) if len(held) <= FEW else []):
            gone = sum(map(size.__getitem__, out))
            most = gone + room
            k = bisect_right(sizes, most) - 1
            if k >= 0 and sizes[k] > gone and (best is None or sizes[k] - gone > best[0]):
                best = (sizes[k] - gone, out, (sizes[k],))
            lo, hi = 0, len(sizes) - 1  # two loose items, from both ends
            while len(held) <= FEW and lo <= hi and (best is None or best[0] < room):
                pair = sizes[lo] + sizes[hi]
                if pair > most:
                    hi -= 1
                    continue
                if pair > gone and (lo < hi or len(by_size[sizes[lo]]) > 1) and (best is None or pair - gone > best[0]):
                    best = (pair - gone, out, (sizes[lo], sizes[hi]))
                lo += 1
            if best and best[0] == room:
                break
        if best:
            _, out, sizes_in = best
            held[:] = [i for i in held if i not in out] + [take(s) for s in sizes_in]
            for i in out:
                give(i)
    return [i for s in reversed(sizes) for i in sorted(by_size[s])]


def _placed(bins: Bins, loose: list[int], size: list[int], capacity: int) -> Bins:
    loose = improve(bins, loose, size, capacity)
    return best_fit(bins, sorted(loose, key=lambda i: (-size[i], i)), size, capacity)


def crossover(into: Bins, source: Bins, size: list[int], capacity: int, rnd: random.Random) -> Bins:
    """Whole bins of ``source``, the better filled the likelier, go into a copy of ``into``; the bins that now hold a
    document twice are taken out, and their other documents are placed anew."""
    fill = sorted(source, key=lambda b: (-sum(map(size.__getitem__, b)), len(b)))
    chosen = [b for b in fill[:max(1, len(fill) // 2)] if rnd.random() < 0.5]
    taken = {i for b in chosen for i in b}
    kept, displaced = [list(b) for b in chosen], []
    for b in into:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return _placed(kept, displaced, size, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, rnd: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and place their items anew."""
    order = sorted(range(len(bins)), key=lambda b: sum(map(size.__getitem__, bins[b])))
    gone = set(order[:max(1, len(bins) // 50)]) | {b for b in order if rnd.random() < 0.02}
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    return _placed(kept, [i for k in sorted(gone) for i in bins[k]], size, capacity)


def evolve(population: list[Bins], size: list[int], capacity: int, seed: int, generations: int = GENERATIONS) -> list[Bins]:
    """An epoch of an island, best individual first. It ends early only where the best can't be bettered.

    An island starts from documents in random orders placed by best fit, and one by falling size."""
    rnd = random.Random(seed)
    order = sorted(range(len(size)), key=lambda i: (-size[i], i))
    bound = lower_bound(size, capacity)
    while len(population) < POPULATION:
        noise = 0.0 if not population else 0.3  # the first is best fit by falling size
        some = sorted(order, key=lambda i: -size[i] * (1 + noise * rnd.random())) if noise else order
        population.append(best_fit([], some, size, capacity))
        if len(population[0]) <= bound:
            break
    ranked = sorted(population, key=lambda p: fitness(p, size, capacity))
    for _ in range(generations):
        if len(ranked[0]) <= bound:
            break  # as few as there can be
        a, b = sorted(rnd.sample(range(len(ranked)), 2))
        children = [crossover(ranked[x], ranked[y], size, capacity, rnd) for x, y in ((a, b), (b, a))]
        children.append(mutate(ranked[0], size, capacity, rnd))
        unlike = {fitness(p, size, capacity): p for p in [*ranked, *children]}  # equally good ones crowd an island
        ranked = [unlike[f] for f in sorted(unlike)][:POPULATION]
        while len(ranked) < 2:
            ranked.append(mutate(ranked[0], size, capacity, rnd))
    return ranked


def _flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _grouped(flat: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        bins[k].append(i)
    return bins


STATE = "shard long, island int, size array<int>, population array<array<int>>"


def _epoch(rows: Iterator[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    """Evolve the island of each row; a guest replaces the worst individual."""
    for b in rows:
        out: list[list] = [[], [], [], []]
        for r in b.to_pylist():
            population = [_grouped(p) for p in r["population"] or []]
            if r.get("guest"):
                population = [*population[:POPULATION - 1], _grouped(r["guest"])]
            seed = (r["shard"] * ISLANDS + r["island"]) * EPOCHS + epoch
            best = evolve(population, r["size"], capacity, seed)
            for c, v in zip(out, (r["shard"], r["island"], r["size"], [_flat(p, len(r["size"])) for p in best])):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            out, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))))],
            ["shard", "island", "size", "population"])


ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _pack_shards(sharded: DataFrame, shards: int, capacity: int) -> DataFrame:
    """The rows of ``sharded`` with the number of their bin within the shard."""
    sizes = (sharded.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*ORDER))).alias("s"))
             .select("shard", F.col("s.length").cast("array<int>").alias("size")))  # SHARD pieces on average
    state = sizes.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "size",
                         F.lit(None).cast("array<array<int>>").alias("population"))
    # Few bytes and much work: a fixed number of tasks, which Spark doesn't merge for their small size.
    tasks = max(1, min(shards * ISLANDS, max(64, shards * ISLANDS // 8)))
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"),
                                 F.col("population")[0].alias("guest"))
            state = state.join(elite, ["shard", "island"])
        state = state.repartition(tasks, "shard", "island")
        state = cut_lineage(state.mapInArrow(lambda rows, e=epoch: _epoch(rows, capacity, e), STATE))
    best = (state.select("shard", F.struct(F.array_max(F.col("population")[0]).alias("bins"), "island",
                                           F.col("population")[0].alias("bin")).alias("best"))
            .groupBy("shard").agg(F.min("best").alias("best")).select("shard", F.col("best.bin").alias("bin")))

    def placed(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"bin": []})
        rows = rows.sort_values(ORDER, na_position="first", kind="stable")
        rows["bin"] = list(of["bin"].iloc[0])
        return rows

    schema = ", ".join(f"{n} {t}" for n, t in sharded.dtypes) + ", bin long"
    return sharded.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(placed, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``parts`` with (sequence_id, offset): every row has a place, offsets run without gaps from 0.

    ``parts`` has the columns of ``pieces``; lengths are at most ``capacity``. Ties and
    repeated rows are interchangeable. An empty table gives an empty result.
    """
    # Rows are numbered as they are written, so that repeated rows are dealt like any others.
    left, out, level = cut_lineage(parts.withColumn("_row", F.monotonically_increasing_id())), None, 0
    n = left.count()
    while n or out is None:
        shards = max(1, -(-n // shard))
        # the number in the hash deals the pieces anew at every level
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "_row"), F.lit(shards)))
        full = F.col("length") == capacity
        packed = cut_lineage(_pack_shards(dealt.where(~full), shards, capacity))
        good = (packed.groupBy("shard", "bin").agg(F.sum("length").alias("_fill"))
                .where(F.col("_fill") >= LOOSE * capacity).select("shard", "bin"))
        loose = packed.join(good, ["shard", "bin"], "left_anti")
        again = loose.count() if shards > 1 else 0
        if 2 * again > n:
            again = 0  # lengths that don't fill bins: another deal wouldn't either
        done = packed.join(good, ["shard", "bin"], "left_semi") if again else packed
        place = F.lit(level << 48) + F.col("shard") * (1 << 20) + F.col("bin")
        done = done.withColumn("sequence_id", place).drop("bin")
        whole = dealt.where(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
        done = done.unionByName(whole).drop("shard")
        out = done if out is None else out.unionByName(done)
        if again:
            left = cut_lineage(loose.drop("shard", "bin"))
        n, level = again, level + 1
    before = (Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "ids_crc32", "_row")
              .rowsBetween(Window.unboundedPreceding, -1))  # a sequence has at most `capacity` rows
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_row")
