"""Filling fixed-capacity containers: a grouping genetic algorithm on islands.

Items are spread by a hash over shards of bounded size. Every shard lives on several
islands, each with a population of packings of its own. A crossover injects whole
well-filled bins of one parent into another, removes the bins that then hold a duplicate
and puts the displaced items back by best fit; a mutation dissolves the emptiest bins. Between
epochs the best packing of each island migrates to the next one. In the end the items of
badly filled bins of all shards meet in fewer shards and are packed again, level by level, so
that open bins are a vanishing share whatever the number of shards.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.session import cut, forget

SHARD_ITEMS, ISLANDS, EPOCHS = 2000, 4, 3
POPULATION, GENERATIONS = 4, 4
#: Bins filled less than this are opened again on the next level.
CLOSED_FILL = 0.995
BIN_BITS, SHARD_BITS, EMPTY_LEVEL = 20, 36, 126

#: A packing: the items of each bin.
Packing = list[list[int]]


class _Bins:
    """A packing in the making: bins with their room, found by best fit."""

    def __init__(self, sizes: list[int], capacity: int, start: Packing = ()) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items = [list(b) for b in start]
        self.room = [capacity - sum([sizes[i] for i in b]) for b in self.items]
        self.by_room = sorted((r, b) for b, r in enumerate(self.room))

    def place(self, item: int) -> None:
        """Best fit: the bin with the least room that suffices, else a new one."""
        size = self.sizes[item]
        k = bisect.bisect_left(self.by_room, (size, -1))
        if k == len(self.by_room):
            room, b = self.capacity, len(self.items)
            self.items.append([])
            self.room.append(room)
        else:
            room, b = self.by_room.pop(k)
        self.items[b].append(item)
        self.room[b] = room - size
        bisect.insort(self.by_room, (room - size, b))


def fitness(bins: Packing, sizes: list[int], capacity: int) -> float:
    """The mean squared fill of the bins: of equally many bins, those that gather the unused space in few of them are better."""
    return sum((sum([sizes[i] for i in b]) / capacity) ** 2 for b in bins) / max(1, len(bins))


def best_possible(sizes: list[int], capacity: int) -> float:
    """A bound of the fitness: all bins full but for one with the rest."""
    full, rest = divmod(sum(sizes), capacity)
    return (full + (rest / capacity) ** 2) / max(1, full + (rest > 0))


def best_fit(order: list[int], sizes: list[int], capacity: int, start: Packing = ()) -> Packing:
    """The items in the given order by best fit, into the bins of ``start`` or new ones."""
    work = _Bins(sizes, capacity, start)
    for i in order:
        work.place(i)
    return work.items


def decreasing(items: list[int], sizes: list[int]) -> list[int]:
    """Items from the largest to the smallest, ties by number."""
    return sorted(items, key=lambda i: (-sizes[i], i))


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled whole bins of ``a`` go into ``b``; bins of ``b`` that then hold an item twice are removed, their other items are put back by best fit."""
    ranked = sorted(range(len(a)), key=lambda k: (-sum([sizes[i] for i in a[k]]), k))
    pool = ranked[: max(1, len(ranked) * 3 // 4)]
    injected = [a[pool[k]] for k in rng.choice(len(pool), size=max(1, len(pool) // 2), replace=False)]
    inside = bytearray(len(sizes))
    for x in injected:
        for i in x:
            inside[i] = 1
    kept, displaced = [], []
    for x in b:
        if any([inside[i] for i in x]):
            displaced += [i for i in x if not inside[i]]
        else:
            kept.append(x)
    return best_fit(decreasing(displaced, sizes), sizes, capacity, [*injected, *kept])


def mutate(bins: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bins and a few others are dissolved and their items put back."""
    worst = sorted(range(len(bins)), key=lambda k: (sum([sizes[i] for i in bins[k]]), k))[: max(2, len(bins) // 10)]
    gone = set(worst) | set(rng.choice(len(bins), size=min(len(bins), max(2, len(bins) // 20)), replace=False).tolist())
    loose = [i for k in gone for i in bins[k]]
    order = decreasing(loose, sizes) if rng.random() < 0.5 else [loose[k] for k in rng.permutation(len(loose))]
    return best_fit(order, sizes, capacity, [x for k, x in enumerate(bins) if k not in gone])


def evolve(sizes: list[int], capacity: int, seed: int, population: list[Packing] | None = None, immigrant: Packing | None = None, generations: int = GENERATIONS) -> list[Packing]:
    """One epoch on one island: the population after it, the best packing first. It ends early only when the best packing cannot be bettered."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    top = best_possible(sizes, capacity) - 1e-12

    def scored(p: Packing) -> tuple[float, Packing]:
        return fitness(p, sizes, capacity), p

    pop = [scored(p) for p in population or []]
    if not pop:
        pop.append(scored(best_fit(decreasing(list(range(n)), sizes), sizes, capacity)))
        while len(pop) < POPULATION and pop[0][0] < top:
            noise = rng.random(n) * 0.3 + 0.85
            pop.append(scored(best_fit(sorted(range(n), key=lambda i: -sizes[i] * noise[i]), sizes, capacity)))
    if immigrant:
        pop.append(scored(immigrant))
    pop.sort(key=lambda x: -x[0])
    for _ in range(generations):
        if pop[0][0] >= top or len(pop) < 2:
            break
        i, j = sorted(rng.choice(len(pop), size=2, replace=False))
        child = crossover(pop[i][1], pop[j][1], sizes, capacity, rng)
        other = mutate(pop[i][1], sizes, capacity, rng)
        pop = sorted([*pop, scored(child), scored(other)], key=lambda x: -x[0])[:POPULATION]
    return [p for _, p in pop[:POPULATION]]


def _bins_of(assignment: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(assignment):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def _assignment(bins: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _epoch_column(capacity: int, epoch: int, *cols: Column) -> Column:
    """The population after an epoch; columns: sizes, seed[, population, immigrant]."""

    def first(sizes: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([[_assignment(p, len(s)) for p in evolve([int(x) for x in s], capacity, int(k) & 0x7FFFFFFF)] for s, k in zip(sizes, seed)], dtype=object)

    def later(sizes: pd.Series, seed: pd.Series, population: pd.Series, immigrant: pd.Series) -> pd.Series:
        out = []
        for s, k, p, m in zip(sizes, seed, population, immigrant):
            pop = evolve([int(x) for x in s], capacity, (int(k) + epoch) & 0x7FFFFFFF, [_bins_of(x) for x in p], _bins_of(m))
            out.append([_assignment(x, len(s)) for x in pop])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(first if len(cols) == 2 else later, "array<array<int>>")(*cols)


@arrow_udf("double")
def _fitness_udf(sizes: pd.Series, assignment: pd.Series, capacity: pd.Series) -> pd.Series:
    return pd.Series([fitness(_bins_of(a), [int(x) for x in s], int(c)) for s, a, c in zip(sizes, assignment, capacity)], dtype="float64")


def _pack_level(items: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """``id, part, size, bin``: the items packed within their shards."""
    shard = F.pmod(F.xxhash64("id", "part", F.lit(level)), F.lit(shards)).alias("shard")
    # A shard holds about SHARD_ITEMS items whatever the data, because its number is a hash of unique ids.
    state = items.select(shard, F.struct("id", "part", "size").alias("x")).groupBy("shard").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).repartition(min(4096, shards * ISLANDS), "shard", "island")
    sizes, seed = F.col("xs.size"), F.xxhash64("shard", "island", F.lit(level))
    state = cut(state.withColumn("pop", _epoch_column(capacity, 0, sizes, seed)))
    for epoch in range(1, EPOCHS):
        # The best packing of each island goes to the next one.
        movers = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("pop")[0].alias("immigrant"))
        met = state.join(movers, ["shard", "island"]).repartition(min(4096, shards * ISLANDS), "shard", "island")
        before, state = state, cut(met.withColumn("pop", _epoch_column(capacity, epoch, sizes, seed, F.col("pop"), F.col("immigrant"))).drop("immigrant"))
        forget(before)
    scored = state.select("shard", "island", "xs", F.col("pop")[0].alias("a"), _fitness_udf(sizes, F.col("pop")[0], F.lit(capacity)).alias("f"))
    best = scored.groupBy("shard").agg(F.max_by(F.struct("xs", "a"), F.struct("f", -F.col("island"))).alias("b"))
    rows = best.select("shard", F.explode(F.arrays_zip(F.col("b.xs").alias("x"), F.col("b.a").alias("k"))).alias("r"))
    number = F.shiftleft(F.lit(level).cast("long"), BIN_BITS + SHARD_BITS) + F.shiftleft(F.col("shard").cast("long"), BIN_BITS) + F.col("r.k")
    return rows.select("r.x.id", "r.x.part", "r.x.size", number.alias("bin"))


def pack(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """``key, part, size, container``: every item in a container of ``capacity``.

    An item larger than the capacity, and only such an item, is split into parts: full
    containers and a rest (part 0, 1, ...). Items of size 0 or null take no room and are spread over
    containers of their own kind of hash. No container is ever overfull. Keys must be unique; equal sizes are
    told apart by key, so the result is the same on every run. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = items.select(F.col(key).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    parts = base.select("id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int"))).alias("part"))
    # The table is written once, so the number of a row is unique and stays; full parts are containers of that number.
    parts = cut(parts.select("id", "part", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("long").alias("size"), F.monotonically_increasing_id().alias("no")))
    n_open, n_empty = (r or 0 for r in parts.agg(F.count_if((F.col("size") > 0) & (F.col("size") < capacity)), F.count_if(F.col("size") == 0)).first())
    done = [parts.filter(F.col("size") == capacity).select("id", "part", "size", (-1 - F.col("no")).alias("bin"))]
    rest, level = parts.filter((F.col("size") > 0) & (F.col("size") < capacity)).drop("no"), 0
    while n_open:
        shards = max(1, -(-n_open // SHARD_ITEMS))
        packed = cut(_pack_level(rest, capacity, shards, level))
        fill = packed.groupBy("bin").agg(F.sum("size").alias("used"))
        open_bins = fill.filter(F.col("used") < CLOSED_FILL * capacity).select("bin")
        again = cut(packed.join(open_bins, "bin").select("id", "part", "size")) if shards > 1 else None
        # Open bins meet in fewer shards, until one shard holds them all or packing them again closes none.
        if again is None or level + 1 == EMPTY_LEVEL or (left := again.count()) >= n_open:
            done.append(packed)
            break
        done.append(packed.join(open_bins, "bin", "left_anti"))
        rest, n_open, level = again, left, level + 1
    if n_empty:
        groups = max(1, -(-n_empty // 1000))
        mark = F.shiftleft(F.lit(EMPTY_LEVEL).cast("long"), BIN_BITS + SHARD_BITS)
        done.append(parts.filter(F.col("size") == 0).select("id", "part", "size", (mark + F.pmod(F.xxhash64("id"), F.lit(groups))).alias("bin")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(key), "part", "size", F.col("bin").alias("container"))
