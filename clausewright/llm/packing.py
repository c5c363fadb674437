"""Filling fixed-capacity containers with texts.

Method: grouping genetic algorithm.  An individual is a set of bins;
crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold one of their items a second time, and places the
displaced items by best fit, largest first.  Items are spread by hash over
shards of about `shard_items`; every shard is evolved on several islands, and
after each epoch the best individual of an island migrates to the next one.
The best individual of all islands of a shard is its placement.

An item is a text, or, for a text over the capacity, one of its pieces: full
containers and a rest.  Defined results: texts without tokens are not placed;
repeated rows are one text; equal sizes are told apart by id; a capacity under
one is refused.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.session import cut


class Packing:
    """Bins of item numbers, for given sizes and capacity."""

    def __init__(self, sizes: list[int], capacity: int, bins: Iterable[list[int]]) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in self.bins]

    def fitness(self) -> float:
        """Mean of the squared fill rates: few and full bins."""
        return sum((f / self.capacity) ** 2 for f in self.fill) / max(1, len(self.fill))

    def place(self, items: Iterable[int]) -> Packing:
        """Best fit: each item into the bin that it leaves the least room in."""
        free = sorted((self.capacity - f, b) for b, f in enumerate(self.fill))
        for i in items:
            s = self.sizes[i]
            at = bisect.bisect_left(free, (s, -1))
            if at == len(free):
                self.bins.append([i])
                self.fill.append(s)
                bisect.insort(free, (self.capacity - s, len(self.bins) - 1))
            else:
                room, b = free.pop(at)
                self.bins[b].append(i)
                self.fill[b] += s
                bisect.insort(free, (room - s, b))
        return self


def _crossover(a: Packing, b: Packing, r: random.Random) -> Packing:
    """Whole well-filled bins of b enter a; bins of a that share an item with them give way."""
    full = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    n = r.randint(1, max(1, len(full) // 2))
    first = r.randint(0, max(0, len(full) // 2 - n))
    chosen = [b.bins[k] for k in full[first : first + n]]
    injected = {i for g in chosen for i in g}
    kept = [g for g in a.bins if not any(i in injected for i in g)]
    there = injected | {i for g in kept for i in g}
    child = Packing(a.sizes, a.capacity, [*chosen, *kept])
    return child.place(sorted((i for i in range(len(a.sizes)) if i not in there), key=lambda i: (-a.sizes[i], i)))


def _mutate(p: Packing, r: random.Random) -> Packing:
    """Some of the worst-filled bins and a few others are opened and their items placed again."""
    order = sorted(range(len(p.bins)), key=lambda k: p.fill[k])
    out = set(order[: max(1, len(order) // 50)]) | {r.randrange(len(order)) for _ in range(2)}
    loose = [i for k in out for i in p.bins[k]]
    if r.random() < 0.5:
        loose.sort(key=lambda i: (-p.sizes[i], i))
    else:
        r.shuffle(loose)
    return Packing(p.sizes, p.capacity, [b for k, b in enumerate(p.bins) if k not in out]).place(loose)


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], seed: int, size: int = 6, generations: int = 8) -> list[Packing]:
    """The individuals of an island after some generations, best first; starts from best fit where none are given."""
    r = random.Random(seed)
    pop = [Packing(sizes, capacity, b) for b in population]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    while len(pop) < size:
        noisy = order if not pop else sorted(order, key=lambda i: -sizes[i] * r.uniform(0.7, 1.3))
        pop.append(Packing(sizes, capacity, []).place(noisy))
    least = -(-sum(sizes) // capacity)
    for _ in range(generations):
        pop.sort(key=lambda p: -p.fitness())
        if len(pop[0].bins) <= least:
            break
        pop = pop[:size]
        young = []
        for _ in range(size):
            a, b = (max(r.sample(pop, min(2, len(pop))), key=Packing.fitness) for _ in range(2))
            child = _crossover(a, b, r)
            young.append(_mutate(child, r) if r.random() < 0.6 else child)
        pop += young
    return sorted(pop, key=lambda p: (len(p.bins), -p.fitness()))[:size]


_STATE = "shard long, island int, id long, piece int, size long, genes array<int>, bins int"


def _bins(genes: Iterable[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, g in enumerate(genes):
        out.setdefault(int(g), []).append(i)
    return list(out.values())


def pack(items: DataFrame, capacity: int, shard_items: int = 2000, islands: int = 3, epochs: int = 2, seed: int = 3) -> DataFrame:
    """(id, piece, size, container) of items (id, size): no container over capacity, no item split unless it exceeds it."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.col("size")
    whole = (n / capacity).cast("long")
    pieces = items.where(n > 0).dropDuplicates(["id"]).select("id", n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(n % capacity == 0, whole - 1).otherwise(whole))).alias("piece"))
    pieces = cut(pieces.select("id", F.col("piece").cast("int"), F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("piece") * capacity).alias("size")), "items")
    full = pieces.where(F.col("size") == capacity).select("id", "piece", "size", F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"))
    open_ = pieces.where(F.col("size") < capacity)
    shards = max(1, -(-open_.count() // shard_items))
    start = open_.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))

    def epoch(number: int):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            g = g.sort_values(["id", "piece"], kind="stable")
            first = ~g.duplicated(["id", "piece"])
            items_ = g[first].reset_index(drop=True)
            population = []
            for origin in g["bins"].unique() if number else []:
                rows = g[g["bins"] == origin]
                table = np.array(rows["genes"].tolist())
                population += [_bins(table[:, c]) for c in range(table.shape[1])]
            pop = evolve(items_["size"].tolist(), capacity, population, seed * 1_000_003 + shard * 97 + island * 7 + number)
            genes = np.zeros((len(items_), len(pop)), dtype=np.int32)
            for c, p in enumerate(pop):
                for k, b in enumerate(p.bins):
                    genes[b, c] = k
            base = items_[["id", "piece", "size"]].assign(shard=shard)
            own = base.assign(island=island, genes=list(genes), bins=-len(pop[0].bins))
            elite = base.assign(island=(island + 1) % islands, genes=list(genes[:, :1]), bins=len(pop[0].bins))
            cols = ["shard", "island", "id", "piece", "size", "genes", "bins"]
            return pd.concat([own, elite] if islands > 1 else [own])[cols]

        return run

    state = start.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "id", "piece", "size", F.lit(None).cast("array<int>").alias("genes"), F.lit(0).alias("bins"))
    for e in range(epochs):
        state = cut(state.groupBy("shard", "island").applyInPandas(epoch(e), _STATE), f"islands-{e}")
    own = state.where("bins < 0")
    best = own.groupBy("shard").agg(F.max_by("island", F.struct("bins", -F.col("island"))).alias("island"))
    placed = own.join(best, ["shard", "island"]).select("id", "piece", "size", F.concat_ws("-", F.lit("s"), "shard", F.col("genes")[0]).alias("container"))
    return placed.unionByName(full)
