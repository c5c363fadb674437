"""Near-duplicate records with small edits.

Method: MinHash LSH forest.  Every tree labels a value with `depth` levels,
each a minimum of its shingles folded to nine bits, packed in order into one
number, so that sorting the numbers of a tree gives its trie: a node at level k
is a run of numbers with the same first k labels.  One sorted pass goes down
the tries of all trees to the floor, the longest prefix whose recall expected
at the threshold itself reaches `floor_recall`, and notes for every pair the
longest prefix it shares in any tree.  The matched prefix is then shortened
level by level from full depth until the recall measured on all pairs found
(each weighed by how likely a pair of its similarity is found at that level)
reaches `target_recall`, at most to the floor.  Pairs that remain are verified
exactly on the texts.

A 64-bit sketch per field (one bit per minimum) stands beside each number.
Pairs whose sketches differ too much are left out at once; pairs that share no
more than the floor must look more alike than deeper ones.  The recall given
by the formulas counts what the sketches lose.

Rows with equal values in all fields are one content; only contents are
compared, and the copies come back by membership, so a group of copies of any
size costs one comparison.  Nodes at the floor with more than `hot` contents
leave the sorted pass as they stream by, without being gathered; they are cut
into blocks of about `hot` contents, and every pair of blocks is compared in
its own group with the same sketches.  No pair is dropped for skew.

Defined results: values with fewer words than a shingle are similar to none;
null counts as empty; the similarity of two rows is the greatest over the
fields; ids that are null are left out; repeated rows count once.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.session import cut, join_checked, rows_up_to

_WORDS = re.compile(r"[^\W_]+")
_ASCII_WORDS = re.compile(r"[a-z0-9]+")
#: Bits of a level's label, and of the sketch of a field.
LABEL, SKETCH = 9, 64


def split_words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    t = (text or "").lower()
    return (_ASCII_WORDS if t.isascii() else _WORDS).findall(t)


def shingle_set(text: str | None, width: int) -> frozenset:
    """The sets of consecutive words that similarity is defined on."""
    w = split_words(text)
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    """Size of the intersection by size of the union, 0 for empty sets."""
    n = len(a & b)
    return n / (len(a) + len(b) - n) if n else 0.0


def similarities(a: list[str | None], b: list[str | None], width: int) -> np.ndarray:
    """jaccard of the shingle sets of a[i] and b[i], exactly, for many pairs at once.

    Words and shingles are numbered, so that sets are runs of sorted numbers;
    shingles are numbered anew where products of the numbers grow too large.
    """
    texts: dict[str, int] = {}
    x, y = (np.fromiter((texts.setdefault(t or "", len(texts)) for t in side), dtype=np.int64, count=len(side)) for side in (a, b))
    words: dict[str, int] = {}
    ids = [[words.setdefault(w, len(words)) for w in split_words(t)] for t in texts]
    sizes = np.array([max(0, len(i) - width + 1) for i in ids])
    if not sizes.sum():
        return np.zeros(len(a))
    lengths = np.array([len(i) for i in ids])
    flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=int(lengths.sum()))
    first = np.repeat(np.cumsum(lengths) - lengths, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shingle, span = flat[first], len(words)
    for i in range(1, width):
        if span * len(words) * len(texts) >= 2**62:
            shingle, span = np.unique(shingle, return_inverse=True)[1], len(shingle)
        shingle, span = shingle * len(words) + flat[first + i], span * len(words)
    if span * len(texts) >= 2**62:
        shingle, span = np.unique(shingle, return_inverse=True)[1], len(shingle)
    keys = np.sort(np.repeat(np.arange(len(texts)), sizes) * span + shingle)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    begin = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    n = np.diff(begin)
    pair = np.repeat(np.arange(len(a)), n[x])
    at = np.repeat(begin[x] - np.cumsum(n[x]) + n[x], n[x]) + np.arange(n[x].sum())
    wanted = keys[at] + (y - x)[pair] * span
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    common = np.bincount(pair, weights=keys[place] == wanted, minlength=len(a))
    return common / np.maximum(n[x] + n[y] - common, 1)


class Forest:
    """Shape of the forest and the expected recall of its prefixes.

    slack: by how many standard deviations the sketches of a pair may differ
    more than those of a pair at the threshold do on average, for pairs that
    share more levels than the floor and for those that share no more.
    """

    def __init__(self, threshold: float, trees: int = 24, depth: int = 6, floor_recall: float = 0.9, slack: tuple[float, float] = (1.75, 1.0)) -> None:
        if trees > 32 or depth * LABEL > 58:
            raise ValueError("a tree and its labels must fit into 63 bits")
        self.threshold, self.trees, self.depth = threshold, trees, depth
        differ = SKETCH * (1 - threshold) / 2
        self.deep, self.shallow = (int(differ + z * (differ * (1 + threshold) / 2) ** 0.5) for z in slack)
        self.floor = next((k for k in range(depth, 1, -1) if self.recall(threshold, k, k) >= floor_recall), 1)

    @property
    def functions(self) -> int:
        """Number of minima."""
        return max(self.trees * self.depth, SKETCH)

    def _passes(self, s: float, most: int) -> float:
        p = (1 - s) / 2
        return sum(math.comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d) for d in range(most + 1))

    def recall(self, s: float, level: int, floor: int | None = None) -> float:
        """Expected share of the pairs of similarity s that are found by prefixes of at least `level` labels."""
        floor = self.floor if floor is None else floor
        shares = lambda k: 1 - (1 - s**k) ** self.trees
        deep = shares(max(level, floor + 1)) * self._passes(s, self.deep)
        return deep if level > floor else deep + (shares(floor) - shares(floor + 1)) * self._passes(s, self.shallow)


def _parameters(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


class _Ids(dict):
    """Word to a 64-bit number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


_IDS = _Ids()


def minima(texts: list[str | None], width: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have shingles, their mixed minima by function)."""
    ids = [list(map(_IDS.__getitem__, split_words(t))) if t else [] for t in texts]
    have = np.array([k for k, w in enumerate(ids) if len(w) >= width], dtype=np.int64)
    if not len(have):
        return have, np.zeros((0, functions), dtype=np.uint32)
    sizes = np.array([len(ids[k]) for k in have])
    flat = np.fromiter(itertools.chain.from_iterable(ids[k] for k in have), dtype=np.uint64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    h = flat.copy()
    for i in range(1, width):
        h[: len(h) - i] = h[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15) + flat[i:]
    inside = np.ones(len(h), dtype=bool)
    for i in range(1, width):
        inside[ends - i] = False
    h = h[inside]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    short = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes - width + 1)[:-1]])
    a, b = _parameters(functions)
    out = np.empty((functions, len(have)), dtype=np.uint32)
    mixed = np.empty_like(short)
    for j in range(functions):
        np.bitwise_xor(short, b[j], out=mixed)
        np.multiply(mixed, a[j], out=mixed)
        out[j] = np.minimum.reduceat(mixed, starts)
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return have, out.T


def contents(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rid, fields...) one row per content, and (rid, key) its members.

    rid is a 64-bit hash; should two contents of the data have the same, all are hashed anew.
    """
    value = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    base = df.where(F.col(key).isNotNull()).select(key, *fields)
    for seed in itertools.count():
        rid = F.xxhash64(F.lit(seed), *value)
        same = F.md5(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(value)])))
        docs = base.groupBy(rid.alias("rid")).agg(*[F.first(f).alias(f) for f in fields], (F.min(same) != F.max(same)).alias("__clash"))
        docs = cut(docs, "contents")
        if not rows_up_to(docs.where("__clash"), 0):
            return docs.drop("__clash"), base.select(rid.alias("rid"), key).distinct()


def _sketches(m: np.ndarray) -> np.ndarray:
    bits = ((m[:, :SKETCH] >> np.uint32(3)) & np.uint32(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)[:, 0]


def _labels(m: np.ndarray, forest: Forest) -> np.ndarray:
    """(texts, trees) of the packed labels, the tree's number on top."""
    key = np.broadcast_to(np.arange(forest.trees, dtype=np.int64), (len(m), forest.trees)).copy()
    for j in range(forest.depth):
        key <<= LABEL
        key |= (m[:, j :: forest.depth][:, : forest.trees] >> np.uint32(32 - LABEL)).astype(np.int64)
    return key


def _signatures(docs: DataFrame, fields: list[str], width: int, forest: Forest) -> DataFrame:
    """(key, rid, s0, s1...): one row per content and tree, for fields that part above the floor one each."""
    names = [f"s{f}" for f in range(len(fields))]
    same = LABEL * (forest.depth - min(forest.depth, forest.floor + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            sketch = np.zeros((len(fields), n), dtype=np.uint64)
            found, at, earlier = [], [], []
            for f, name in enumerate(fields):
                have, m = minima(b.column(name).to_pylist(), width, forest.functions)
                if not len(have):
                    continue
                sketch[f, have] = _sketches(m) | np.uint64(1)  # never 0, which means no value
                key = _labels(m, forest)
                fresh = np.ones(key.shape, dtype=bool)
                node = key >> same
                for old in earlier:
                    fresh &= old[have] != node
                mine = np.full((n, forest.trees), -1, dtype=np.int64)
                mine[have] = node
                earlier.append(mine)
                found.append(key[fresh])
                at.append(np.broadcast_to(have[:, None], key.shape)[fresh])
            if found:
                row = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(rid[row]), *(pa.array(s[row].view(np.int64)) for s in sketch)], names=["key", "rid", *names])

    return docs.mapInArrow(run, "key long, rid long, " + ", ".join(f"{n} long" for n in names))


def _differ(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """By how many bits the sketches differ in the field where they differ least."""
    best = np.full(len(x[0]), SKETCH, dtype=np.int64)
    for a, b in zip(x, y, strict=True):
        best = np.minimum(best, np.where((a != 0) & (b != 0), np.bitwise_count(a ^ b), SKETCH))
    return best


class _Pairs:
    """Compares rows of one node; gives (a, b, level, differ) of the pairs that pass."""

    def __init__(self, key: np.ndarray, rid: np.ndarray, sketches: list[np.ndarray], forest: Forest) -> None:
        self.key, self.rid, self.sketches, self.forest = key, rid, sketches, forest
        self.out: list[tuple] = []

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        f = self.forest
        d = _differ([s[i] for s in self.sketches], [s[j] for s in self.sketches])
        near = np.flatnonzero((d <= f.deep) & (self.rid[i] != self.rid[j]))
        i, j, d = i[near], j[near], d[near]
        apart = self.key[i] ^ self.key[j]
        level = np.full(len(i), f.floor, dtype=np.int32)
        for k in range(f.floor + 1, f.depth + 1):
            level += (apart >> LABEL * (f.depth - k)) == 0
        ok = (level > f.floor) | (d <= f.shallow)
        a, b = self.rid[i[ok]], self.rid[j[ok]]
        if len(a):
            self.out.append((np.minimum(a, b), np.maximum(a, b), level[ok], d[ok].astype(np.int32)))

    def batch(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.out, strict=True)], names=["a", "b", "level", "differ"])


def _columns(b: pa.RecordBatch | pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    get = lambda n: np.asarray(b.column(n))
    return get("key"), get("rid"), [get(n).view(np.uint64) for n in names]


def _by_run(batches: Iterator[pa.RecordBatch], run: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no run of the column is parted."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        at = np.asarray(t.column(run))
        last = int(np.searchsorted(at, at[-1], side="left"))
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None:
        yield rest


def candidate_pairs(docs: DataFrame, fields: list[str], width: int, forest: Forest, hot: int = 512) -> DataFrame:
    """(a, b, level, differ): contents that share a prefix down to the floor in some tree and pass the sketches, a < b.

    level: the longest prefix they share in any tree; differ: bits in which their sketches differ.
    """
    spark = docs.sparkSession
    names = [f"s{f}" for f in range(len(fields))]
    sketch_columns = ", ".join(f"{n} long" for n in names)
    shift = LABEL * (forest.depth - forest.floor)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() * forest.trees / 2_000_000))
    signatures = _signatures(docs, fields, width, forest).repartition(tasks, F.shiftright("key", shift)).sortWithinPartitions("key")
    nothing = lambda n: pa.array(np.zeros(n, dtype=np.int64))

    def sorted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        streaming = None  # the node over the bound that goes by

        def hot_rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in t.combine_chunks().to_batches():
                zero = pa.array(np.zeros(part.num_rows, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("rid"), nothing(part.num_rows), zero, zero, part.column("key"), *(part.column(c) for c in names)], names=["a", "b", "level", "differ", "key", *names])

        def closed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, rid, sk = _columns(t, names)
            node = key >> shift
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            length = np.diff(np.append(starts, len(node)))
            large = length > hot
            for s, n in zip(starts[large].tolist(), length[large].tolist(), strict=True):
                yield from hot_rows(t.slice(s, n))
            found = _Pairs(key, rid, sk, forest)
            starts, length = starts[~large], length[~large]
            for step in range(1, int(length.max(initial=1))):  # pairs at this distance within a node
                of = length > step
                starts, length = starts[of], length[of]
                n = length - step
                first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                found.compare(first, first + step)
            if (b := found.batch()) is not None:
                zero = nothing(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, zero, *(zero for _ in names)], names=["a", "b", "level", "differ", "key", *names])

        for b in batches:
            t = pa.Table.from_batches([b])
            if streaming is not None:
                n = int(np.searchsorted(np.asarray(t.column("key")) >> shift, streaming, side="right"))
                yield from hot_rows(t.slice(0, n))
                t = t.slice(n)
                if not t.num_rows:
                    continue
                streaming = None
            if rest is not None:
                t, rest = pa.concat_tables([rest, t]), None
            if not t.num_rows:
                continue
            node = np.asarray(t.column("key")) >> shift
            last = int(np.searchsorted(node, node[-1], side="left"))
            if len(node) - last > hot:
                streaming, last = node[-1], len(node)
            else:
                rest = t.slice(last)
            yield from closed(t.slice(0, last))
        if rest is not None:
            yield from closed(rest)

    schema = f"a long, b long, level int, differ int, key long, {sketch_columns}"
    found = cut(signatures.mapInArrow(sorted_pass, schema), "forest-pairs")
    pairs = found.where("level > 0").select("a", "b", "level", "differ")
    if rows_up_to(found.where("level = 0"), 0):
        pairs = pairs.unionByName(_hot_pairs(found.where("level = 0").select("key", F.col("a").alias("rid"), *names), names, forest, hot, shift))
    return pairs.groupBy("a", "b").agg(F.max("level").alias("level"), F.min("differ").alias("differ"))


def _hot_pairs(rows: DataFrame, names: list[str], forest: Forest, hot: int, shift: int) -> DataFrame:
    """The pairs within nodes over the bound, one group per pair of blocks."""
    rows = rows.withColumn("node", F.shiftright("key", shift))
    counted = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("blocks"))
    r = join_checked(rows, counted, ["node"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    r = r.select(F.xxhash64("node", "lo", "hi").alias("group"), "node", "lo", "hi", "own", "key", "rid", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_run(batches, "group"):
            key, rid, sk = _columns(t, names)
            node, lo, hi, own = (np.asarray(t.column(c)) for c in ("node", "lo", "hi", "own"))
            cuts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            for s, e in itertools.pairwise([*cuts.tolist(), len(node)]):
                found = _Pairs(key, rid, sk, forest)
                left, right = np.flatnonzero(own[s:e] == lo[s]) + s, np.flatnonzero(own[s:e] == hi[s]) + s
                for n, i in enumerate(left):
                    j = right[n + 1 :] if lo[s] == hi[s] else right
                    found.compare(np.full(len(j), i), j)
                if (b := found.batch()) is not None:
                    yield b

    return r.repartition("group").sortWithinPartitions("group", "node", "lo", "hi").mapInArrow(run, "a long, b long, level int, differ int")


def shortened(pairs: DataFrame, forest: Forest, target_recall: float) -> int:
    """The longest prefix whose recall, measured on all pairs by their sketches, reaches the target; the floor if none does.

    A pair of similarity s stands for 1 / recall(s) pairs of its kind, those not found included.
    """
    kinds = {(r["level"], r["differ"]): r["n"] for r in pairs.groupBy("level", "differ").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(forest.depth, forest.floor, -1):
        n = every = 0.0
        for (level, differ), count in kinds.items():
            s = 1 - 2 * differ / SKETCH
            if level >= k and s >= forest.threshold:
                n += count
                every += count / max(forest.recall(s, k), 1e-9)
        if every and n / every >= target_recall:
            return k
    return forest.floor


def similar_contents(docs: DataFrame, fields: list[str], threshold: float = 0.8, width: int = 5, trees: int = 24, depth: int = 6, target_recall: float = 0.998, hot: int = 512) -> DataFrame:
    """(a, b, similarity): pairs of contents, verified exactly."""
    forest = Forest(threshold, trees, depth)
    pairs = cut(candidate_pairs(docs, fields, width, forest, hot), "candidates")
    pairs = pairs.where(F.col("level") >= shortened(pairs, forest, target_recall)).select("a", "b")
    side = lambda s: docs.select(F.col("rid").alias(s), *[F.col(f).alias(f"{s}_{f}") for f in fields]).hint("merge")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = np.zeros(len(b))
            for f in fields:
                best = np.maximum(best, similarities(b[f"a_{f}"].tolist(), b[f"b_{f}"].tolist(), width))
            o = pd.DataFrame({"a": b["a"], "b": b["b"], "similarity": best})
            yield o[best >= threshold]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(verify, "a long, b long, similarity double")


def expand_members(pairs: DataFrame, members: DataFrame, key: str, copies_similar: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of ids from pairs of contents and from the copies of one content, id_a < id_b.

    The members of a content with many copies are spread by the checked join.
    """
    pairs, members = cut(pairs.select("a", "b"), "pairs"), cut(members, "members")
    m = lambda c, n: members.select(F.col("rid").alias(c), F.col(key).alias(n))
    across = join_checked(join_checked(m("a", "x"), pairs, ["a"]).select("b", "x"), m("b", "y"), ["b"]).select("x", "y")
    own = members.groupBy("rid").count().where("count > 1").select("rid").join(copies_similar.hint("merge"), "rid", "left_semi")
    several = cut(join_checked(members, own, ["rid"], "left_semi"), "copies")
    within = join_checked(several.select("rid", F.col(key).alias("x")), several.select("rid", F.col(key).alias("y")), ["rid"]).where("x < y").select("x", "y")
    both = across.unionByName(within).where("x != y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def with_shingles(docs: DataFrame, fields: list[str], width: int) -> DataFrame:
    """(rid) of the contents that have a shingle in some field."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[any(len(split_words(t)) >= width for t in row) for row in b[fields].itertuples(index=False)], ["rid"]]

    return docs.mapInPandas(some, "rid long")


def groups(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, class_id, links): connected components of the contents, by minimum labels with pointer jumping; links counts similar contents.

    The rounds end when no label changes; jumping halves the distance to a
    component's least label, so their number grows with its logarithm.
    """
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "rid"), "labels")
    for r in itertools.count():
        near = join_checked(edges, labels.select(F.col("rid").alias("b"), "label"), ["b"]).groupBy(F.col("a").alias("rid")).agg(F.min("label").alias("n"))
        step = labels.join(near.hint("merge"), "rid").select("rid", "links", F.col("label").alias("old"), F.least("label", "n").alias("label"))
        jump = join_checked(step, labels.select(F.col("rid").alias("label"), F.col("label").alias("up")), ["label"], "left")
        fresh = cut(jump.select("rid", "links", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"labels-{r}")
        labels = fresh.select("rid", "links", "label")
        if not rows_up_to(fresh.where("old != label"), 0):
            break
    return docs.select("rid").join(labels.hint("merge"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
