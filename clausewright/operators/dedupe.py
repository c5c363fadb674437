"""Exact and greedy near-duplicate elimination, validation against the source, latest rows."""

from __future__ import annotations

import difflib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.fixed import IDENTITY_REPAIRS, PROTECTED
from clausewright.functions.text import fold
from clausewright.session import cut, join_checked, rows_up_to


def keep_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key: an upsert of all rows in their order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def identity_text(c: Column) -> Column:
    """Folded, usual misreadings repaired, everything but letters and digits to one space."""
    repaired = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), IDENTITY_REPAIRS, fold(c))
    return F.trim(F.regexp_replace(repaired, "[^a-z0-9]+", " "))


def material_key(identity: Column) -> Column:
    """Numbers and standards in order; texts with different ones are never duplicates."""
    return F.array_join(F.regexp_extract_all(identity, F.lit(rf"\b(?:{PROTECTED})\b"), 0), ",")


def in_blocks(df: DataFrame, group: list[str], unit: str, size: int) -> DataFrame:
    """df + (__own, __lo, __hi): the rows of a group in blocks of about `size`, each repeated for every pair of blocks it is in."""
    counted = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__blocks"))
    d = join_checked(df, counted, group).withColumn("__own", F.pmod(F.xxhash64(unit), F.col("__blocks")).cast("int"))
    d = d.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return d.withColumn("__lo", F.least("__own", "__other")).withColumn("__hi", F.greatest("__own", "__other")).drop("__other", "__blocks")


def near_pairs(df: DataFrame, group: list[str], key: str, seq: list[str], identity: str, length_ratio: float = 0.9, ratio: float = 0.965, size: int = 256) -> DataFrame:
    """(first, second): rows of a group, in order, whose identities resemble each other; groups are compared in pairs of blocks.

    Rows meet in the classes of their length and of the next one, which holds
    all lengths that the ratio allows.  Cheap upper bounds (length, characters
    in common) come before the sequence matcher.
    """
    width = -math.log(length_ratio)
    own = F.floor(F.log(F.length(identity).cast("double")) / width).cast("int")
    d = df.select(*group, key, F.struct(*seq, key).alias("__at"), F.col(identity).alias("__t"), own.alias("__l"))
    d = d.withColumn("__class", F.explode(F.array("__l", F.col("__l") + 1)))
    d = in_blocks(d, [*group, "__class"], key, size).withColumn("__g", F.xxhash64(*group, "__class", "__lo", "__hi"))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("first", kind), T.StructField("second", kind)])
    names = [*group, "__class", "__lo", "__hi"]

    def compare(rows: list[tuple], lo: int, hi: int, cls: int) -> Iterator[tuple]:
        bags = [Counter(t) for _, t, *_ in rows]
        for j, (k2, t2, o2, l2) in enumerate(rows):
            for i, (k1, t1, o1, l1) in enumerate(rows[:j]):
                if (min(o1, o2), max(o1, o2)) != (lo, hi) or max(l1, l2) != cls:
                    continue
                total = len(t1) + len(t2)
                if min(len(t1), len(t2)) < length_ratio * max(len(t1), len(t2)) or 2 * (bags[i] & bags[j]).total() < ratio * total:
                    continue
                if difflib.SequenceMatcher(None, t2, t1).ratio() >= ratio:
                    yield k1, k2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
                if rest.empty:
                    continue
                last = int((rest["__g"] != rest["__g"].iloc[-1]).sum())
                whole, rest = rest.iloc[:last], rest.iloc[last:]
            elif rest is None:
                return
            else:
                whole = rest
            new = np.zeros(len(whole), dtype=bool)
            for c in ("__g", *names):
                v = whole[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            new[:1] = True
            starts = np.flatnonzero(new).tolist()
            rows = list(zip(whole[key], whole["__t"], whole["__own"], whole["__l"], strict=True))
            at = list(zip(whole["__lo"], whole["__hi"], whole["__class"], strict=True))
            pairs = [p for x, y in itertools.pairwise([*starts, len(rows)]) if y - x > 1 for p in compare(rows[x:y], *at[x])]
            if pairs:
                yield pd.DataFrame(pairs, columns=["first", "second"])

    d = d.select(*names, "__g", "__own", "__l", key, "__t", "__at").repartition("__g").sortWithinPartitions("__g", *names, "__at")
    return d.drop("__at").mapInPandas(run, schema).distinct()


def greedy_near_duplicates(df: DataFrame, block: list[str], text: str, seq: list[str], key: str, length_ratio: float = 0.9, ratio: float = 0.965) -> DataFrame:
    """(key, kept, of): each row of a block in order is dropped if it resembles one kept before; of: the first such.

    Equal identities fall to the first of them without comparison.  The rest is
    compared within its material key, which loses nothing, and the order is
    followed in rounds: a row is kept when all rows before it that it resembles
    are dropped, and dropped when one of them is kept.  key must be unique.
    """
    at = F.struct(*seq, key)
    base = df.select(*block, *seq, key, identity_text(F.col(text)).alias("__t")).withColumn("__m", material_key(F.col("__t")))
    base = base.where("__t is not null and __t != ''").withColumn("__k", F.sha2(F.to_json(F.struct(*block, "__t")), 256))
    base = cut(base, "identities")
    reps = cut(base.groupBy("__k").agg(F.min_by(F.struct(*block, "__m", "__t", *seq, key), at).alias("r")).select("__k", "r.*"), "firsts")
    group = [*block, "__m"]
    named = reps.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in block})
    pairs = cut(near_pairs(named, group, key, seq, "__t", length_ratio, ratio), "near")
    open_, dropped = pairs, None
    for n in itertools.count():
        # rows that nothing open stands before are kept; what resembles them is dropped
        kept = open_.select(F.col("first").alias("k")).distinct().join(open_.select(F.col("second").alias("k")).distinct(), "k", "left_anti")
        gone = cut(open_.join(kept.withColumnRenamed("k", "first"), "first", "left_semi"), f"gone-{n}")
        if not rows_up_to(gone, 0):
            break
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = gone.select(F.col("second").alias("k")).distinct()
        open_ = open_.join(out.withColumnRenamed("k", "second"), "second", "left_anti").join(out.withColumnRenamed("k", "first"), "first", "left_anti")
        open_ = cut(open_.join(kept.withColumnRenamed("k", "first"), "first", "left_anti"), f"open-{n}")
    order = reps.select(F.col(key).alias("first"), F.struct(*seq, key).alias("__at"))
    dropped = pairs.where("false") if dropped is None else dropped
    of = dropped.join(order, "first").groupBy(F.col("second").alias("__first")).agg(F.min_by("first", "__at").alias("__of"))
    each = join_checked(base.select("__k", key), reps.select("__k", F.col(key).alias("__first")), ["__k"])
    j = each.join(of, "__first", "left")
    return j.select(key, ((F.col(key) == F.col("__first")) & F.col("__of").isNull()).alias("kept"), F.coalesce("__of", F.when(F.col(key) != F.col("__first"), F.col("__first"))).alias("of"))


def positional_match(new: DataFrame, old: DataFrame, key: list[str], order_new: list[str], order_old: list[str]) -> DataFrame:
    """new with the columns of old: the n-th row of a key meets the n-th row of that key."""
    n = lambda d, o: d.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*o)))
    return n(new, order_new).join(n(old, order_old), [*key, "__n"], "left").drop("__n")
