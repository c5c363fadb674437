"""Mixing sources to target weights.

Method: Pfair scheduling.  The texts of a source form a queue that is cut into
blocks of `block` tokens; block k of a source of weight w is released at k / w
and due at (k + 1) / w.  Earliest deadline first over one block per slot then
interleaves the sources with less than one block of deviation from their
weights at any time.  Weights are rounded to parts of `period`, so the order
repeats after `period` slots and is found once, on the driver, at a fixed
cost; every block of the corpus then gets its slot by arithmetic.

Each source gives min(target share of the total, its tokens times its
repeats).  The total is the tokens of the distinct texts of the sources with
targets, unless given.  A text that stands in several sources counts for the
one that is scarcest against its target, so no text is used more often than
its source allows.  Defined results: texts without tokens and sources without
target are left out; a source that can't reach its share gives what it may
and the shares really reached are reported; sources without texts are
reported with 0; repeated rows are one text.  There are at most `period`
sources with targets, since each has a slot of the period; more are refused,
which bounds what is collected and broadcast per source.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.session import cut, rows_up_to


def weight_parts(amounts: dict[str, float], period: int) -> dict[str, int]:
    """Whole parts of the period per source, at least one each, by largest remainders."""
    total = sum(amounts.values())
    exact = {s: a * period / total for s, a in amounts.items() if a > 0}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    rest = period - sum(parts.values())
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    while rest:
        for s in order if rest > 0 else sorted(parts, key=lambda s: -parts[s]):
            if not rest:
                break
            if rest > 0 or parts[s] > 1:
                parts[s] += 1 if rest > 0 else -1
                rest += -1 if rest > 0 else 1
    return parts


def pfair_slots(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot): earliest deadline first among released blocks, one block per slot."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))
    return out


def _owned(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, id, tokens): one row per distinct text, with the source it counts for."""
    t = F.broadcast(targets.select("source", "target_share"))
    rows = sizes.where("tokens > 0").join(t, "source")
    scarce = rows.groupBy("source").agg(F.when(F.max("target_share") > 0, F.try_divide(F.sum("tokens"), F.max("target_share"))).otherwise(F.lit(float("inf"))).alias("plenty"))
    r = rows.join(F.broadcast(scarce), "source")
    one = r.groupBy("digest").agg(F.min(F.struct("plenty", "source", "id", "tokens")).alias("m"))
    return one.select("m.source", "m.id", "m.tokens")


def _plan(owned: DataFrame, targets: DataFrame, total: int | None) -> list[dict]:
    """What each source has and gives; one row per target, on the driver."""
    have = {r["source"]: (r["t"], r["n"]) for r in owned.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rows = [r.asDict() for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()]
    whole = total if total is not None else sum(t for t, _ in have.values())
    for r in rows:
        r["available"], r["texts"] = have.get(r["source"], (0, 0))
        r["take"] = min(int(r["target_share"] * whole), r["available"] * max(0, r["max_repeats"]))
    return rows


def mix(sizes: DataFrame, targets: DataFrame, block: int = 8192, period: int = 10_000, total: int | None = None, bucket_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of sizes (id, source, digest, tokens) and targets (source, target_share, max_repeats).

    mix: (slot, offset, source, id, repeat, tokens), to be read in the order of
    slot and offset.  shares: per source what it should and does hold.
    """
    spark = sizes.sparkSession
    if rows_up_to(targets, period) > period:
        raise ValueError("more targets than slots in a period")
    owned = cut(_owned(sizes, targets), "owned")
    plan = _plan(owned, targets, total)
    schema = "source string, target_share double, max_repeats int, available long, texts long, take long"
    names = [c.split()[0] for c in schema.split(", ")]
    known = spark.createDataFrame([tuple(p[n] for n in names) for p in plan], schema)
    d = owned.join(F.broadcast(known.where("take > 0")), "source").withColumn("at", F.xxhash64("id"))
    # running sums in two steps: buckets of the hash order, then within a bucket
    width = F.greatest(F.lit(1), F.ceil(F.col("texts") / bucket_rows))
    d = d.withColumn("bucket", F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * width).cast("long"))
    sums = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).drop("s")
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = d.withColumn("cum", inside).join(before, ["source", "bucket"]).withColumn("begin", F.col("before") + F.col("cum") - F.col("tokens"))
    runs = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1))).withColumn("offset", F.col("repeat") * F.col("available") + F.col("begin"))
    used = runs.where(F.col("offset") + F.col("tokens") / 2 <= F.col("take"))
    amounts = {p["source"]: float(p["take"]) for p in plan if p["take"] > 0}
    slots = pfair_slots(weight_parts(amounts, max(period, len(amounts)))) if amounts else []
    parts: dict[str, int] = {}
    for s, _, _ in slots:
        parts[s] = parts.get(s, 0) + 1
    table = spark.createDataFrame([(s, k, slot, parts[s], len(slots)) for s, k, slot in slots], "source string, k long, first long, parts long, period long")
    per = spark.createDataFrame([(s, n) for s, n in parts.items()], "source string, parts long")
    u = used.join(F.broadcast(per), "source").withColumn("number", F.floor(F.col("offset") / block)).withColumn("k", F.col("number") % F.col("parts"))
    m = u.drop("parts").join(F.broadcast(table), ["source", "k"]).withColumn("slot", F.floor(F.col("number") / F.col("parts")) * F.col("period") + F.col("first"))
    out = cut(m.select("slot", "offset", "source", "id", "repeat", "tokens"), "mix")
    got = out.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("repeat") + 1).alias("repeats"))
    share = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))
    shares = known.join(got, "source", "left").na.fill(0).select("source", "target_share", share.alias("actual_share"), "tokens", "uses", "repeats", "max_repeats", "available", (F.col("take") < F.col("target_share") * sum(p["available"] for p in plan) - 1).alias("short"))
    return out, shares
