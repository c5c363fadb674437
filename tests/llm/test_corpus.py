import itertools
import random

import pytest

from clausewright.llm.mixing import mix, pfair_slots, weight_parts
from clausewright.llm.packing import Packing, evolve, pack
from clausewright.llm.residue import fit_residue, score_residue
from clausewright.llm.tokens import count_tokens


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, text string")
    got = {r["id"]: r["tokens"] for r in count_tokens(df, "text", ["id"]).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1


def test_packing(spark):
    sizes = [(i, (i * 37) % 90 + 1) for i in range(400)] + [(1000, 250), (1001, 300), (1002, 0), (0, 1)]
    out = pack(spark.createDataFrame(sizes, "id long, size long").selectExpr("id", "size", "1 as shard"), 100, shard_items=150).toPandas()
    assert (out.groupby("container")["size"].sum() <= 100).all()
    assert out[["id", "piece"]].duplicated().sum() == 0
    assert out.groupby("id")["size"].sum().to_dict() == {i: s for i, s in dict(sizes[::-1]).items() if s}
    assert (out[out["id"] < 1000]["piece"] == 0).all() and sorted(out[out["id"] == 1000]["size"]) == [50, 100, 100]
    assert out["container"].nunique() <= 1.05 * sum(s for _, s in sizes) / 100
    assert pack(spark.createDataFrame([], "id long, size long"), 100).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(sizes, "id long, size long"), 0)


def test_evolution_saves_containers(spark):
    r = random.Random(1)
    sizes = [r.randint(250, 500) for _ in range(600)]  # two or three to a container: best fit wastes room
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    greedy = len(Packing(sizes, 1000, []).place(order).bins)
    assert len(evolve(sizes, 1000, [], 1)[0].bins) < greedy
    placed = pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), 1000, shard_items=600).toPandas()
    assert placed.groupby("container")["size"].sum().max() <= 1000 and placed["container"].nunique() < greedy and len(placed) == 600


def test_pfair_deviation():
    parts = weight_parts({"a": 0.5, "b": 0.313, "c": 0.107, "d": 0.08}, 1000)
    assert sum(parts.values()) == 1000
    slots = pfair_slots(parts)
    assert [s for *_, s in slots] == list(range(1000))
    used = dict.fromkeys(parts, 0)
    for t, (s, k, _) in enumerate(slots, 1):
        assert used[s] == k
        used[s] += 1
        assert all(abs(n - parts[x] * t / 1000) < 1 for x, n in used.items())


def test_mix(spark):
    rows = [(i, "big", f"t{i}", 10) for i in range(500)] + [(1000 + i, "mid", f"m{i}", 10) for i in range(200)] + [(2000 + i, "small", f"s{i}", 10) for i in range(5)]
    rows += [(3000, "mid", "t1", 10), (3001, "other", "o", 10), (3003, "unwanted", "u", 0), (3002, "big", "zero", 0), (0, "big", "t0", 10)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("small", 0.1, 3), ("absent", 0.0, 2), ("unwanted", 0.0, 2)], "source string, target_share double, max_repeats int")
    sizes = spark.createDataFrame(rows, "id long, source string, digest string, tokens long").selectExpr("*", "1 as slot")
    m, shares = mix(sizes, targets, block=50, period=10_000, bucket_rows=30)
    m, s = m.toPandas(), {r["source"]: r for r in shares.collect()}
    uses = m.groupby(["source", "id"]).size()
    assert uses["big"].max() == 1 and uses["mid"].max() <= 2 and uses["small"].max() == 3
    assert abs(s["big"]["tokens"] - 0.5 * 7050) <= 10 and abs(s["mid"]["tokens"] - 0.4 * 7050) <= 10
    assert s["small"]["tokens"] == 150 and s["small"]["short"] and s["absent"]["tokens"] == 0
    m = m.sort_values(["slot", "offset"])
    total, seen = m["tokens"].sum(), 0
    run = dict.fromkeys(("big", "mid", "small"), 0)
    for x in m.itertuples():
        run[x.source] += x.tokens
        seen += x.tokens
        assert all(abs(v - s[k]["tokens"] / total * seen) <= 50 + 10 for k, v in run.items())  # a block, and the text that a block may end in


def test_mix_of_nothing(spark):
    sizes = spark.createDataFrame([], "id long, source string, digest string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    m, shares = mix(sizes, targets)
    assert m.count() == 0 and [(r["source"], r["tokens"]) for r in shares.collect()] == [("a", 0)]
    none = targets.where("max_repeats > 5")
    m, shares = mix(spark.createDataFrame([(1, "a", "d", 5)], sizes.schema), none)
    assert m.count() == 0 and shares.count() == 0
    two = spark.createDataFrame([(1, "a", "d", 5), (2, "z", "e", 5)], sizes.schema)
    m, shares = mix(two, targets.unionByName(targets.selectExpr("'z' as source", "0.0D as target_share", "max_repeats")))
    assert {r["source"]: r["tokens"] for r in shares.collect()} == {"a": 10, "z": 0}


def test_residue(spark):
    topics = ["relay", "panel", "switch", "clock", "router", "server"]
    rows = [(i, f"The {a} shall report to the {b} under load. Wiring of the {a} follows the drawing of the {b}. The bid lists the {b} against the schedule {i % 7}.") for i, (a, b) in enumerate(itertools.product(topics, topics))]
    rows += [(100 + i, f"Error 50{i}.\nSomething went wrong while we loaded this page.\nPlease sign in again to view this document.") for i in range(4)]
    rows += [(200, rows[0][1] + "\nPlease sign in again to view this document."), (201, "Prepared for {{ client }}."), (202, "The web server of the relay shall answer an unknown address with error 404 and write it to the log of the panel. The bid lists the panel against the schedule."), (203, None), (204, "")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").selectExpr("doc_id", "text", "1 as residue")
    got = {r["doc_id"] for r in score_residue(df, "text", ["doc_id"], fit_residue(df, "text")).collect()}
    assert got == {100, 101, 102, 103, 200, 201}
    e = df.where("doc_id < 36")
    assert score_residue(e, "text", ["doc_id"], fit_residue(e, "text")).count() == 0
