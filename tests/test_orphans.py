from datetime import datetime

from clausewright.operators.orphans import ForeignKey, direct_orphans, orphan_cascade, orphan_report
from clausewright.session import join_checked

T = [datetime(2024, m, 1) for m in range(1, 13)]
FK = ForeignKey("child", "ref", "created_at", "parent")
PARENT = "id string, status string, created_at timestamp"
CHILD = "id string, ref string, created_at timestamp, since int, status string"


def run(spark, children, parents, **kw):
    c = spark.createDataFrame([(*x, 1, "deleted") for x in children], CHILD)
    return {(r["row_id"], r["reason"]) for r in direct_orphans(c, spark.createDataFrame(parents, PARENT), FK, **kw).collect()}


def test_reasons(spark):
    parents = [("P1", "ok", T[2]), (" p2 ", "Deleted", T[0]), ("p3", None, T[5]), ("p3", "ok", T[1]), ("p4", "ok", None), ("p5", "deleted", T[0]), ("p5", "ok", T[0])]
    children = [("a", " p1\t", T[3]), ("b", "p1", T[1]), ("c", "P2", T[3]), ("d", "p3", T[2]), ("e", "p4", T[0]), ("f", "p9", T[0]), ("g", None, T[0]), ("h", "  ", T[0]), ("i", "p1", None), ("j", "p9", None), ("k", "p5", T[1]), ("f", "p9", T[0])]
    want = {("b", "later"), ("c", "missing"), ("f", "missing"), ("j", "missing")}
    assert run(spark, children, parents) == want
    assert run(spark, children, parents, broadcast_bytes=0) == want  # the merged join
    assert run(spark, children, []) == {(c[0], "missing") for c in children if c[1] and c[1].strip()}
    assert run(spark, [], parents) == set()


def test_cascade_and_report(spark):
    a = spark.createDataFrame([("a1", "x", T[1]), ("a2", "r", T[1])], "id string, root string, created_at timestamp").selectExpr("*", "'ok' as status")
    b = spark.createDataFrame([("b1", "a1", T[2]), ("b2", "a2", T[2]), ("b3", "zz", T[2])], "id string, up string, created_at timestamp").selectExpr("*", "'ok' as status")
    c = spark.createDataFrame([("c1", "B1", T[3]), ("c2", "b2", T[3])], "id string, up string, created_at timestamp").selectExpr("*", "'ok' as status")
    root = spark.createDataFrame([("r", "ok", T[0])], PARENT)
    keys = [ForeignKey("a", "root", "created_at", "root"), ForeignKey("b", "up", "created_at", "a"), ForeignKey("c", "up", "created_at", "b")]
    out = orphan_cascade({"a": a, "b": b, "c": c, "root": root}, keys)
    assert {(r["row_id"], r["kind"], r["level"]) for r in out.collect()} == {("a1", "direct", 0), ("b3", "direct", 0), ("b1", "inherited", 1), ("c1", "inherited", 2)}
    assert {(r["table_name"], r["period"], r["kind"], r["orphans"]) for r in orphan_report(out).collect()} == {("a", "2024-02", "direct", 1), ("b", "2024-03", "direct", 1), ("b", "2024-03", "inherited", 1), ("c", "2024-04", "inherited", 1)}


def test_many_parents_are_merged(spark):
    parents = spark.range(600_000).selectExpr("concat('p', id) as id", "'ok' as status", "timestamp'2024-01-01' as created_at")
    hot = spark.range(150_000).selectExpr("concat('c', id) as id", "if(id % 3 = 0, 'p7', concat('p', id * 5)) as ref", "timestamp'2024-02-01' as created_at")
    j = direct_orphans(hot, parents, FK)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert {r["row_id"] for r in j.collect()} == {f"c{i}" for i in range(150_000) if i % 3 and i * 5 >= 600_000}


def test_null_keys_and_every_join_kind(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, join_checked(left, right, ["k"], how).collect())) == want
        assert sorted(map(str, join_checked(left, right, ["k"], how, most=0).collect())) == want


def test_cascade_has_no_last_level(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}", T[2], "ok") for i in range(12)], "id string, up string, created_at timestamp, status string")
    out = orphan_cascade({"n": chain}, [ForeignKey("n", "up", "created_at", "n")]).collect()
    assert {(r["row_id"], r["level"]) for r in out} == {(f"n{i}", i) for i in range(12)}
