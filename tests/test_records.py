from pyspark.sql import functions as F

from clausewright.operators import records as rc


def test_packing_is_bounded_and_ordered(spark):
    df = spark.createDataFrame([("r", f"t{i}" * 900, 0.5 + (i % 3) / 10, i) for i in range(9)], "k string, t string, s double, n int")
    e = rc.pack_evidence(df, "k", "t", "s", "n").first()["evidence"]
    assert [x["evidence_id"] for x in e] == ["E1", "E2", "E3", "E4"] and [x["score"] for x in e] == [0.7, 0.7, 0.7, 0.6]
    assert all(len(x["text"]) == 1400 for x in e) and e[0]["text"].startswith("t2")


def test_ids_scores_and_punctuation(spark):
    df = spark.createDataFrame([(["E2", "E9", "E1", "E2"], ["E1", "E2"], 0.9, 0.5, "a — b–c")], "c array<string>, a array<string>, v double, l double, p string")
    r = df.select(rc.resolve_ids(F.col("c"), F.col("a")), rc.gate_score(F.col("v"), F.col("l")), rc.ui_punctuation(F.col("p"))).first()
    assert list(r) == [["E2", "E1"], 0.78, "a , b-c"]


def test_citations(spark):
    c = spark.createDataFrame([("a", "The  Relay"), ("a", "the panel"), ("b", ""), ("b", None)], "k string, q string")
    s = spark.createDataFrame([("a", "here is the relay."), ("b", "the panel"), ("a", None)], "k string, t string")
    assert {(r["q"], r["valid"]) for r in rc.validate_citations(c, s, "k", "q", "t").collect()} == {("The  Relay", True), ("the panel", False), ("", False), (None, False)}


def test_edits_and_replacement(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, t string, n int")
    e = spark.createDataFrame([(1, " ", 9), (2, "new", None)], "id int, t string, n int")
    assert {tuple(r) for r in rc.apply_edits(d, e, "id", ["t", "n"]).collect()} == {(1, "a", 9), (2, "new", 6)}
    new = spark.createDataFrame([("n1", "q", 1, None), ("n2", "q", 2, None), ("n3", "z", 1, None)], "id string, q string, o int, note string")
    old = spark.createDataFrame([("o1", "q", 4, "kept")], "id string, q string, o int, note string")
    assert {tuple(r) for r in rc.replace_preserving(new, old, ["q"], "o", ["id", "note"]).collect()} == {("o1", "q", 1, "kept"), ("n2", "q", 2, None), ("n3", "z", 1, None)}


def test_routing_and_evaluator(spark):
    d = spark.createDataFrame([(1, "manual", True), (2, "manual", None), (3, "test", True)], "id int, scope string, evidence boolean")
    seen = d.where("scope = 'manual' and evidence")
    out = rc.evaluate(d, (F.col("scope") == "manual") & F.col("evidence"), lambda b: b.assign(decision="Compliant"), "id int, scope string, evidence boolean, decision string", {"decision": F.lit("Unknown")})
    assert {(r["id"], r["decision"]) for r in out.collect()} == {(1, "Compliant"), (2, "Unknown"), (3, "Unknown")} and seen.count() == 1
    routed = rc.route(out, [(F.col("scope") != "manual", {"method": F.lit("review")}), (F.col("evidence").isNull(), {"method": F.lit("no-evidence"), "confidence": F.lit(95)})], {"method": F.lit("evaluated"), "confidence": F.lit(0)})
    assert {(r["id"], r["method"], r["confidence"]) for r in routed.collect()} == {(1, "evaluated", 0), (2, "no-evidence", 95), (3, "review", 0)}


def test_index_keeps_the_last_version(spark):
    a = spark.createDataFrame([("c1", "old", 1), ("c1", "new", 2), ("c2", "x", 1)], "id string, t string, seq int")
    i = rc.upsert_vectors(None, a, "id", "seq")
    assert {(r["id"], r["t"]) for r in i.collect()} == {("c1", "new"), ("c2", "x")}
    j = rc.upsert_vectors(i, spark.createDataFrame([("c2", "y", 5)], "id string, t string, seq int"), "id", "seq")
    assert {(r["id"], r["t"]) for r in j.collect()} == {("c1", "new"), ("c2", "y")}


def test_fallback_and_isolation(spark):
    from clausewright.operators.records import job_outcome, run_isolated, with_fallback

    def picky(rows):
        if len(rows) > 1:
            raise ValueError("too many")
        return ",".join(map(str, rows["v"]))

    def odd(rows):
        if (rows["v"] % 2 == 0).any():
            raise ValueError("even")
        return picky(rows)

    d = spark.createDataFrame([("j", b, v) for b, vs in ((1, [1, 3, 5]), (2, [2, 4]), (3, [7]), (None, [9])) for v in vs], "job string, batch int, v int")
    got = {r["batch"]: (r["status"], r["result"], r["error"]) for r in run_isolated(d, "batch", ["v"], with_fallback([odd])).collect()}
    assert got == {1: ("completed", "1\n3\n5", None), 2: ("failed", None, "even"), 3: ("completed", "7", None)}
    both = run_isolated(d, "batch", ["v"], with_fallback([odd, picky]))
    assert {r["status"] for r in both.collect()} == {"completed"}
    out = job_outcome(run_isolated(d, "batch", ["v"], odd).selectExpr("'j' as job", "*"), ["job"]).first()
    assert (out["completed"], out["failed"], out["status"]) == (1, 2, "failed")
    assert run_isolated(d.where("false"), "batch", ["v"], odd).count() == 0


def test_ingest(spark, tmp_path):
    import pytest

    from clausewright.sources.pages import ingest

    (tmp_path / "m.txt").write_text("x" * 4000 + "\fpage two")
    root = str(tmp_path / "r")
    assert ingest(spark, str(tmp_path / "m.txt"), "product", "a", root) == 4 and ingest(spark, str(tmp_path / "m.txt"), "rfq", "b", root) == 2
    assert ingest(spark, str(tmp_path / "m.txt"), "rfq", "b", root) == 2
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path / "m.txt"), "other", "c", root)
    (tmp_path / "e.txt").write_text("\f")
    with pytest.raises(Exception, match="no text"):
        ingest(spark, str(tmp_path / "e.txt"), "rfq", "d", root)
    log = spark.read.parquet(f"{root}/status").collect()
    assert sorted((r["document_id"], r["status"], r["rows"]) for r in log) == [("a", "indexed", 4), ("b", "ready", 2), ("b", "ready", 2), ("d", "failed", 0)]
