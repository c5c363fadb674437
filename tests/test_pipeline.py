"""Candidates, evidence, orders and settings on small fixtures."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from clausewright.config import Settings
from clausewright.operators import candidates as ca
from clausewright.operators import dedupe as dd
from clausewright.operators import evidence as ev
from clausewright.operators import state as st
from clausewright.operators.order import fixed_batches, global_position, page_of
from clausewright.sources import exports as ex
from clausewright.sources import pages as pg

BLOCK = "document_id string, page_number int, block int, text string, section string, bbox array<double>"
SURE = "The supplier shall provide one relay panel with test blocks."


def blocks(spark, *texts):
    return spark.createDataFrame([("d", 1, i, t, "S", None) for i, t in enumerate(texts)], BLOCK)


def test_explicit_candidates(spark):
    b = blocks(spark, f"{SURE} Too short. {SURE.upper()}", "The relay is grey and stands in the corner of the hall.", "The supplier shall provide one relay panel with:", None, "", "The supplier shall provide a relay panel that ench feeder and bus has.")
    got = ca.explicit_candidates(b).orderBy("at").collect()
    assert [(r["candidate_id"], r["candidate_type"], r["confidence"], r["criticality"]) for r in got] == [("p1-explicit-0", "explicit", 92, "Mandatory"), ("p1-explicit-1", "explicit", 92, "Mandatory")]
    assert got[0]["source_quote"] == SURE and "each" not in got[1]["source_quote"]  # the quote stays as it is
    none = ca.explicit_candidates(b, lambda section, quote: section == "S")
    assert none.count() == 0 and ca.explicit_candidates(b.where("false")).count() == 0
    d = ca.direct_requirements(ca.explicit_candidates(b)).collect()
    assert any("each feeder" in r["requirement_text"] and "ench feeder" in r["source_quote"] for r in d)


def test_garbled_candidates_are_ambiguous(spark):
    got = ca.explicit_candidates(blocks(spark, "The supplier shall provide one re!ay and one panel with test blocks.")).first()
    assert (got["candidate_type"], got["candidate_id"], got["confidence"]) == ("ambiguous", "p1-ambiguous-0", 65)


def test_tables_and_merging(spark):
    t = spark.createDataFrame([("d", 1, 9, ["Item", "Rating"], [["Relay", "5 A"], ["", ""]], "S", None), ("d", 1, 10, ["Page no.", "x"], [["relay", "5 A and more"]], "S", None)], "document_id string, page_number int, block int, header array<string>, rows array<array<string>>, section string, bbox array<double>")
    tab = ca.table_candidates(t)
    assert [(r["candidate_id"], r["source_quote"]) for r in tab.collect()] == [("p1-table-0", "Item | Rating Relay | 5 A")]
    ex_ = ca.explicit_candidates(blocks(spark, SURE))
    assert {r["candidate_id"] for r in ca.merged_candidates(ex_, tab, ex_).collect()} == {"p1-explicit-0", "p1-table-0"}
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "relay " * 10), ("d", 3, None)], "document_id string, page_number int, text string")
    r = ca.relevant_pages(pages, tab)
    assert {x["page_number"]: x["technical"] for x in r.collect()} == {1: 0, 2: 10}
    assert not ca.batch_complexity(r, ["document_id"]).first()["complex"]
    assert ca.open_characters(tab).first()["open_chars"] == len("Item | Rating Relay | 5 A")


def test_decisions_validation_keys(spark):
    c = spark.createDataFrame([("a", "S", "q1", None), ("b", "S", "q2", None)], "candidate_id string, section string, source_quote string, source_bbox array<double>")
    d = spark.createDataFrame([("a", True, " It shall trip. ", "T", "M", 99), ("a", None, "It shall.", "T", "M", 5), ("b", True, "Nothing said", "T", "M", 5), ("z", True, "It shall.", "T", "M", 5), ("b", True, None, "T", "M", 5)], "candidate_id string, accept boolean, requirement_text string, category string, criticality string, confidence int")
    assert [(r["candidate_id"], r["requirement_text"], r["confidence"], r["source_quote"]) for r in ca.accepted_decisions(d, c, ["candidate_id"]).collect()] == [("a", "It shall trip.", 88, "q1")]
    items = spark.createDataFrame([(1, "d", 1, "Some  TEXT"), (2, "d", 1, ""), (3, "d", 2, "some text"), (4, "d", None, "some text"), (5, "d", 1, "absent"), (6, "d", 1, None)], "id int, document_id string, page_number int, source_quote string")
    pages = spark.createDataFrame([("d", 1, "here is some text"), ("d", 1, "some text again"), ("d", 3, None)], "document_id string, page_number int, text string")
    assert [r["id"] for r in ca.validated(items, pages, ["document_id", "page_number"]).collect()] == [1]
    n = ca.numbered_requirements(spark.range(1001).selectExpr("'d' as document_id", "id"), "document_id", ["id"]).orderBy("id").collect()
    assert (n[0]["requirement_key"], n[98]["requirement_key"], n[1000]["requirement_key"]) == ("REQ-001", "REQ-099", "REQ-1001")


def test_evidence_gate(spark):
    need = spark.createDataFrame([(1, "The relay shall trip at 115 V"), (2, "The relay shall report alarms"), (3, None)], "id int, need string")
    got = [(1, "relay trip 115 V", 0.9, 0), (1, "relay trip 230 V", 0.9, 1), (1, "relay trip 115V voltage", 0.9, 2), (2, "nothing here", 0.9, 0), (2, "relay alarms", 0.5, 1), (2, "relay alarms", float("nan"), 2), (2, "relay alarms", None, 3), (3, "relay", 0.9, 0)]
    g = ev.gated_evidence(need, spark.createDataFrame(got, "id int, text string, score double, n int"), "id", "need", "text", "score", "n", most=1)
    assert [(r["id"], r["n"], r["place"]) for r in g.collect()] == [(1, 0, 1)]
    w = {r["id"]: [x["evidence_id"] for x in r["evidence"]] for r in ev.with_evidence(need, ev.packed_evidence(g, "id", ["score"], "text", 5), "id").collect()}
    assert w == {1: ["E1"], 2: [], 3: []}
    a = spark.createDataFrame([("P", None), ("", "r"), (None, "r")], "p string, r string")
    assert [r[0] and tuple(r[0]) for r in a.select(ev.alternate(F.col("p"), F.col("r"))).collect()] == [("P", ""), None, None]
    c = spark.createDataFrame([(7, [0.9], "Unknown"), (0, [0.125, 0.1], "Unknown"), (0, [], "Unknown"), (0, [], "Compliant"), (0, [float("nan"), None], "Unknown")], "c int, s array<double>, d string")
    assert [r[0] for r in c.select(ev.calibrated(F.col("c"), F.col("s"), F.col("d"))).collect()] == [7, 12, 70, 0, 70]
    m = spark.createDataFrame([("j", {"a": 1}), ("j", {"a": 2, "b": 5}), ("k", None)], "j string, m map<string,int>")
    assert {tuple(r) for r in ev.merged_metrics(m, "j", "m").collect()} == {("j", "a", 3), ("j", "b", 5)}


def test_positions(spark):
    r = random.Random(6)
    d = spark.createDataFrame([(i, r.choice([None, 1, 2, 3])) for i in range(200)], "id int, k int")
    order = [F.asc_nulls_last("k"), F.asc("id")]
    want = sorted((x["k"] is None, x["k"] or 0, x["id"]) for x in d.collect())
    got = {x["id"]: x["position"] for x in global_position(d, order).collect()}
    assert [got[i] for *_, i in want] == list(range(1, 201))
    assert [x["position"] for x in page_of(d, order, 99, 30).orderBy("position").collect()] == list(range(181, 201))
    assert [x["position"] for x in page_of(d, order, 0, 3).orderBy("position").collect()] == [1, 2, 3]
    assert page_of(d.where("false"), order, 3).count() == 0 and global_position(d.where("false"), order).count() == 0
    assert {x["batch"] for x in fixed_batches(d, order, 8).collect()} == set(range(25))


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_order_is_kept(spark, seed):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    base = [" ".join(r.choice(words) for _ in range(24)) for _ in range(3)]
    rows = []
    for i in range(70):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abcdef")
        rows.append((i, r.choice(["a", None]), i // 2, "".join(t)))
    rows += [(100, "a", 0, None), (101, "a", 0, "  ")]
    d = spark.createDataFrame(rows, "id int, c string, seq int, t string").selectExpr("*", "1 as kept")
    got = {x["id"]: (x["kept"], x["of"]) for x in dd.greedy_near_duplicates(d, ["c"], "t", ["seq"], "id").collect()}
    assert set(got) == set(range(70))
    kept = {"a": [], None: []}
    for i, c, _, t in rows[:70]:
        nums = lambda x: __import__("re").findall(r"\b\d+\b", x)
        ident = __import__("re").sub("[^a-z0-9]+", " ", t).strip()
        like = next((k for k, u in kept[c] if u == ident or nums(u) == nums(ident) and min(len(u), len(ident)) >= 0.9 * max(len(u), len(ident)) and difflib.SequenceMatcher(None, ident, u).ratio() >= 0.965), None)
        assert got[i][0] == (like is None), i
        if like is None:
            kept[c].append((i, ident))


def test_settings(spark):
    assert Settings.of(spark) == Settings()
    spark.conf.set("spark.clausewright.evidence_limit", "6")
    assert Settings.of(spark).evidence_limit == 6
    spark.conf.unset("spark.clausewright.evidence_limit")


def test_stale_and_require(spark):
    a = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "k string, i int")
    assert [r["k"] for r in st.stale(st.fingerprint(a, ["k"], ["i"]), st.fingerprint(a.where("i = 1"), ["k"], ["i"]), ["k"]).collect()] == ["d"]
    assert a.select(st.require(F.col("i") > 0, "no")).distinct().count() == 1
    with pytest.raises(Exception, match="not current"):
        a.select(st.require(F.col("i") > 1, "not current")).collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "empty.txt").write_text(" \f ")
    with pytest.raises(Exception, match="no text"):
        pg.read_pages(spark, str(tmp_path / "empty.txt")).collect()
    assert pg.catalog_status(spark, str(tmp_path / "none")) == 0
    d = spark.createDataFrame([(2, None), (1, "x")], "i int, t string")
    ex.replace_all(d, str(tmp_path / "p"))
    ex.replace_all(d.where("i = 1"), str(tmp_path / "p"))
    ex.append_log(d, str(tmp_path / "p"))
    assert pg.catalog_status(spark, str(tmp_path / "p")) == 3
    assert ex.json_document(d, ["i"]).first()[0].startswith('[ {\n  "i" : 1,\n  "t" : "x"\n}, {') and '"t" : null' in ex.json_document(d, ["i"]).first()[0]
    pages = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "n int, text string")
    layout = spark.createDataFrame([(1, "a text long enough to count", True), (2, "short", True)], "n int, text string, ocr boolean")
    assert {r["n"]: (r["text"], r["ocr_applied"]) for r in pg.layout_merged(pages, layout, ["n"]).collect()} == {1: ("a text long enough to count", True), 2: ("old", False), 3: ("old", False)}


def test_pairs_of_blocks_meet_once(spark):
    d = spark.createDataFrame([("g", i) for i in range(50)] + [(None, 1)], "g string, i int").where("g is not null")
    b = dd.in_blocks(d, ["g"], "i", 8).collect()
    met = {}
    for lo, hi in {(r["__lo"], r["__hi"]) for r in b}:
        rows = [(r["i"], r["__own"]) for r in b if (r["__lo"], r["__hi"]) == (lo, hi)]
        for (x, o), (y, p) in itertools.combinations(rows, 2):
            if (min(o, p), max(o, p)) == (lo, hi):
                met[min(x, y), max(x, y)] = met.get((min(x, y), max(x, y)), 0) + 1
    assert len(met) == 50 * 49 / 2 and set(met.values()) == {1}
