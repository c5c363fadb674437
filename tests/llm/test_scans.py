import random

import pytest

from clausewright.llm.scans import _index, _shared, repair_scans, scan_findings

WORDS = "the relay shall supply one dedicated converter under normal operation with certified accuracy while every monitoring channel reports alarm signals from northern feeders without loss of documented integrity".split()


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(f"s{i}", "\n".join(line(9) for _ in range(6)) + ".") for i in range(150)]
    rows += [(f"c{i}", line(40) + ".") for i in range(150)]
    rows += [
        ("h", f"{line(8)} con-\nverter {line(8)}."),
        ("soft", f"{line(8)} con­\n  verter {line(8)}."),
        ("f", f"{line(8)}\nPage 33 of 233\n{line(8)}.\n{line(7)}."),
        ("g", f"{line(8)}\nManual LMV-3619 | Control Works\n- 5 -\n{line(8)}.\n{line(7)}."),
        ("m", f"{line(8)} c0nverter frorn {line(8)}."),
        ("std", "Clause 4.2 of IEC 61850-\n9-2 governs the names of the relay."),
        ("std2", f"{line(8)} Clause 4.2 of IEC 61850-\n9-2\ngoverns the names of the relay."),
        ("std3", f"{line(8)}.\nClause 4.2 of IEC 61850-\n9-2 governs the names of the relay. {line(8)}"),
        ("toc", "Contents\nnormal operation ........ 3\nalarm signals ........ 4\nnorthern feeders ........ 5\n"),
        ("n", None),
        ("e", ""),
    ]
    df = spark.createDataFrame(rows + rows[150:151], "id string, text string").selectExpr("id", "text", "1 as word", "2 as n", "3 as lines")
    return df, dict(rows)


def test_findings(data):
    df, _ = data
    f = scan_findings(df, "text", ["id"])
    assert {r["id"] for r in f["furniture"].collect()} == {"f", "g"}
    assert {r["id"] for r in f["splits"].collect()} == {"h", "soft"}
    assert {(r["id"], r["word"], r["replacement"]) for r in f["misread"].collect()} == {("m", "c0nverter", "converter"), ("m", "frorn", "from")}


def test_repair(data):
    df, texts = data
    out = {r["id"]: r["clean_text"] for r in repair_scans(df, "text", ["id"]).collect()}
    assert set(out) == {"h", "soft", "f", "g", "m"}
    assert out["h"] == texts["h"].replace("con-\nverter", "converter")
    assert out["m"] == texts["m"].replace("c0nverter", "converter").replace("frorn", "from")
    assert "\n" not in out["f"] and "Page" not in out["f"] and "LMV" not in out["g"]


def test_marks_beside_furniture_are_classified(spark):
    r = random.Random(3)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(f"s{i}", "\n".join(line(9) for _ in range(6)) + ".") for i in range(150)] + [(f"d{i}", f"{line(8)} the high-voltage relay and one high voltage feeder. {line(6)}.") for i in range(60)]
    rows += [("plain", f"{line(8)} one high-\nvoltage relay {line(8)}."), ("head", f"{line(8)} one high-\nvoltage relay {line(8)}\nPage 33 of 233\n{line(8)}."), ("apart", f"{line(8)} one con-\nPage 34 of 233\nverter {line(8)}.\n{line(7)}.")]
    rows += [(f"v{i}", f"{line(5)} converter {line(5)} voltage.") for i in range(40)]
    out = {r["id"]: r["clean_text"] for r in repair_scans(spark.createDataFrame(rows, "id string, text string"), "text", ["id"]).collect()}
    assert "plain" not in out or "highvoltage" not in out["plain"]
    assert "highvoltage" not in out["head"] and "Page" not in out["head"]
    assert "converter" in out["apart"] and "Page" not in out["apart"]


def test_words_of_any_letters_and_length(spark):
    long = "gegenspannungsschutzrelaisanschlußdose"
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(f"a{i}", f"die prüfung der {long} nach der prüfung {i} {line(30)}") for i in range(150)]
    rows += [("x", f"die prufung der {long}"), ("y", f"die prüfung der {long.replace('o', '0')} {line(8)}")]
    got = {(r["id"], r["word"], r["replacement"]) for r in scan_findings(spark.createDataFrame(rows, "id string, text string"), "text", ["id"])["misread"].collect()}
    assert got == {("y", long.replace("o", "0"), long)}  # a missing accent is no misreading


def test_index_loses_no_candidate(spark):
    r = random.Random(8)
    names = sorted({"".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(120)})
    counts = spark.createDataFrame([(w, 100) for w in names], "word string, n long")
    index = {(x["g"], x["at"], x["len"], x["target"]) for x in _index(counts).collect()}
    for w in names:
        grams = [(f"^{w}$"[i : i + 2], i + 1) for i in range(len(w) + 1)]
        met = {t for g, at, n, t in index if n == len(w) and (g, at) in grams}
        assert {t for t in names if abs(len(t) - len(w)) <= 2 and _shared(w, t) >= max(2, -(-(len(t) + 1) * 2 // 5))} <= met


def test_empty(spark):
    e = spark.createDataFrame([], "id string, text string")
    assert all(d.count() == 0 for d in scan_findings(e, "text", ["id"]).values())


def test_misread_in_many_copies(data, spark):
    df, _ = data
    line = "the relay shall supply one c0nverter under normal operation with certified accuracy."
    d = df.select("id", "text").unionByName(spark.createDataFrame([(f"k{i}", line) for i in range(150)], "id string, text string"))
    got = {(r["id"], r["word"], r["replacement"]) for r in scan_findings(d, "text", ["id"])["misread"].collect()}
    assert got == {("m", "c0nverter", "converter"), ("m", "frorn", "from"), *((f"k{i}", "c0nverter", "converter") for i in range(150))}
