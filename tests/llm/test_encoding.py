import pytest

from clausewright.llm.encoding import repair_encoding

SOUND = ["Prüfung der Überwachung für Außenanlagen", "L’âge des pièces n’excède pas l’étalonnage", "PROTEÇÃO E MEDIÇÃO, SEÇÃO", "The symbols Ã and Â mark axes", "ñ á é “x” – §5 ±3 ≤ 5 Ω", "Рік і Рада і Режим і Ряд і Рух міста", "Напряжение в норме", "plain", "", None]
ENC = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"]


def garble(t, enc):
    return "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in t.encode())


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(i, t) for i, t in enumerate(SOUND)]
    rows += [(100 + k, garble("Die Prüfung “Größe” – é ≤ 5 Ω", e)) for k, e in enumerate(ENC)]
    rows += [(200, garble(garble("Prüfung é – ñ", "cp1252"), "cp1252")), (201, "Pr�fung"), (202, garble("é", "cp1252") + " and �")]
    rows += [(300 + k, garble(garble("Prüfung 🙂 – ñ", e), e)) for k, e in enumerate(ENC)]
    df = spark.createDataFrame(rows + rows[-1:], "id int, text string").selectExpr("id", "text", "1 as restored", "2 as lost")
    return {r["id"]: r for r in repair_encoding(df, "text", ["id"]).distinct().collect()}


def test_sound_text_stays(repaired):
    assert not [SOUND[i] for i in repaired if i < 100]


@pytest.mark.parametrize("k", range(len(ENC)))
def test_restored(repaired, k):
    assert repaired[100 + k]["restored"] == "Die Prüfung “Größe” – é ≤ 5 Ω"


def test_twice_and_lost(repaired):
    assert repaired[200]["restored"] == "Prüfung é – ñ"
    assert repaired[201]["lost"] and repaired[201]["restored"] == "Pr�fung"
    assert repaired[202]["lost"] and repaired[202]["restored"] == "é and �"


@pytest.mark.parametrize("k", range(len(ENC)))
def test_four_bytes_twice(repaired, k):
    assert repaired[300 + k]["restored"] == "Prüfung 🙂 – ñ"


def test_empty(spark):
    assert repair_encoding(spark.createDataFrame([], "id int, text string"), "text", ["id"]).count() == 0
