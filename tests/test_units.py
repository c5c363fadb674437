import pytest

from clausewright.operators.units import convert_quantities

CASES = {
    "mass of 240.5 kilograms ±10 %": {("mass", 240500)},
    "between 2.1 and 2.5 seconds": {("duration", 2100), ("duration", 2500)},
    "size of 35 x 607 × 120 mm": {("length", 35000), ("length", 607000), ("length", 120000)},
    "from minus 25 ℃ to +70 °C": {("temperature", -25000), ("temperature", 70000)},
    "dual rating of 110/220 Vdc": {("voltage", 110000), ("voltage", 220000)},
    "voltage in kV: 6,6": {("voltage", 6600000)},
    "weight [pounds] 10.": {("mass", 4536)},
    "1,200mV and 12 506 mm, 1250,4 A": {("voltage", 1200), ("length", 12506000), ("current", 1250400)},
    "of forty-five minutes": {("duration", 2700000)},
    'depth of 19" and 400-A': {("length", 482600), ("current", 400000)},
    "14 degrees Fahrenheit, 263 K": {("temperature", -10000), ("temperature", -10150)},
    "12 kilograrns or 5 rnillimetres": {("mass", 12000), ("length", 5000)},
    "30 milli-\nmetres": {("length", 30000)},
    "See item 12 in Annex C. Slot 3 A-side. Drawing 220-V-17. Cat 6A. 50 Hz. ±5 V. 10 %. X12 m": set(),
    "plate reads “Série Nº 7” and “Größe M”, depth of 4”": {("length", 101600)},
    "": set(),
    None: set(),
}


@pytest.fixture(scope="module")
def converted(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(0, next(iter(CASES)))]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("id", "text", "'x' as spelling", "1 as value")
    out = {}
    for r in convert_quantities(df, "text", ["id"]).collect():
        out.setdefault(r["id"], set()).add((r["quantity"], round(r["common_value"] * 1000)))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_stated(converted, i):
    assert converted.get(i, set()) == list(CASES.values())[i], list(CASES)[i]


def test_empty(spark):
    assert convert_quantities(spark.createDataFrame([], "id int, text string"), "text", ["id"]).count() == 0
