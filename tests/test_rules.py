"""The rules of the reference, written out once more."""

import re

from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators import rules as ru

CATEGORIES = (
    ("Testing", r"\b(test|testing|fat|commissioning)\b"),
    ("Documentation", r"\b(document|drawing|manual|report|submit)\b"),
    ("Communications", r"\b(scada|iec\s*61850|dnp3|modbus|ethernet|fiber|communication)\b"),
    ("Panel Construction", r"\b(panel|enclosure|wiring|terminal|nameplate)\b"),
    ("Protection and Control", r"\b(relay|protection|trip|breaker|interlock|bus|feeder)\b"),
    ("Electrical Interface", r"\b(ct|vt|current|voltage|dc|battery|burden|contact|input|output)\b"),
)
TEXTS = ["Submit a report.", "SCADA feeder", "the wiring of the relay", "current and trip", "network router cabinet", "inspection", "control of the DC battery", "drawings", "IEC 61850 bus", "latest", "", "burden of the CT"]


def test_category(spark):
    want = {t: next((c for c, p in CATEGORIES if re.search(p, t, re.IGNORECASE)), "Technical") for t in TEXTS}
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert {r["t"]: r["c"] for r in d.select("t", ru.first_match(F.col("t"), ru.CATEGORY, "Technical").alias("c")).collect()} == want


def test_technical_vocabulary(spark):
    terms = "drawing documentation manual training commissioning enclosure nameplate contact input output frequency temperature voltage current accuracy burden relay".split()
    d = spark.createDataFrame([(t,) for t in [*terms, "drawings", "price"]], "t string")
    assert {r["t"] for r in d.where(tx.has(F.col("t"), tx.any_word(tx.TECHNICAL_TERMS))).collect()} == set(terms)
    assert d.select(tx.page_signals(F.col("t"))["technical"].alias("n")).groupBy().sum("n").first()[0] == 1


READINGS = {
    "It sbau and sltall, sl1all": "It shall and shall, shall", "lEDs by JEC 61850 and !EC61850, JEC 9": "IED by IEC 61850 and IEC61850, JEC 9", "meglng mcging ench Md md": "merging merging each and md", "HM! dalll nil ran": "HMI data all run",
    "subslntion e!eclrooics sy.tcm sy itcm": "substation electronic file system system", "confonn systc~ hyEGAT": "conform system by EGAT", "standard lo coordinate lcle protection niong": "standard to coordinate teleprotection along",
    "cxisliog hardcopyand digiL'll IIMI": "existing hardcopy and digital HMI", "SCD mes and cid  mes": "SCD files and cid files", "programmable:  x": "programmable x",
}


def test_repairs_and_garble(spark):
    d = spark.createDataFrame([(t,) for t in [*READINGS, "a!b", "swithcing", "sound; text"]], "t string")
    got = {r["t"]: (r["x"], r["g"]) for r in d.select("t", tx.repair(F.col("t")).alias("x"), tx.garbled(F.col("t")).alias("g")).collect()}
    assert {t: got[t][0] for t in READINGS} == READINGS
    assert [got[t][1] for t in ("a!b", "swithcing", "sound; text", "HM! dalll nil ran")] == [True, True, False, True]
