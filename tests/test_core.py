import difflib
import random

from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.functions.vectors import top_k
from clausewright.operators import context as cx
from clausewright.operators import dedupe as dd
from clausewright.operators import state as st
from clausewright.sources import exports as ex
from clausewright.sources import pages as pg


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, " A  B\n", tx.fold) == "a b"
    assert one(spark, "SI sbaU configure each JED", tx.repair) == "SI shall configure each IED"
    assert one(spark, "One. Two; (Three) no. 5", tx.sentences) == ["One.", "Two;", "(Three) no.", "5"]
    assert set(one(spark, "The relay shall have 5 V relay", tx.tokens)) == {"relay", "have"}
    assert set(one(spark, "115 V, IEC 61850 and 50 %", tx.material_tokens)) == {"115v", "iec61850", "50"}
    assert one(spark, "naÃ¯ve", tx.repair_mojibake) == "naïve"
    assert one(spark, "a b/c?.pdf", tx.safe_name) == "a-b-c-.pdf"
    assert one(spark, None, tx.fold) is None and one(spark, "", tx.fold) == ""


def test_hard_values(spark):
    df = spark.createDataFrame([(["115v"], ["115v", "x"]), (["115v"], ["230v"]), ([], []), (["iec61850", "5v"], ["iec61850"])], "n array<string>, h array<string>")
    assert [r[0] for r in df.select(tx.hard_values(F.col("n"), F.col("h"))).collect()] == [True, False, True, False]


def test_best_quote(spark):
    df = spark.createDataFrame([("One thing. The relay trips at 5 V. The relay.\n\nOther relay trips.", "relay trips at")], "t string, n string")
    assert df.select(tx.best_quote(F.col("t"), F.col("n"))).first()[0] == "The relay trips at 5 V."
    assert df.select(tx.best_quote(F.col("t"), F.col("n"), 12)).first()[0] == "The relay"


def test_greedy_near_duplicates(spark):
    r = random.Random(2)
    base = ["the relay shall trip the feeder at once when the bus fails", "the panel shall be rated 115 v for the feeder duty", "the panel shall be rated 230 v for the feeder duty"]
    rows = []
    for i in range(40):
        t = r.choice(base)
        if r.random() < 0.5:
            t = t.replace("the", "tne", 1)
        rows.append((i, "c", i, t))
    got = {x["id"]: x["kept"] for x in dd.greedy_near_duplicates(spark.createDataFrame(rows, "id int, c string, seq int, t string"), ["c"], "t", ["seq"], "id").collect()}
    kept = []
    for i, _, _, t in rows:
        nums = [w for w in t.split() if w.isdigit()]
        like = any(n == nums and (t == k or difflib.SequenceMatcher(None, t, k).ratio() >= 0.965) for k, n in kept)
        assert got[i] == (not like)
        if not like:
            kept.append((t, nums))


def test_positional_match(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    old = spark.createDataFrame([("a", 5, "x"), ("b", 1, "y"), ("b", 2, "z")], "k string, p int, v string")
    assert [(r["k"], r["o"], r["v"]) for r in dd.positional_match(new, old, ["k"], ["o"], ["p"]).orderBy("k", "o").collect()] == [("a", 1, "x"), ("a", 2, None), ("b", 1, "y")]


def test_context_is_bounded(spark):
    rows = [(i, "p", "s", ["Compliant", "unknown "][i % 2], f"o{i % 15:02d}", "prod", f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "n int, p string, s string, decision string, o string, product string, t string")
    c = cx.solution_context(df, ["p", "s"], "n", "o", "product", "t").first()
    assert (c["requirements"], c["compliant"], c["unknown"]) == (40, 20, 20)
    assert len(c["objects"].split("|")) == 12 and c["samples"] == "text 0|text 1|text 2|text 3" and len(c["unresolved"].split("|")) == 6


def test_percent(spark):
    df = spark.createDataFrame([(1, 8), (1, 200), (3, 200), (0, 0)], "a int, b int")
    assert [tuple(r) for r in df.select(cx.half_up_percent(F.col("a"), F.col("b")), cx.half_even_percent(F.col("a"), F.col("b"))).collect()] == [(13, 12), (1, 0), (2, 2), (0, 0)]


def test_state(spark):
    a = spark.createDataFrame([("d", 1, "x"), ("d", 2, None)], "k string, i int, t string")
    same = st.fingerprint(a.orderBy(F.desc("i")), ["k"], ["i", "t"]).first()
    assert st.fingerprint(a, ["k"], ["i", "t"]).first() == same
    assert st.fingerprint(a.na.fill(""), ["k"], ["i", "t"]).first() != same
    assert st.pending(a, a.where("i = 1"), ["k", "i"]).count() == 1
    assert st.guard(a, a.where("i = 9"), ["k"]).count() == 0
    up = st.upsert(a, spark.createDataFrame([("d", 2, "new", 1)], "k string, i int, t string, extra int"), ["k", "i"])
    assert {(r["i"], r["t"]) for r in up.collect()} == {(1, "x"), (2, "new")}


def test_top_k(spark):
    r = random.Random(4)
    v = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = e.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in top_k(q, e, 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i in range(5):
        want = sorted(range(60), key=lambda j: (-cos(v[i][1], v[j][1]), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


def test_pages_and_exports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\nline\f\fpage three")
    p = pg.read_pages(spark, str(tmp_path / "*.txt"))
    assert [(r["page_number"], r["text"]) for r in p.orderBy("page_number").collect()] == [(1, "page one\nline"), (3, "page three")]
    assert pg.blocks(p, "text", ["page_number"]).count() == 3
    d = spark.createDataFrame([(1, 'say "hi", you', None)], "i int, s string, n string")
    ex.write_csv(d, str(tmp_path / "c"))
    lines = [x for f in (tmp_path / "c").glob("*.csv") for x in f.read_text().splitlines()]
    line = next(x for x in lines if "hi" in x)
    assert line.startswith('"1","say ""hi"", you"')
    ex.write_version(d, str(tmp_path / "t"), "1")
    ex.write_version(d.withColumn("i", F.lit(2)), str(tmp_path / "t"), "2")
    assert ex.read_current(spark, str(tmp_path / "t")).first()["i"] == 2
    ex.write_version(d.withColumn("i", F.lit(10)), str(tmp_path / "t"), "10")
    assert ex.read_current(spark, str(tmp_path / "t")).first()["i"] == 10
    boxes = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.0, 3.0, 5.0, 4.0]), (None, [1.0, 1.0, 1.0, 1.00049])], "a array<double>, b array<double>")
    assert [r[0] for r in boxes.select(pg.bbox_union(F.col("a"), pg.bbox(F.col("b")))).collect()] == [[0.0, 2.0, 5.0, 4.0], [1.0, 1.0, 1.0, 1.0]]
    t = spark.createDataFrame([(["h", None], [["a", "b"], ["", None]])], "h array<string>, r array<array<string>>")
    assert t.select(pg.table_text(F.col("h"), F.col("r"))).first()[0] == "h | \na | b"
