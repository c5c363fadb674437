import itertools
import random

import pytest

from clausewright.llm.neardup import Forest, candidate_pairs, contents, expand_members, groups, jaccard, shingle_set, shortened, similar_contents, similarities, with_shingles
from clausewright.session import cut


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    out = []
    for f in range(60):
        base = [r.choice(words) for _ in range(40)]
        for v in range(4):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append((f"{f}-{v}", " ".join(t), "q " + " ".join(t) if v % 2 else None))
    out += [("same1", "a b c d e f", "x"), ("same2", "a b c d e f", "x"), ("same3", "a b c d e f", "x"), ("short1", "a b", None), ("short2", "a b", None), ("none", None, ""), (None, "a b c d e f", None)]
    return out + out[:5]


def brute(rows):
    rows = {i: (a, b) for i, a, b in rows if i is not None}
    return {(x, y) for x, y in itertools.combinations(sorted(rows), 2) if max(jaccard(shingle_set(s, 3), shingle_set(t, 3)) for s, t in zip(rows[x], rows[y])) >= 0.5}


@pytest.mark.parametrize("hot", [512, 3])
def test_recall_and_precision(spark, rows, hot):
    df = spark.createDataFrame(rows, "id string, t string, q string").selectExpr("id", "t", "q", "1 as rid", "2 as key")
    docs, members = contents(df, "id", ["t", "q"])
    pairs = cut(similar_contents(docs, ["t", "q"], 0.5, 3, hot=hot), "pairs")
    got = {tuple(r) for r in expand_members(pairs, members, "id", with_shingles(docs, ["t", "q"], 3)).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {("same1", "same2"), ("same1", "same3"), ("same2", "same3")} <= got
    g = groups(pairs, docs).toPandas()
    assert len(g) == docs.count() and g["class_id"].nunique() < len(g)


def test_nodes_over_the_bound_lose_nothing(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):  # all alike: nearly every node at the floor is over the bound
        t = list(base)
        t[r.randrange(60)] = f"x{k}"
        rows.append((f"{k:03}", " ".join(t)))
    docs, _ = contents(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    forest = Forest(0.5)
    plain, hot = ({(p["a"], p["b"], p["level"], p["differ"]) for p in candidate_pairs(docs, ["t"], 3, forest, hot=h).collect()} for h in (1000, 8))
    assert plain == hot and len(plain) == 120 * 119 / 2


def test_recall_at_the_threshold(spark):
    rows, want = [], set()
    for k in range(300):  # pairs barely over the threshold
        t = [f"a{k}i{i}" for i in range(48)]
        u = list(t)
        for i in range(5):
            u[7 * i + 4] = f"b{k}i{i}"
        assert 0.5 <= jaccard(shingle_set(" ".join(t), 3), shingle_set(" ".join(u), 3)) <= 0.56
        want.add((f"{k}a", f"{k}b"))
        rows += [(f"{k}a", " ".join(t)), (f"{k}b", " ".join(u))]
    docs, members = contents(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    got = {tuple(r) for r in expand_members(similar_contents(docs, ["t"], 0.5, 3), members, "id", docs.select("rid")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_prefix_is_shortened_to_the_target(spark):
    f = Forest(0.5)
    assert f.floor == 3 and f.recall(0.5, 3) >= 0.9 > f.recall(0.5, 4)
    assert Forest(0.8).floor > 3
    pairs = lambda *rows: spark.createDataFrame(rows, "a long, b long, level int, differ int")
    assert shortened(pairs(*[(i, i + 1, 6, 2) for i in range(50)]), f, 0.99) == 6  # all nearly equal: full depth finds them
    assert shortened(pairs(*[(i, i + 1, 3 + i % 4, 15) for i in range(50)]), f, 0.99) == 3
    assert shortened(pairs(), f, 0.99) == 3


def test_labels_of_long_chains(spark):
    n = 200
    docs = spark.range(n).selectExpr("id as rid")
    g = groups(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), docs).collect()
    assert {r["class_id"] for r in g} == {0} and sorted(r["links"] for r in g) == [1, 1, *[2] * (n - 2)]


def test_empty(spark):
    docs, members = contents(spark.createDataFrame([], "id string, t string"), "id", ["t"])
    assert similar_contents(docs, ["t"]).count() == 0


@pytest.mark.parametrize("words", [3, 40, 5000])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_similarities_are_exact(words, width):
    r = random.Random(words + width)
    some = [None, "", "one", "a b", *(" ".join(f"w{r.randrange(words)}" for _ in range(r.randint(0, 60))) for _ in range(150))]
    some += [t + " more" for t in some if t]
    a, b = ([r.choice(some) for _ in range(500)] for _ in range(2))
    want = [jaccard(shingle_set(x, width), shingle_set(y, width)) for x, y in zip(a, b)]
    assert similarities(a, b, width).tolist() == pytest.approx(want, abs=0)
    assert similarities([], [], width).tolist() == []
