import itertools
import random

import pytest

from clausewright.llm.splitting import _nodes, cut_points, split_oversized


def greedy(text, limit, overlap):
    """The same rule, one piece after the other."""
    at, kind = (x.tolist() for x in _nodes(text, limit, overlap))
    ends, end = [], 0
    while end < len(text) or not ends:
        start = max(0, end - overlap) if ends else 0
        if len(text) <= start + limit:
            ends.append(len(text))
            break
        best = None
        for k in range(4):
            c = [p for p, q in zip(at, kind) if q == k and max(end, start + (limit // 2 if k < 3 else overlap)) < p <= start + limit]
            if c:
                best = max(c)
                break
        if best is None:
            best = max(p for p in at if end < p <= start + limit)
        ends.append(best)
        end = best
    return ends


def random_text(r):
    out = []
    for _ in range(r.randint(0, 120)):
        out.append("x" * r.choice([1, 3, 7, 12, 12, 90]))
        out.append(r.choice([" ", " ", " ", ". ", "\n", "\n\n"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(25))
def test_matches_sequential_cuts(seed):
    r = random.Random(seed)
    texts = [random_text(r) for _ in range(12)] + ["", "y" * 500, "a b"]
    for t, ends in zip(texts, cut_points(texts, 60, 11)):
        assert ends.tolist() == greedy(t, 60, 11)


def test_pieces(spark):
    long = "One sentence here. " * 300
    rows = [("a", long, 1), ("a", long, 1), ("b", None, 2), ("c", "", None), ("d", "z" * 5000, 4), ("e", "short", 5), ("f", "ü" * 1800, 6)]
    p = split_oversized(spark.createDataFrame(rows, "id string, text string, piece int").withColumnRenamed("piece", "page"), "text", ["id", "page"]).toPandas()
    assert (p["piece_text"].str.len() <= 1800).all()
    for i, t in (("a", long), ("d", "z" * 5000)):
        q = p[p["id"] == i].sort_values("piece")
        assert q["piece"].tolist() == list(range(len(q)))
        assert all(b == e - 250 for b, e in zip(q["begin"][1:], q["end"]))
        assert "".join(x[250 if k else 0 :] for k, x in enumerate(q["piece_text"])) == t
    assert set(p[p["piece"] == 0]["id"]) == set("acdef")
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame(rows, "id string, text string, page int"), "text", ["id"], 10, 10)


def test_an_early_sentence_end_makes_no_short_piece():
    text = "a. " + "word " * 2000
    ends = cut_points([text], 1800, 250)[0].tolist()
    begins = [0, *(e - 250 for e in ends[:-1])]
    assert all(900 <= e - b <= 1800 for b, e in zip(begins[:-1], ends)) and all(x < y for x, y in itertools.pairwise(begins))
    assert len(ends) <= 2 + len(text) // 1545
    one = cut_points(["ab " + "x" * 5000], 1800, 250)[0].tolist()
    assert one[0] == 1800 and one[-1] == 5003
