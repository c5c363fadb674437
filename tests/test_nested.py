import json

from clausewright.operators.nested import LISTS, TARGETS, flat_list, flat_table, nested_nodes, node_paths

DOCS = [
    ("a", '{"x": [1, {"y": {}}, [{"z": null}]], "k.k": {"b": NaN}}'),
    ("b", '"[{\\"q\\": {}}]"'),
    ("c", '{"a": 1'),
    ("d", '{"a": 1} tail'),
    ("e", None),
    ("f", ""),
    ("g", "null"),
    ("h", "[]"),
    ("i", '{"a": 1}][{"b": 2}'),
    ("a", '{"x": [1, {"y": {}}, [{"z": null}]], "k.k": {"b": NaN}}'),
]


def expected(text):
    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
    except (TypeError, ValueError):
        return set()
    out = set()

    def walk(v, p):
        if isinstance(v, dict):
            out.add(p)
            for k, x in v.items():
                walk(x, f"{p}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{p}[{i}]")

    walk(v, "$")
    return out


def test_paths_match_a_plain_walk(spark):
    df = spark.createDataFrame(DOCS, "id string, j string").selectExpr("id", "j", "1 as row_id", "2 as nodes")
    got = {(r["row_id"], r["node_path"]) for r in node_paths(df, "id", "j", "t").collect()}
    assert got == {(i, p) for i, t in DOCS for p in expected(t)}


def test_flat_tables_keep_parents(spark):
    doc = json.dumps([{"file_name": "f", "quote": "q", "gate": {"lexical_overlap": 0.5, "tokens": [{"token": "t", "kind": "unit", "spans": [{"start": 0, "end": 3}]}]}}])
    n = nested_nodes(spark.createDataFrame([("r", doc)], "id string, j string"), "id", "j")
    span = flat_table(n, "token_span").first()
    assert (span["node_path"], span["parent_path"], span["position"]) == ("$[0].gate.tokens[0].spans[0]", "$[0].gate.tokens[0]", 0)
    token = flat_table(n, "gate_token").first()
    assert token["node_path"] == span["parent_path"] and token["token"] == "t"
    assert flat_table(n, "citation").first()["file_name"] == "f"
    assert all(flat_table(n, t).count() >= 0 for t in TARGETS)


def test_texts_wrapped_many_times(spark):
    text, rows = '{"a": {}}', []
    for n in range(7):
        rows.append((f"w{n}", text))
        text = " " + json.dumps(text)
    got = {(r["row_id"], r["node_path"]) for r in node_paths(spark.createDataFrame(rows, "id string, j string"), "id", "j", "t").collect()}
    assert got == {(i, p) for i, _ in rows for p in ("$", "$.a")}


def test_empty_table(spark):
    assert node_paths(spark.createDataFrame([], "id string, j string"), "id", "j", "t").count() == 0


NESTED = [
    ("s", "solution_json", {"name": "N", "summary": "S", "assumptions": ["one", None, {"x": 1}], "bill_of_material": [{"options": [{"interfaces": [{"name": "i"}]}]}], "deviations": [{"clauses": [{"no": "1"}]}]}),
    ("t", "solution_json", {"assumptions": "alone", "cohesion_checks": [{"references": [{"evidence": [{"gate": {"tokens": [{"spans": [{"start": 0}]}]}}]}]}]}),
    ("u", "solution_json", {"name": None, "assumptions": None}),
    ("w", "evidence_json", {"version": 2, "evidence": [{"gate": {"tokens": []}}, {"table": {"rows": [[{"text": "c"}]]}}]}),
    ("v", "evidence_json", {"evidence": [{"quote": "q"}]}),
    ("x", "evidence_json", [{"gate": {"lexical_overlap": 0.5}}, {"quote": "q"}]),
    ("y", "evidence_json", {"quote": "q", "gate": {}}),
    ("a", "alternate_json", {"options": [{"evidence": [{"quote": "q"}]}]}),
]


def test_every_parent_is_in_a_table(spark):
    rows = {n: [] for n in [*TARGETS, *LISTS]}
    for field in sorted({f for _, f, _ in NESTED}):
        d = spark.createDataFrame([(i, json.dumps(v)) for i, f, v in NESTED if f == field], f"id string, {field} string")
        nodes = nested_nodes(d, "id", field)
        for n in rows:
            rows[n] += (flat_list if n in LISTS else flat_table)(nodes, n).collect()
    there = {(r["row_id"], r["node_path"]) for rs in rows.values() for r in rs}
    assert {(r["row_id"], r["parent_path"]) for rs in rows.values() for r in rs if r["parent_path"] is not None} <= there
    assert {(i, p) for i, _, v in NESTED for p in expected(json.dumps(v))} <= there
    assert {(r["row_id"], r["name"], r["summary"]) for r in rows["solution"]} == {("s", "N", "S"), ("t", None, None), ("u", None, None)}
    assert {(r["row_id"], r["version"]) for r in rows["evidence_wrapper"]} == {("w", "2"), ("v", None)}
    assert {(r["row_id"], r["node_path"], r["position"], r["text"]) for r in rows["assumption"]} == {("s", "$.assumptions[0]", 0, "one"), ("s", "$.assumptions[1]", 1, None), ("s", "$.assumptions[2]", 2, '{"x":1}'), ("t", "$.assumptions", None, "alone")}
    assert {(r["row_id"], r["node_path"]) for r in rows["alternate"]} == {("a", "$"), ("a", "$.options[0]")}
    assert {r["row_id"] for r in rows["citation"] if r["node_path"] == "$"} == {"y"}
