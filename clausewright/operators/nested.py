"""Deeply nested JSON columns into related flat tables.

Method: one higher-order projection per record.  A fold over nested
`transform` calls walks the parsed value level by level; every step attaches
the path, the nearest enclosing object and the array index to the members it
opens, `flatten` joins the levels, and one `inline` per target table emits its
rows.  No shuffle, no Python.

Defined results: null, blank or malformed text gives no rows (nor does text
after the JSON value); a JSON string that is the whole value and holds a JSON
text stands for that text (repeatedly); NaN is a number; array and object
members may have any shape; repeated records give their rows once; extra
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPTIONS = "map('mode','PERMISSIVE','allowSingleQuotes','false','allowNonNumericNumbers','true')"
_ITEM = "struct<path:string,above:string,name:string,idx:int,v:variant>"


def _parse(text: str) -> str:
    """SQL: the variant of a whole well-formed JSON text, else null.

    The parser stops after the first value, so the text is parsed as the first
    of two array elements: anything left over then makes the array malformed or
    gives it another length.
    """
    wrapped = f"try_variant_get(from_json(concat('[', {text}, ',0]'), 'variant', {_OPTIONS}), '$', 'array<variant>')"
    return f"get(get(filter(array({wrapped}), a -> size(a) = 2), 0), 0)"


def _opened(text: str) -> str:
    """SQL: like _parse, and JSON texts inside a whole-value JSON string are opened, however often they were wrapped.

    Every wrapping more than doubles the marks around a value, so the logarithm
    of the length bounds the steps; a text that is no JSON string takes none.
    """
    steps = f"sequence(1, cast(ceil(log2(length({text}) + 1)) as int))"
    inner = f"aggregate({steps}, {text}, (t, k) -> if(t rlike '^[ \\\\t\\\\n\\\\r]*\"', try_variant_get({_parse('t')}, '$', 'string'), t))"
    return _parse(f"if({text} rlike '^[ \\\\t\\\\n\\\\r]*\"', {inner}, {text})")


def parsed(column: str) -> Column:
    """The variant of a whole well-formed JSON text, else null; NaN is a number."""
    return F.expr(_parse(f"`{column}`"))


_OBJ = "try_variant_get(n.v, '$', 'map<string,variant>')"
_ARR = "try_variant_get(n.v, '$', 'array<variant>')"
_NONE = f"cast(array() as array<{_ITEM}>)"


def nodes_column(text: str) -> Column:
    """array<struct<path, above, name, idx, v>> of all objects of a JSON text, in level order.

    above: path of the nearest enclosing object; name: member name, for array
    elements that of the array; idx: innermost array index.  The number of
    steps is bounded by the count of opening brackets of the record itself.
    """
    steps = f"sequence(0, length({text}) - length(translate({text}, '{{[', '')) + 1)"
    opened = f"transform(acc.f, n -> struct(n as n, {_OBJ} as o, {_ARR} as a))"
    below = f"""flatten(transform(z, x -> concat(
        coalesce(transform(map_entries(x.o), m -> struct(concat(x.n.path, '.', m.key) as path, x.n.path as above, m.key as name, cast(null as int) as idx, m.value as v)), {_NONE}),
        coalesce(transform(x.a, (m, i) -> struct(concat(x.n.path, '[', i, ']') as path, x.n.above as above, x.n.name as name, i as idx, m as v)), {_NONE}))))"""
    found = "transform(filter(z, x -> x.o is not null), x -> x.n)"
    step = f"""transform(array({opened}), z -> struct(
        cast(concat(acc.out, {found}) as array<{_ITEM}>) as out, cast({below} as array<{_ITEM}>) as f))[0]"""
    return F.expr(f"""aggregate({steps},
        struct({_NONE} as out, cast(array(struct('$' as path, cast(null as string) as above, cast(null as string) as name, cast(null as int) as idx, {_opened(text)} as v)) as array<{_ITEM}>) as f),
        (acc, s) -> if(size(acc.f) = 0, acc, {step}),
        acc -> acc.out)""")


def nested_nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(row_id, field_name, nodes) of the records that have a text in the column."""
    base = df.select(F.col(f"`{key}`").alias("row_id"), F.lit(column).alias("field_name"), F.col(f"`{column}`").alias("__text")).where("__text is not null")
    return base.select("row_id", "field_name", nodes_column("__text").alias("nodes"))


def node_paths(df: DataFrame, key: str, column: str, table_name: str) -> DataFrame:
    """One row per object: (table_name, row_id, field_name, node_path)."""
    return nested_nodes(df, key, column).select(F.lit(table_name).alias("table_name"), "row_id", "field_name", F.expr("inline(transform(nodes, n -> struct(n.path as node_path)))"))


#: Target tables: pattern of the path without its array indices, and columns with the member names they may have.
TARGETS: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "solution": (r"^\$$", {"name": ("name",), "summary": ("summary",), "version": ("version",)}),
    "evidence_wrapper": (r"^\$$", {"version": ("version",)}),
    "citation": (r"(^\$|\.evidence)$", {"file_name": ("file_name", "fileName"), "quote": ("quote",), "location": ("location",), "score": ("score",)}),
    "citation_location": (r"\.location$", {"page": ("page",), "bbox": ("bbox",)}),
    "gate": (r"\.gate$", {"lexical_overlap": ("lexical_overlap",), "prematch_score": ("prematch_score",), "material_overlap": ("material_overlap",)}),
    "gate_token": (r"\.tokens$", {"token": ("token",), "kind": ("kind",)}),
    "token_span": (r"\.spans$", {"start": ("start",), "end": ("end",)}),
    "cited_table": (r"\.table$", {"header": ("header",), "rows": ("rows",)}),
    "table_cell": (r"\.rows$", {"text": ("text",)}),
    "alternate": (r"(^\$|(?<!\.bill_of_material)\.options)$", {"product_name": ("product_name",), "rationale": ("rationale",)}),
    "bill_item": (r"\.bill_of_material$", {"item": ("item",), "product": ("product",), "quantity": ("quantity",), "purpose": ("purpose",)}),
    "item_option": (r"\.bill_of_material\.options$", {"code": ("code",), "count": ("count",)}),
    "option_interface": (r"\.interfaces$", {"name": ("name",), "protocol": ("protocol",)}),
    "cohesion_check": (r"\.cohesion_checks$", {"interface": ("interface",), "status": ("status",), "finding": ("finding",)}),
    "check_reference": (r"\.references$", {"requirement_id": ("requirement_id",)}),
    "deviation": (r"\.deviations$", {"note": ("note",)}),
    "clause": (r"\.clauses$", {"no": ("no",), "name": ("name",)}),
}

#: Objects of the root level (the root, or elements of a root array) are told by their column, where it is known, else by their members.
_ROOT_OF = {"solution": "field_name = 'solution_json'", "alternate": "field_name = 'alternate_json'", "citation": "(field_name = 'evidence_json' and n.path <> '$')"}
#: Arrays of plain values with a table of their own: pattern of the path of the object that has them, member and column.
LISTS: dict[str, tuple[str, str, str]] = {"assumption": (r"^\$$", "assumptions", "text")}
_SHAPE = r"regexp_replace(n.path, r'\[[0-9]+\]', '')"


def _has(members: Sequence[str]) -> str:
    return "(" + " or ".join(f"""variant_get(n.v, '$["{m}"]', 'variant') is not null""" for m in members) + ")"


def _belongs(name: str, columns: Mapping[str, Sequence[str]]) -> str:
    """SQL: whether an object whose path fits is of the table; below the root the path alone decides."""
    if name == "evidence_wrapper":
        cited = [m for members in TARGETS["citation"][1].values() for m in members]
        return f"field_name = 'evidence_json' and n.path = '$' and ({_has(['version', 'evidence'])} or not {_has(cited)})"
    if name == "solution":
        return _ROOT_OF[name]
    has = _has([m for members in columns.values() for m in members])
    return f"({_SHAPE} <> '$' or {_ROOT_OF.get(name, 'false')} or {has})"


def flat_table(nodes: DataFrame, name: str, targets: Mapping[str, tuple[str, dict[str, Sequence[str]]]] = TARGETS) -> DataFrame:
    """One target table: (row_id, field_name, node_path, parent_path, position, columns...), by one inline.

    parent_path is the node_path of the enclosing object in whichever target
    table holds it.  Members of another type are given as their JSON text.
    """
    pattern, columns = targets[name]
    got = ", ".join("coalesce(" + ", ".join(f"""try_variant_get(n.v, '$["{m}"]', 'string')""" for m in members) + f") as `{c}`" for c, members in columns.items())
    inline = f"inline(transform(filter(nodes, n -> {_SHAPE} rlike r'{pattern}' and {_belongs(name, columns)}), n -> struct(n.path as node_path, n.above as parent_path, n.idx as position, {got})))"
    return nodes.select("row_id", "field_name", F.expr(inline))


def flat_list(nodes: DataFrame, name: str) -> DataFrame:
    """A target table with one row per element of an array of plain values; a value that is no array is its only element, without position."""
    pattern, member, column = LISTS[name]
    value = f"""variant_get(n.v, '$["{member}"]', 'variant')"""
    item = lambda step, i: f"struct(concat(n.path, '.{member}'{step}) as node_path, n.path as parent_path, {i} as position, try_variant_get(v, '$', 'string') as `{column}`)"
    listed = f"transform(try_variant_get({value}, '$', 'array<variant>'), (v, i) -> {item(", '[', i, ']'", 'i')})"
    alone = f"transform(filter(array({value}), v -> not is_variant_null(v)), v -> {item('', 'cast(null as int)')})"
    return nodes.select("row_id", "field_name", F.expr(f"inline(flatten(transform(filter(nodes, n -> {_SHAPE} rlike r'{pattern}' and {value} is not null), n -> coalesce({listed}, {alone}))))"))
