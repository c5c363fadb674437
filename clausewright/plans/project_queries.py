"""Queries of the general problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.nested import LISTS, TARGETS, flat_list, flat_table, nested_nodes, node_paths
from clausewright.operators.orphans import PROJECT_KEYS, orphan_cascade, orphan_report
from clausewright.operators.units import convert_quantities
from clausewright.session import table

JSON_FIELDS = [("assessments", "evidence_json"), ("assessments", "alternate_json"), ("solutions", "solution_json")]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All JSON objects with their paths."""
    return _all([node_paths(table(spark, sf_dir, t), "id", c, t) for t, c in JSON_FIELDS]).distinct()


def p1_table(name: str):
    """Query of one flat table over the three JSON fields, once per record and object."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _all([nested_nodes(table(spark, sf_dir, t), "id", c) for t, c in JSON_FIELDS])
        return (flat_list if name in LISTS else flat_table)(nodes, name).distinct()

    return run


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_cascade({n: table(spark, sf_dir, n) for k in PROJECT_KEYS for n in (k.child, k.parent)}, PROJECT_KEYS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows without a valid parent: what the cascade reports as direct."""
    return _orphans(spark, sf_dir).where("kind = 'direct'").select("table_name", "row_id").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return orphan_report(_orphans(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated quantities in thousandths of the common unit."""
    r = table(spark, sf_dir, "requirements").select(F.lit("requirements").alias("table_name"), F.col("id").alias("row_id"), F.col("requirement_text").alias("text"))
    e = table(spark, sf_dir, "product_manual_evidence").select(F.lit("product_manual_evidence").alias("table_name"), F.col("id").alias("row_id"), "text")
    q = convert_quantities(r.unionByName(e), "text", ["table_name", "row_id"])
    return q.select("table_name", "row_id", "quantity", F.bround(F.col("common_value") * 1000).cast("long").alias("value_milli")).distinct()


def queries() -> dict:
    """All queries of this module."""
    return {"p1_found": p1_found, **{f"p1_{n}": p1_table(n) for n in [*TARGETS, *LISTS]}, "p4_found": p4_found, "p4_report": p4_report, "p7_found": p7_found}


def _objects_sql(t: str, c: str) -> str:
    whole = f"case when json_valid({c}) then case when json_type({c}) = 'VARCHAR' then json_extract_string({c}, '$') else {c} end end"
    return f"""select '{t}' as table_name, rid as row_id, '{c}' as field_name, replace(n.fullkey, '"', '') as node_path
        from (select distinct id as rid, {whole} as j from {t}) s, json_tree(case when json_valid(j) then j else '[]' end) n where n.type = 'OBJECT'"""


def _text_sql(value: str) -> str:
    """The text of a member: of objects and arrays their JSON without spaces, members in order of their names."""
    one = "list_aggregate(list_transform(list_sort(json_keys({0})), lambda k: '\"' || k || '\":' || json_extract({0}, '$.\"' || k || '\"')), 'string_agg', ',')"
    whole = lambda x: f"regexp_replace({x}, '(\\d)\\.0+([,\\]}}])', '\\1\\2', 'g')"  # noqa: E731  # 421.0 and 421 are one number
    return f"case json_type({value}) when 'NULL' then null when 'OBJECT' then {whole("'{' || coalesce(" + one.format(f'json({value})') + ", '') || '}'")} when 'ARRAY' then {whole(f'json({value})::varchar')} else json_extract_string({value}, '$') end"


def _flat_sql(name: str) -> str:
    """One target table, from the tree of every value."""
    pattern, columns = TARGETS[name]
    parts = []
    for t, c in JSON_FIELDS:
        whole = f"case when json_valid({c}) then case when json_type({c}) = 'VARCHAR' then json_extract_string({c}, '$') else {c} end end"
        parts.append(f"select rid as row_id, '{c}' as field_name, replace(n.fullkey, '\"', '') as path, n.value as v from (select distinct id as rid, {whole} as j from {t}) s, json_tree(case when json_valid(j) then j else '[]' end) n where n.type = 'OBJECT'")
    has = lambda ms: "(" + " or ".join(f"json_extract(v, '$.{m}') is not null" for m in ms) + ")"
    members = [m for ms in columns.values() for m in ms]
    root = {"solution": "field_name = 'solution_json'", "alternate": f"(field_name = 'alternate_json' or {has(members)})", "citation": f"((field_name = 'evidence_json' and path <> '$') or {has(members)})",
        "evidence_wrapper": f"field_name = 'evidence_json' and path = '$' and ({has(['version', 'evidence'])} or not {has(['file_name', 'fileName', 'quote', 'location', 'score'])})"}.get(name, has(members))
    got = ", ".join("coalesce(" + ", ".join(_text_sql(f"json_extract(v, '$.{m}')") for m in ms) + f") as {c}" for c, ms in columns.items())
    # this dialect has no look-behind: options of bills are taken out by name
    fits = r"regexp_matches(shape, '(^\$|\.options)$') and not regexp_matches(shape, '\.bill_of_material\.options$')" if name == "alternate" else f"regexp_matches(shape, '{pattern}')"
    return rf"""select distinct row_id, field_name, path as node_path, case when bare <> '$' then regexp_replace(bare, '\.[^.]*$', '') end as parent_path, try_cast(regexp_extract(path, '\[(\d+)\]$', 1) as integer) as position, {got}
        from (select *, regexp_replace(path, '\[[0-9]+\]', '', 'g') as shape, regexp_replace(path, '(\[[0-9]+\])*$', '') as bare from ({" union all ".join(parts)})) where {fits} and (shape <> '$' or {root})"""


def _list_sql(name: str) -> str:
    """One table of plain values, from the root objects that have the member."""
    _, member, column = LISTS[name]
    parts = []
    for t, c in JSON_FIELDS:
        whole = f"case when json_valid({c}) then case when json_type({c}) = 'VARCHAR' then json_extract_string({c}, '$') else {c} end end"
        parts.append(f"select id as row_id, '{c}' as field_name, json_extract(j, '$.{member}') as m from (select distinct id, {whole} as j from {t}) where json_valid(j) and json_type(j) = 'OBJECT'")
    return f"""with m as (select * from ({" union all ".join(parts)}) where json_type(m) <> 'NULL'), e as (select row_id, field_name, i, json_extract(m, '$[' || i || ']') as v from m, lateral (select unnest(generate_series(0, cast(json_array_length(m) as bigint) - 1)) as i) where json_type(m) = 'ARRAY')
        select distinct row_id, field_name, '$.{member}[' || i || ']' as node_path, '$' as parent_path, cast(i as integer) as position, {_text_sql('v')} as {column} from e union select row_id, field_name, '$.{member}', '$', null, {_text_sql('m')} from m where json_type(m) <> 'ARRAY'"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries of this module that SQL can express."""
    key = "nullif(lower(trim({0}, chr(9)||chr(10)||chr(13)||' '||chr(160))), '')"
    direct = []
    for k in PROJECT_KEYS:
        ref, pk, mark = key.format(f"c.{k.column}"), key.format("p.id"), key.format(f"p.{k.parent_status}")
        direct.append(f"""select distinct '{k.child}' as table_name, c.id as row_id, {ref} as ref, c.{k.child_time} as seen from {k.child} c where {ref} is not null and not exists (
            select 1 from {k.parent} p where {pk} = {ref} and coalesce({mark}, '') <> 'deleted' and not coalesce(p.{k.parent_time} > c.{k.child_time}, false))""")
    orphans = " union all ".join(direct)
    ref = key.format("a.requirement_id")
    report = f"""with d as ({orphans}), i as (select distinct 'assessments' as table_name, a.id as row_id, a.created_at as seen from assessments a
        where {ref} in (select {key.format('row_id')} from d where table_name = 'requirements') and a.id not in (select row_id from d where table_name = 'assessments'))
        select table_name, strftime(seen, '%Y-%m') as period, kind, count(distinct row_id) as orphans from (select table_name, row_id, seen, 'direct' as kind from d union all select table_name, row_id, seen, 'inherited' from i) group by all"""
    return {
        **{f"p1_{n}": _flat_sql(n) for n in TARGETS},
        **{f"p1_{n}": _list_sql(n) for n in LISTS},
        "p1_found": "select distinct * from (" + " union all ".join(_objects_sql(t, c) for t, c in JSON_FIELDS) + ")",
        "p4_found": f"select distinct table_name, row_id from ({orphans})",
        "p4_report": report,
    }
