"""Queries of the pipelines: candidates, evidence, edits, jobs, orders and exports, with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.functions.fixed import ACCEPTED, CATEGORIES, GARBLED, MANDATORY, MODAL, NUMBERED_LINE, OBLIGATION, STANDARDS, STOPWORDS, TABLE_UNITS, TECHNICAL, TECHNICAL_TERMS, UNITS, VALUES
from clausewright.operators import candidates as ca
from clausewright.operators import context as cx
from clausewright.operators import evidence as ev
from clausewright.operators import records as re
from clausewright.operators import rules as ru
from clausewright.operators import sections as se
from clausewright.operators import state as st
from clausewright.operators.nested import parsed
from clausewright.operators.order import fixed_batches, global_position
from clausewright.plans.reference_queries import _ASSESSED, _DECISION, _MAN, _REQ, _SENTENCES, _ass, _complete_sql, _fold_sql, _has_sql, _manual, _norm_sql, _obliged_sql, _repair_sql, _req, _rows
from clausewright.session import norm_key
from clausewright.sources import pages as pg

_SQL: dict[str, str] = {}
_Q: dict = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    """All queries of this module."""
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return dict(_SQL)


# ---------------------------------------------------------------- candidates
def _pages(s: SparkSession, d: str) -> DataFrame:
    """(document_id, page_number, id, text): the quotes of requests and the manual records."""
    r = _req(s, d, "document_id", "page_number", "id", "source_quote").withColumnRenamed("source_quote", "text")
    return r.unionByName(_manual(s, d, "document_id", "page_number", "id", "text")).withColumn("page_number", F.coalesce("page_number", F.lit(0)))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """The paragraphs of records as blocks of their pages, with the section that the record itself gives."""
    m = _pages(s, d).where("text is not null")
    b = m.select("document_id", "page_number", "id", F.col("text").alias("page_text"), F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("n", "__b")).withColumn("text", tx.normalize(F.col("__b")))
    none = F.lit(None).cast("string")
    section = se.resolve_section(none, none, F.col("page_text"), F.col("text"), F.col("page_number"))
    return b.select("document_id", "page_number", F.struct("id", "n").alias("block"), "text", section.alias("section"), F.lit(None).cast("array<double>").alias("bbox"))


def _tables(s: SparkSession, d: str) -> DataFrame:
    """The lines with bars of a record as one table of its page."""
    m = _pages(s, d).where("text like '%|%'")
    lines = F.transform(F.filter(F.split("text", r"\r?\n"), lambda x: x.contains("|")), lambda x: F.split(x, r"\|"))
    return m.select("document_id", "page_number", F.struct("id", F.lit(0).alias("n")).alias("block"), F.get(lines, F.lit(0)).alias("header"), F.slice(lines, F.lit(2), F.size(lines)).alias("rows"),
        F.concat(F.lit("RFQ page "), F.col("page_number").cast("string")).alias("section"), F.lit(None).cast("array<double>").alias("bbox"))


def _found(s: SparkSession, d: str) -> DataFrame:
    return ca.merged_candidates(ca.explicit_candidates(_blocks(s, d)), ca.table_candidates(_tables(s, d)))


_CATEGORY = "case " + " ".join(f"when {_has_sql('q', w)} then '{c}'" for c, w in CATEGORIES) + " else 'Technical' end"
_NUMBERED = f"""select document_id, page_number, 'p' || page_number || '-' || kind || '-' || (row_number() over (partition by document_id, page_number order by id, n, k) - 1) as candidate_id, kind as candidate_type, section, q as source_quote,
    {_CATEGORY} as category, case when {_has_sql('q', MANDATORY)} then 'Mandatory' else 'Preferred' end as criticality, case when kind = 'explicit' then 92 else 65 end as confidence, id, n, k"""
_PAGES = f"(select document_id, page_number, id, source_quote as text from {_REQ} union all select document_id, page_number, id, text from {_MAN})"
_EXPLICIT = rf"""m as (select document_id, coalesce(page_number, 0) as page_number, id, text, string_split_regex(text, '\n[ \t]*\n') as parts from {_PAGES} where text is not null),
    b as (select document_id, page_number, id, n, text, {_norm_sql('parts[n]')} as block from m, unnest(generate_series(1, len(parts))) as g(n)),
    c as (select *, coalesce(left(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: {_norm_sql('x')}), lambda x: x <> '' and not contains(block, x) and regexp_matches(x, '{NUMBERED_LINE}'))[-1], 140), 'RFQ page ' || page_number) as section, {_SENTENCES.format('block')} as parts from b),
    s as (select document_id, page_number, id, n, k, section, {_norm_sql('parts[k]')} as q from c, unnest(generate_series(1, len(parts))) as g(k)),
    x as (select *, case when regexp_matches({_repair_sql('q')}, '{GARBLED}', 'i') then 'ambiguous' else 'explicit' end as kind from s where length(q) between 25 and 1600 and not (q like '%:' and length(q) < 300) and {_obliged_sql('q')}
        and not (regexp_matches(q, '\bscope of\s*work\b', 'i') and not {_has_sql('q', MODAL)}) and {_has_sql('q', TECHNICAL_TERMS)} and {_complete_sql('q')} qualify row_number() over (partition by document_id, page_number, lower(q) order by id, n, k) = 1),
    explicit as ({_NUMBERED} from x)"""
_CELLS = f"list_reduce(list_transform(string_split(l, '|'), lambda v: {_norm_sql('v')}), lambda a, b: a || ' | ' || b)"
_TABLED = rf"""tl as (select document_id, coalesce(page_number, 0) as page_number, id, list_filter(list_transform(list_filter(string_split_regex(text, '\r?\n'), lambda l: contains(l, '|')), lambda l: {_CELLS}), lambda l: regexp_replace(l, '[|\s]', '', 'g') <> '') as ls from {_PAGES} where text like '%|%'),
    tt as (select document_id, page_number, id, 0 as n, 0 as k, 'table' as kind, 'RFQ page ' || page_number as section, array_to_string(ls, chr(10)) as raw from tl),
    tx as (select *, {_norm_sql('raw')} as q from tt where length(raw) between 20 and 6000 and not regexp_matches(raw, '\b(?:table of contents|page\s+no\.?|price schedule)\b', 'i') and ({_has_sql('raw', TECHNICAL_TERMS)} or regexp_matches(raw, '{VALUES}', 'i'))
        qualify row_number() over (partition by document_id, page_number, lower(q) order by id) = 1), tabled as ({_NUMBERED} from tx)"""
_ALL = f"{_EXPLICIT}, {_TABLED}, merged as (select * exclude (id, n, k, p) from (select *, 0 as p from explicit union all select *, 1 from tabled) qualify row_number() over (partition by document_id, page_number, {_fold_sql('source_quote')} order by p, id, n, k) = 1)"


@_query(f"with {_EXPLICIT} select * exclude (id, n, k) from explicit")
def explicit_candidates(s, d):
    """Obligations of pages as candidates."""
    return ca.explicit_candidates(_blocks(s, d)).drop("pass", "at", "source_bbox")


@_query(f"with {_TABLED} select * exclude (id, n, k) from tabled")
def table_candidates(s, d):
    """Tables of pages as candidates."""
    return ca.table_candidates(_tables(s, d)).drop("pass", "at", "source_bbox")


@_query(f"with {_ALL} select * from merged")
def requirement_candidates(s, d):
    """The candidates of both passes, once per quote of a page."""
    return _found(s, d).drop("pass", "at", "source_bbox")


@_query(f"with {_ALL} select document_id, page_number, '' as requirement_key, section, {_repair_sql(_norm_sql('source_quote'))} as requirement_text, {_norm_sql('source_quote')} as source_quote, category, criticality, confidence from merged where candidate_type = 'explicit'")
def direct_requirements(s, d):
    """Candidates that need no interpretation as requirements."""
    return ca.direct_requirements(_found(s, d).where("candidate_type = 'explicit'")).drop("source_bbox")


_SIGNALS = rf"""select document_id, coalesce(page_number, 0) as page_number, id, text, len(regexp_extract_all(text, '\b(?:{OBLIGATION})\b', 0, 'i')) as obligations, len(regexp_extract_all(text, '\b(?:{TECHNICAL})\b', 0, 'i')) as technical,
    len(regexp_extract_all(text, '(?:\|[^\n]*\|)|(?:\b\d+(?:\.\d+)?\s*(?:{TABLE_UNITS})\b)', 0, 'i')) as tables from (select document_id, page_number, id, coalesce(text, '') as text from {_PAGES})"""
_RELEVANT = f"rp as (select * from ({_SIGNALS}) r where exists (select 1 from merged c where c.document_id = r.document_id and c.page_number = r.page_number) or (obligations >= 2 and technical >= 2) or technical >= 10 or (technical >= 3 and tables >= 5))"


def _relevant(s, d):
    return ca.relevant_pages(_pages(s, d), _found(s, d))


@_query(f"with {_ALL}, {_RELEVANT} select document_id, page_number, id, obligations, technical, tables from rp")
def relevant_pages(s, d):
    """pages with a candidate or enough signals."""
    return _relevant(s, d).drop("text")


@_query(f"""with recursive {_ALL}, {_RELEVANT}, oc as (select document_id, page_number, sum(length(source_quote)) as c from merged where candidate_type <> 'explicit' group by all),
    o as (select rp.*, coalesce(oc.c, 0) as c, row_number() over (partition by rp.document_id order by rp.page_number, id) as k from rp left join oc on oc.document_id = rp.document_id and oc.page_number = rp.page_number),
    g as (select document_id, k, c as size, 1 as items, 0 as batch, obligations, technical, tables from o where k = 1 union all select o.document_id, o.k, case when g.items >= 12 or g.size + o.c > 12000 then o.c else g.size + o.c end,
    case when g.items >= 12 or g.size + o.c > 12000 then 1 else g.items + 1 end, case when g.items >= 12 or g.size + o.c > 12000 then g.batch + 1 else g.batch end, o.obligations, o.technical, o.tables from g join o on o.document_id = g.document_id and o.k = g.k + 1)
    select document_id, batch, count(*) as pages, cast(sum(obligations) as bigint) as obligations, cast(sum(technical) as bigint) as technical, cast(sum(tables) as bigint) as tables, sum(tables) >= 30 or sum(obligations) >= 35 or sum(technical) >= 100 as complex from g group by all""")
def batch_complexity(s, d):
    """Batches of relevant pages by their open candidates, with their signals."""
    p = _relevant(s, d).join(ca.open_characters(_found(s, d)).hint("merge"), ["document_id", "page_number"], "left")
    b = se.batch_numbers(p.select("document_id", "page_number", "id", "open_chars", "obligations", "technical", "tables"), "document_id", ["page_number", "id"], "open_chars", 12, 12000)
    return ca.batch_complexity(b, ["document_id", "batch"])


@_query(f"""select r.id, a.id as decision_id, trim(a.rationale) as requirement_text, r.source_quote, least(a.confidence, 88) as confidence from {_ASSESSED} a join {_REQ} r on r.id = a.requirement_id
    where lower(trim(a.decision)) in ('compliant', 'conditional') and trim(a.rationale) <> '' and {_has_sql('a.rationale', ACCEPTED)}""")
def accepted_decisions(s, d):
    """Decisions on known records, accepted and stating something."""
    a = _ass(s, d, "id", "requirement_id", "decision", "rationale", "confidence")
    x = a.select(F.col("requirement_id").alias("id"), F.col("id").alias("category"), F.lower(F.trim("decision")).isin("compliant", "conditional").alias("accept"), F.col("rationale").alias("requirement_text"), F.lit("").alias("criticality"), "confidence")
    return ca.accepted_decisions(x, _req(s, d, "id", "source_quote"), ["id"]).select("id", F.col("category").alias("decision_id"), "requirement_text", "source_quote", "confidence")


@_query(f"select id, 'REQ-' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as requirement_key from (select id, row_number() over (partition by document_id order by created_at, id) as n from {_REQ})")
def requirement_keys(s, d):
    """Keys in the order of each document."""
    return ca.numbered_requirements(_req(s, d, "id", "document_id", "created_at"), "document_id", ["created_at", "id"]).select("id", "requirement_key")


# ---------------------------------------------------------------- evidence
_CITED = f"""ct as (select a.id, a.requirement_id, i as rank, json_extract_string(e, '$.file_name') as file_name, json_extract_string(e, '$.quote') as quote, case when not isnan(try_cast(json_extract_string(e, '$.score') as double)) then try_cast(json_extract_string(e, '$.score') as double) end as score from (select id, requirement_id, cast(evidence_json as json) as j from {_ASSESSED}
    where json_valid(evidence_json) and json_type(evidence_json) = 'ARRAY') a, lateral (select unnest(generate_series(0, cast(json_array_length(j) as bigint) - 1)) as i), lateral (select json_extract(j, '$[' || i || ']') as e) where json_type(e) = 'OBJECT')"""


def _citations(s, d) -> DataFrame:
    """(id, requirement_id, rank, file_name, quote, score): evidence of assessments whose field is an array."""
    a = _ass(s, d, "id", "requirement_id", "evidence_json").where("evidence_json is not null").withColumn("j", parsed("evidence_json"))
    v = a.select("id", "requirement_id", F.expr("try_variant_get(j, '$', 'array<variant>')").alias("v"))
    e = v.select("id", "requirement_id", F.posexplode("v").alias("rank", "e")).where("startswith(schema_of_variant(e), 'OBJECT')")
    return e.select("id", "requirement_id", F.col("rank").cast("long").alias("rank"), *[F.expr(f"try_variant_get(e, '$.{c}', '{t}')").alias(c) for c, t in (("file_name", "string"), ("quote", "string"), ("score", "double"))])


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: length(t) > 1 and t not in (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"
_MAT = rf"list_distinct(list_transform(regexp_extract_all({{0}}, '\b(?:\d+(?:\.\d+)?\s*(?:{UNITS})?|{STANDARDS})\b', 0, 'i'), lambda t: lower(regexp_replace(t, '\s+', '', 'g'))))"
_GATED = f"""{_CITED}, gp as (select ct.*, {_TOK.format('r.requirement_text')} as need, {_TOK.format('ct.quote')} as have, {_MAT.format('r.requirement_text')} as m, {_MAT.format('ct.quote')} as mh from ct join {_REQ} r on r.id = ct.requirement_id where quote is not null and r.requirement_text is not null),
    gs as (select id, rank, file_name, quote, score, len(list_intersect(need, have)) / greatest(len(need), 1) as o, case when len(m) = 0 then 1.0 else len(list_intersect(m, mh)) / len(m) end as mo from gp
    where (len(m) = 0 or list_has_any(m, mh)) and len(list_filter(m, lambda t: regexp_matches(t, '^\\d') and not list_contains(mh, t))) = 0),
    gr as (select id, rank, file_name, quote, round(o, 4) as lexical_overlap, round(mo, 4) as material_overlap, floor((cast(0.7 as double) * score + cast(0.3 as double) * o) * 10000 + 0.5) / 10000 as prematch_score from gs where score >= 0.2 and o >= 0.04),
    gt as (select *, row_number() over (partition by id order by prematch_score desc, rank) as place from gr qualify place <= 4)"""


def _gated(s, d) -> DataFrame:
    c = _citations(s, d).where("quote is not null")
    r = _req(s, d, "id", "requirement_text").where("requirement_text is not null").withColumnRenamed("id", "requirement_id")
    n = c.join(r, "requirement_id").select("id", "requirement_text").distinct()
    return ev.gated_evidence(n, c.drop("requirement_id"), "id", "requirement_text", "quote", "score", "rank", least_score=0.2, least_overlap=0.04)


@_query(f"with {_GATED} select id, rank, file_name, lexical_overlap, material_overlap, prematch_score, cast(place as bigint) as place from gt")
def gated_evidence(s, d):
    """The best citations of each assessment that pass the gates; bounds lower than the defaults, as these texts share few words."""
    return _gated(s, d).select("id", "rank", "file_name", "lexical_overlap", "material_overlap", "prematch_score", F.col("place").cast("long").alias("place"))


@_query(f"""with {_GATED}, pk as (select id, string_agg('E' || place || ': ' || file_name || ': ' || left(quote, 60), ' | ' order by place) as packed, count(*) as n from gt group by id)
    select a.id, coalesce(pk.n, 0) as items, coalesce(pk.packed, '') as packed from {_ASSESSED} a left join pk on pk.id = a.id""")
def packed_evidence(s, d):
    """Every assessment with its bounded evidence, none where nothing passed."""
    p = ev.with_evidence(_ass(s, d, "id"), ev.packed_evidence(_gated(s, d), "id", ["file_name"], "quote", 60), "id")
    return p.select("id", F.size("evidence").cast("long").alias("items"), F.array_join(F.transform("evidence", lambda x: F.concat(x["evidence_id"], F.lit(": "), x["file_name"], F.lit(": "), x["text"])), " | ").alias("packed"))


@_query(f"with {_CITED} select id, rank, exists (select 1 from {_MAN} m where m.file_name = ct.file_name and {_fold_sql('ct.quote')} <> '' and contains({_fold_sql('m.text')}, {_fold_sql('ct.quote')})) as valid from ct where quote is not null and file_name is not null")
def citation_check(s, d):
    """whether a citation stands in some text of its file."""
    c = _citations(s, d).where("quote is not null and file_name is not null")
    return re.validate_citations(c, _manual(s, d, "file_name", "text").where("text is not null"), "file_name", "quote", "text").select("id", "rank", "valid")


@_query(f"""with {_CITED}, sc as (select id, max(score) as best, count(score) as n from ct group by id) select a.id, case when a.confidence is null or a.confidence <> 0 then a.confidence when sc.n > 0 then cast(round_even(sc.best * 100, 0) as integer)
    when {_DECISION.replace('decision', 'a.decision')} = 'Unknown' then 70 else a.confidence end as confidence from (select * replace (case when confidence < 60 then 0 else confidence end as confidence) from {_ASSESSED}) a left join sc on sc.id = a.id""")
def confidence_calibrated(s, d):
    """Confidences under 60 treated as missing and taken from the evidence."""
    sc = _citations(s, d).groupBy("id").agg(F.collect_list("score").alias("scores"))
    a = _ass(s, d, "id", "decision", "confidence").join(sc.hint("merge"), "id", "left")
    c = F.when(F.col("confidence") < 60, 0).otherwise(F.col("confidence"))
    return a.select("id", F.when(c.isNotNull(), ev.calibrated(c, F.coalesce("scores", F.array().cast("array<double>")), cx.decision(F.col("decision")))).alias("confidence"))


@_query(f"""select id, product_name, case when product_name is not null and product_name <> '' then coalesce(rationale, '') end as rationale from (select id, json_extract_string(alternate_json, '$.product_name') as product_name, json_extract_string(alternate_json, '$.rationale') as rationale from {_ASSESSED}
    where json_valid(alternate_json) and json_type(alternate_json) = 'OBJECT') where product_name <> ''""")
def alternates(s, d):
    """K4: alternates that name a product."""
    a = _ass(s, d, "id", "alternate_json").where("alternate_json is not null")
    v = a.select("id", parsed("alternate_json").alias("v")).where("startswith(schema_of_variant(v), 'OBJECT')")
    x = v.select("id", ev.alternate(F.expr("try_variant_get(v, '$.product_name', 'string')"), F.expr("try_variant_get(v, '$.rationale', 'string')")).alias("a"))
    return x.where("a is not null").select("id", "a.product_name", "a.rationale")


# ---------------------------------------------------------------- edits and jobs
@_query(f"""with o as (select *, row_number() over (partition by document_id, page_number, q order by id) as n from (select id, document_id, page_number, {_fold_sql('source_quote')} as q, engineer_note, review_status from {_REQ}) where engineer_note is not null),
    w as (select *, row_number() over (partition by document_id, page_number, q order by id) as n from (select id, document_id, page_number, {_fold_sql('source_quote')} as q from {_REQ}))
    select w.id, o.engineer_note, o.review_status from w left join o on w.document_id = o.document_id and w.page_number = o.page_number and w.q = o.q and w.n = o.n""")
def edits_preserved(s, d):
    """Rows extracted anew take note and status of the row at their place among those edited before."""
    r = _req(s, d, "id", "document_id", "page_number", "source_quote", "engineer_note", "review_status").withColumn("q", tx.fold(F.col("source_quote"))).drop("source_quote")
    new = r.withColumns({"engineer_note": F.lit(None).cast("string"), "review_status": F.lit(None).cast("string")})
    return re.replace_preserving(new, r.where("engineer_note is not null"), ["document_id", "page_number", "q"], "id", ["engineer_note", "review_status"]).select("id", "engineer_note", "review_status")


@_query(f"""select requirement_id, id from {_ASSESSED} where evaluation_method = 'timeout' union all select requirement_id, id from {_ASSESSED} a where coalesce(evaluation_method, '') <> 'timeout'
    and not exists (select 1 from {_ASSESSED} n where n.evaluation_method = 'timeout' and n.requirement_id = a.requirement_id)""")
def assessments_upserted(s, d):
    """K2: assessments of one run over those of the others, per requirement."""
    a = _ass(s, d, "requirement_id", "id", "evaluation_method")
    new = a.where("evaluation_method = 'timeout'")
    return st.upsert(a.where("coalesce(evaluation_method, '') <> 'timeout'"), new, ["requirement_id"]).select("requirement_id", "id")


_BATCHES = "(select distinct * from extraction_batches)"


def _batches(s, d, *columns):
    return _rows(s, d, "extraction_batches", columns)


@_query(f"""select job_id, count(*) filter (st = 'running') as active, count(*) filter (st = 'pending') as pending, arg_min(start_page || '-' || end_page, (batch_index, id)) filter (st = 'running') as current_pages from (select *, lower(trim(status)) as st from {_BATCHES}) where job_id is not null group by job_id""")
def job_view(s, d):
    """What runs and waits per job, and the pages of the first running batch."""
    b = _batches(s, d, "job_id", "id", "batch_index", "start_page", "end_page", "status").where("job_id is not null").withColumn("st", F.lower(F.trim("status")))
    runs = F.col("st") == "running"
    pages = F.concat(F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return b.groupBy("job_id").agg(F.count_if(runs).alias("active"), F.count_if(F.col("st") == "pending").alias("pending"), F.min_by(pages, F.when(runs, F.struct("batch_index", "id"))).alias("current_pages"))


@_query(f"select job_id, 'attempts' as metric, cast(sum(attempts) as bigint) as total from {_BATCHES} where job_id is not null and attempts is not null group by job_id union all select job_id, lower(trim(status)), count(*) from {_BATCHES} where job_id is not null and status is not null group by all")
def job_metrics(s, d):
    """A4: the counters of all batches of a job."""
    b = _batches(s, d, "job_id", "id", "status", "attempts").where("job_id is not null")
    pairs = F.array(F.struct(F.lit("attempts").alias("k"), F.col("attempts").alias("v")), F.struct(F.lower(F.trim("status")).alias("k"), F.lit(1).alias("v")))
    m = F.map_from_entries(F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull()))
    return ev.merged_metrics(b.withColumn("m", m), "job_id", "m")


@_query(f"select id, case when lower(trim(status)) = 'completed' then 'completed' else 'pending' end as status from {_BATCHES} where job_id in (select id from (select distinct * from extraction_jobs) where lower(trim(status)) in ('failed', 'interrupted'))")
def batches_requeued(s, d):
    """A failed or interrupted job resumes; what is completed stays."""
    j = _rows(s, d, "extraction_jobs", ("id", "status")).where("lower(trim(status)) in ('failed', 'interrupted')").select(F.col("id").alias("job_id"))
    b = st.guard(_batches(s, d, "id", "job_id", "status"), j, ["job_id"])
    return b.select("id", F.when(F.lower(F.trim("status")) == "completed", "completed").otherwise("pending").alias("status"))


@_query("""with b as (select distinct job_id, batch_index, start_page, end_page, lower(trim(status)) as st from extraction_batches where job_id is not null and end_page >= start_page), w as (select distinct job_id, p as page from b, unnest(generate_series(start_page, end_page)) as g(p)),
    c as (select distinct job_id, p as page from b, unnest(generate_series(start_page, end_page)) as g(p) where st = 'completed'), l as (select job_id, coalesce(max(batch_index) filter (st = 'completed'), -1) + 1 as base from b group by job_id),
    r as (select job_id, page, row_number() over (partition by job_id order by page) - 1 as n from w where not exists (select 1 from c where c.job_id = w.job_id and c.page = w.page))
    select r.job_id, cast(l.base + n // 12 as bigint) as batch_index, cast(min(page) as integer) as start_page, cast(max(page) as integer) as end_page from r join l on l.job_id = r.job_id group by all""")
def batches_replanned(s, d):
    """What no completed batch covers, planned anew after the last completed batch."""
    b = _batches(s, d, "job_id", "batch_index", "start_page", "end_page", "status").where("job_id is not null and end_page >= start_page").withColumn("done", F.lower(F.trim("status")) == "completed")
    wanted = b.select("job_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    rest = se.uncovered(wanted, b.where("done"), "job_id", "page", "start_page", "end_page")
    base = b.groupBy("job_id").agg((F.coalesce(F.max(F.when(F.col("done"), F.col("batch_index"))), F.lit(-1)) + 1).alias("base"))
    p = se.batch_numbers(rest.withColumn("size", F.lit(0)), "job_id", ["page"], "size", 12, 12000).join(base, "job_id")
    return p.groupBy("job_id", (F.col("base") + F.col("batch")).cast("long").alias("batch_index")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))


@_query(f"select distinct document_id from {_REQ} where document_id is not null and lower(review_status) = 'deleted'")
def stale_inputs(s, d):
    """Documents whose requirements differ from those an earlier run took."""
    r = _req(s, d, "document_id", "id", "requirement_text", "review_status").where("document_id is not null")
    mark = lambda x: st.fingerprint(x, ["document_id"], ["id", "requirement_text"])
    return st.stale(mark(r), mark(r.where("lower(coalesce(review_status, '')) <> 'deleted'")), ["document_id"])


# ---------------------------------------------------------------- orders, batches, exports
_NARRATIVE = ("manual_match_applicable", "package_order", "subcategory_order", "page_number", "requirement_key", "id")


@_query(f"select id, n as position, (n - 1) // 8 as batch from (select id, row_number() over (order by {', '.join(c + ' nulls first' for c in _NARRATIVE)}) as n from {_REQ})")
def compliance_batches(s, d):
    """All requirements in the order of evaluation, eight to a batch."""
    return fixed_batches(_req(s, d, *_NARRATIVE), [F.asc_nulls_first(c) for c in _NARRATIVE], 8).select("id", "position", "batch")


@_query(f"""select a.id, row_number() over (order by coalesce(r.package_order, 99), coalesce(r.subcategory_order, 99), coalesce(r.page_number, 9999), coalesce(r.requirement_key, ''), a.id) as position from {_ASSESSED} a left join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id))""")
def matrix_order(s, d):
    """Assessments in the order of the matrix, missing requirements last."""
    a = _ass(s, d, "id", "requirement_id").select("id", norm_key("requirement_id").alias("k"))
    r = _req(s, d, "id", "package_order", "subcategory_order", "page_number", "requirement_key").withColumn("k", norm_key("id")).drop("id")
    j = a.join(r.hint("merge"), "k", "left").select("id", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("package_order", 99), ("subcategory_order", 99), ("page_number", 9999), ("requirement_key", ""))])
    return global_position(j, [F.asc(c) for c in ("package_order", "subcategory_order", "page_number", "requirement_key", "id")]).select("id", "position")


@_query("select id, row_number() over (order by created_at desc nulls last, id) as position, printf('%.1f MB', byte_size / 1048576.0) as size, lower(case when instr(status, ' ') > 0 then left(status, instr(status, ' ') - 1) || '-' || substr(status, instr(status, ' ') + 1) else status end) as tone, regexp_replace(file_name, '[^\\p{L}\\p{N}._-]', '-', 'g') as safe_name from (select distinct * from source_documents)")
def documents_listed(s, d):
    """Documents, newest first, with size, status and a safe name."""
    x = _rows(s, d, "source_documents", ("id", "created_at", "byte_size", "status", "file_name"))
    p = global_position(x, [F.desc_nulls_last("created_at"), F.asc("id")])
    return p.select("id", "position", tx.megabytes(F.col("byte_size")).alias("size"), tx.status_slug(F.col("status")).alias("tone"), tx.safe_name(F.col("file_name")).alias("safe_name"))


@_query(f"select id, row_number() over (order by requirement_key nulls first, id) as position from {_REQ}")
def key_order(s, d):
    """Requirements by their key as text."""
    return global_position(_req(s, d, "id", "requirement_key"), [F.asc_nulls_first("requirement_key"), F.asc("id")]).select("id", "position")


@_query(f"""select compliance_job_id, count(*) filter (d = 'Unknown' and product) as unresolved, count(*) filter (not product) as evidence_due, count(*) as rows from (select a.compliance_job_id, {_DECISION.replace('decision', 'a.decision')} as d, coalesce(r.evidence_scope in ('product_manual', 'hybrid'), false) as product
    from {_ASSESSED} a left join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id))) group by compliance_job_id""")
def lane_kpis(s, d):
    """Unresolved product rows and rows whose evidence is due elsewhere, per run."""
    a = _ass(s, d, "id", "requirement_id", "decision", "compliance_job_id").withColumn("k", norm_key("requirement_id"))
    r = _req(s, d, "id", "evidence_scope").select(norm_key("id").alias("k"), (ru.lane(F.col("evidence_scope")) == "product").alias("product"))
    j = a.join(r.hint("merge"), "k", "left").withColumn("product", F.coalesce("product", F.lit(False)))
    return j.groupBy("compliance_job_id").agg(F.count_if((cx.decision(F.col("decision")) == "Unknown") & F.col("product")).alias("unresolved"), F.count_if(~F.col("product")).alias("evidence_due"), F.count(F.lit(1)).alias("rows"))


@_query(f"""with x as (select solution_package as p, subcategory as s, min(package_order) as po, min(subcategory_order) as so, count(*) as n from {_REQ} where solution_package is not null and subcategory is not null group by all)
    select p as solution_package, coalesce(min(po), 99) as package_order, string_agg(s || ':' || n, '|' order by coalesce(so, 99), s, n) as parts from x group by p""")
def package_tree(s, d):
    """Packages and their parts in order."""
    r = _req(s, d, "id", "solution_package", "subcategory", "package_order", "subcategory_order").where("solution_package is not null and subcategory is not null")
    t = cx.package_tree(r, "solution_package", "subcategory", "package_order", "subcategory_order")
    return t.select("solution_package", "package_order", F.array_join(F.transform("parts", lambda x: F.concat(x["name"], F.lit(":"), x["requirements"].cast("string"))), "|").alias("parts"))


@_query(f"""with {_CITED}, el as (select id, string_agg(file_name || ': ' || quote, ' | ' order by rank) as evidence from ct where file_name is not null and quote is not null group by id)
    select a.id, coalesce(r.requirement_key, '') as requirement_key, coalesce(r.section_name, '') as section, coalesce(r.requirement_text, '') as requirement, coalesce(r.category, '') as category, coalesce(r.criticality, '') as criticality, coalesce(r.page_number::varchar, '') as page,
    {_DECISION.replace('decision', 'a.decision')} as decision, a.product_name as product, a.rationale, a.confidence, a.review_status as status, coalesce(el.evidence, '') as evidence from {_ASSESSED} a left join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id)) left join el on el.id = a.id""")
def export_rows(s, d):
    """The thirteen columns of the export, blanks where the requirement is missing."""
    e = _citations(s, d).where("file_name is not null and quote is not null").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(": ", "file_name", "quote").alias("t")))), lambda x: x["t"]), " | ").alias("evidence"))
    a = _ass(s, d, "id", "requirement_id", "decision", "product_name", "rationale", "confidence", "review_status").withColumn("k", norm_key("requirement_id"))
    r = _req(s, d, "id", "requirement_key", "section_name", "requirement_text", "category", "criticality", "page_number").withColumn("k", norm_key("id")).drop("id")
    j = a.join(r.hint("merge"), "k", "left").join(e.hint("merge"), "id", "left")
    blank = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    return j.select("id", blank("requirement_key", "requirement_key"), blank("section_name", "section"), blank("requirement_text", "requirement"), blank("category", "category"), blank("criticality", "criticality"), blank("page_number", "page"),
        cx.decision(F.col("decision")).alias("decision"), F.col("product_name").alias("product"), "rationale", "confidence", F.col("review_status").alias("status"), blank("evidence", "evidence"))


@_query(f"select id, section_name as section, try_cast(json_extract_string(source_bbox_json, '$[0]') as double) as x0, try_cast(json_extract_string(source_bbox_json, '$[3]') as double) as y1 from {_REQ} where source_bbox_json is null or json_valid(source_bbox_json)")
def requirements_served(s, d):
    """JSON columns decoded and columns renamed."""
    r = _req(s, d, "id", "section_name", "source_bbox_json").withColumn("v", F.expr("try_parse_json(source_bbox_json)")).where("source_bbox_json is null or v is not null")
    return r.select("id", F.col("section_name").alias("section"), F.expr("try_variant_get(v, '$[0]', 'double')").alias("x0"), F.expr("try_variant_get(v, '$[3]', 'double')").alias("y1"))


@_query(f"""select document_id, page_number, id, case when ocr and length(trim(lt)) >= 20 then trim(lt) else text end as text, coalesce(ocr and length(trim(lt)) >= 20, false) as ocr_applied from (select m.document_id, coalesce(m.page_number, 0) as page_number, m.id, m.text, l.lt, l.ocr
    from {_MAN} m left join (select document_id, coalesce(page_number, 0) as page_number, id, {_norm_sql('text')} as lt, text is not null as ocr from {_MAN} where contains(text, chr(10))) l on l.id = m.id)""")
def layout_merged(s, d):
    """Pages with line ends take their text recognised anew; all others stay."""
    m = _manual(s, d, "document_id", "page_number", "id", "text").withColumn("page_number", F.coalesce("page_number", F.lit(0)))
    layout = m.where(F.contains("text", F.lit("\n"))).select("id", tx.normalize(F.col("text")).alias("text"), F.lit(True).alias("ocr"))
    return pg.layout_merged(m, layout, ["id"])


# ---------------------------------------------------------------- records
@_query(f"select id, replace(replace(requirement_text, '—', ','), '–', '-') as shown from {_REQ}")
def punctuation_shown(s, d):
    """Punctuation as it is shown."""
    return _req(s, d, "id", "requirement_text").select("id", re.ui_punctuation(F.col("requirement_text")).alias("shown"))


@_query(f"select id, case when trim(engineer_note) <> '' then trim(engineer_note) else requirement_text end as requirement_text, case when trim(engineer_note) <> '' then 'Edited' else review_status end as review_status from {_REQ}")
def edits_applied(s, d):
    """Notes taken as edited texts; blank ones keep the old."""
    r = _req(s, d, "id", "requirement_text", "review_status", "engineer_note")
    e = r.where("engineer_note is not null").select("id", F.col("engineer_note").alias("requirement_text"), F.when(F.trim("engineer_note") != "", "Edited").alias("review_status"))
    return re.apply_edits(r.drop("engineer_note"), e, "id", ["requirement_text", "review_status"])


_BOX = "case when json_valid(source_bbox_json) and json_array_length(source_bbox_json) = 4 then list_transform([0, 1, 2, 3], lambda i: round(cast(json_extract(source_bbox_json, '$[' || i || ']') as double), 3)) end"


@_query(f"""with b as (select id, document_id, {_BOX} as b from {_REQ}), p as (select *, lag(b) over (partition by document_id order by id) as a from b)
    select id, u[1] as x0, u[2] as y0, u[3] as x1, u[4] as y1 from (select id, case when a is null then b when b is null then a else [least(a[1], b[1]), least(a[2], b[2]), greatest(a[3], b[3]), greatest(a[4], b[4])] end as u from p)""")
def boxes_united(s, d):
    """The box around a requirement and the one before it in its document."""
    box = pg.bbox(F.expr("try_variant_get(try_parse_json(source_bbox_json), '$', 'array<double>')"))
    b = _req(s, d, "id", "document_id", "source_bbox_json").select("id", "document_id", box.alias("b"))
    u = b.select("id", pg.bbox_union(F.lag("b").over(Window.partitionBy("document_id").orderBy("id")), F.col("b")).alias("u"))
    return u.select("id", *[F.get("u", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@_query(f"with {_CITED}, f as (select id, file_name, min(rank) as r from ct where file_name is not null group by all having max(score) >= 0.5) select id, string_agg(file_name, '|' order by r) as cited from f group by id")
def citations_resolved(s, d):
    """P20: the cited files that are allowed (a score of one half or more), once each, in the order cited."""
    c = _citations(s, d).where("file_name is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_name"))), lambda x: x["file_name"]).alias("cited"), F.collect_set(F.when((F.col("score") >= 0.5) & ~F.isnan("score"), F.col("file_name"))).alias("allowed"))
    return c.select("id", F.array_join(re.resolve_ids(F.col("cited"), F.col("allowed")), "|").alias("cited")).where("cited <> ''")


@_query("select vec_id, case when label = 0 then -1 else label end as label, sha256(vec_id::varchar) as point_id from embeddings")
def vectors_upserted(s, d):
    """An index takes the last version of each vector under a stable id."""
    e = _rows(s, d, "embeddings", ("vec_id", "label"))
    index = re.upsert_vectors(None, e.withColumn("seq", F.lit(0)), "vec_id", "seq")
    again = e.where("label = 0").select("vec_id", F.lit(-1).cast("int").alias("label"), F.lit(1).alias("seq"))
    return re.upsert_vectors(index, again, "vec_id", "seq").select("vec_id", F.col("label").cast("int").alias("label"), "point_id")


@_query(f"select id, case when confidence is null then 'missing' when confidence < 60 then 'review' when {_DECISION} = 'Unknown' then 'open' else 'kept' end as route, case when confidence is null then 0 when confidence < 60 then least(confidence, 50) else confidence end as confidence from {_ASSESSED}")
def records_routed(s, d):
    """M4, M1 to M3: a decision table given as data, first rule wins."""
    c = F.col("confidence")
    rules = [(c.isNull(), {"route": F.lit("missing"), "capped": F.lit(0)}), (c < 60, {"route": F.lit("review"), "capped": F.least(c, F.lit(50))}), (cx.decision(F.col("decision")) == "Unknown", {"route": F.lit("open")})]
    r = re.route(_ass(s, d, "id", "decision", "confidence"), rules, {"route": F.lit("kept"), "capped": c})
    return r.select("id", "route", F.col("capped").alias("confidence"))


@_query(f"with {_CITED}, n as (select id, count(*) as n from ct group by id) select a.id, case when n.n is null then 'Unknown' when n.n >= 3 then 'Compliant' else 'Conditional' end as verdict, coalesce(n.n, 0) as used from {_ASSESSED} a left join n on n.id = a.id")
def records_evaluated(s, d):
    """An evaluator over the rows with evidence, a fixed outcome for the rest; this one counts."""
    n = _citations(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    a = _ass(s, d, "id").join(n.hint("merge"), "id", "left")

    def count(b):
        return b.assign(verdict=["Compliant" if k >= 3 else "Conditional" for k in b["n"]], used=b["n"])[["id", "verdict", "used"]]

    return re.evaluate(a, F.col("n").isNotNull(), count, "id string, verdict string, used long", {"verdict": F.lit("Unknown"), "used": F.lit(0)})


@_query("select arg_max(id, (created_at, id)) as id, count(*) as versions from (select distinct * from solutions)")
def latest_solution(s, d):
    """The solution created last."""
    return _rows(s, d, "solutions", ("id", "created_at")).agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count(F.lit(1)).alias("versions"))


def _first_sql(source: str, value: str, order: str, n: int, unique: bool, name: str) -> str:
    v = f"select p, s, {value} as v, min({order}) as o from {source} where {value} is not null group by all" if unique else f"select p, s, {value} as v, {order} as o from {source}"
    return f"(select p, s, string_agg(v, '|' order by n) as {name} from (select *, row_number() over (partition by p, s order by o, v) as n from ({v})) where n <= {n} group by p, s)"


@_query(f"""with {_CITED}, j as (select r.solution_package as p, r.subcategory as s, a.id as aid, {_DECISION.replace('decision', 'a.decision')} as d, nullif(r.compliance_object, '') as ob, nullif(a.product_name, '') as pr, left(coalesce(r.requirement_text, ''), 400) as t
    from {_ASSESSED} a join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id)) where r.solution_package is not null and r.subcategory is not null), un as (select * from j where d in ('Non-compliant', 'Unknown')),
    e as (select j.p, j.s, j.aid, k.n, coalesce(k.file_name, '') || ': ' || left(coalesce(k.quote, ''), 350) as x from j join (select *, row_number() over (partition by id order by rank) as n from ct) k on k.id = j.aid where k.n <= 2)
    select p as solution_package, s as subcategory, o.objects, pr.products, sm.samples, u.unresolved, ev.evidence from (select distinct p, s from j) left join {_first_sql('j', 'ob', 'aid', 12, True, 'objects')} o using (p, s) left join {_first_sql('j', 'pr', 'aid', 12, True, 'products')} pr using (p, s)
    left join {_first_sql('j', 't', 'aid', 4, False, 'samples')} sm using (p, s) left join {_first_sql('un', 't', 'aid', 6, False, 'unresolved')} u using (p, s) left join {_first_sql('e', 'x', '(aid, n)', 6, True, 'evidence')} ev using (p, s)""")
def solution_lists(s, d):
    """A1: the bounded lists of each package and part: objects, products, samples, what is unresolved, and evidence."""
    c = _citations(s, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_name", "quote"))), lambda x: F.struct(x["file_name"].alias("file_name"), F.lit(None).cast("string").alias("location"), x["quote"].alias("quote"))).alias("evidence"))
    a = _ass(s, d, "id", "requirement_id", "decision", "product_name").withColumn("k", norm_key("requirement_id")).join(c.hint("merge"), "id", "left").withColumnRenamed("id", "aid")
    r = _req(s, d, "id", "solution_package", "subcategory", "compliance_object", "requirement_text").withColumn("k", norm_key("id")).drop("id").where("solution_package is not null and subcategory is not null")
    out = cx.solution_context(a.join(r, "k"), ["solution_package", "subcategory"], "aid", "compliance_object", "product_name", "requirement_text", evidence="evidence")
    shown = F.array_join(F.transform("evidence", lambda x: F.concat(F.coalesce(x["file_name"], F.lit("")), F.lit(": "), x["quote"])), "|")
    return out.select("solution_package", "subcategory", "objects", "products", "samples", "unresolved", shown.alias("evidence"))


@_query(f"""with b as (select *, (n - 1) // 8 as batch from (select *, row_number() over (order by {', '.join(c + ' nulls first' for c in _NARRATIVE)}) as n from {_REQ}))
    select batch, case when bool_or(page_number is null) then 'failed' else 'completed' end as status, case when not bool_or(page_number is null) then count(*)::varchar end as result, case when bool_or(page_number is null) then 'page missing' end as error from b group by batch""")
def batches_run(s, d):
    """T4: each batch by itself; those with a row without page fail and leave the others alone."""
    b = fixed_batches(_req(s, d, *_NARRATIVE), [F.asc_nulls_first(c) for c in _NARRATIVE], 8)

    def work(rows):
        if rows["page_number"].isna().any():
            raise ValueError("page missing")
        return str(len(rows))

    return re.run_isolated(b.select("batch", "position", "page_number"), "batch", ["position"], work)
