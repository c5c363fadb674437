"""Queries of the core operators over whole tables, with SQL written on its own where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.functions.fixed import ACTIONS, ACTORS, ADMIN_HEADINGS, BARE_NUMBER, CATEGORIES, DANGLING, GARBLED, HEADING_WORDS, IDENTITY_REPAIRS, MODAL, NO_HEADING, NUMBERED_HEADING, OBLIGATION, REPAIRS, STANDARDS, STOPWORDS, TABLE_UNITS, TECHNICAL, TECHNICAL_TERMS, TOP_LEVEL, UNITS, VALUES
from clausewright.functions.vectors import top_k
from clausewright.operators import candidates as ca
from clausewright.operators import context as cx
from clausewright.operators import dedupe as dd
from clausewright.operators import rules as ru
from clausewright.operators import sections as se
from clausewright.operators import state as st
from clausewright.operators.order import page_of
from clausewright.session import norm_key, table
from clausewright.sources import pages as pg
from clausewright.streaming.resume import counted_by_type

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


# Fixed value: the white space that Unicode knows.
_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _fold_sql(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SPACE}', ' ', 'g')))"


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"


def _word_sql(words: str) -> str:
    return rf"\b(?:{words})\b"


def _has_sql(c: str, words: str) -> str:
    return f"regexp_matches({c}, '{_word_sql(words)}', 'i')"


def _rows(s: SparkSession, d: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns of a table, rows delivered twice once: told apart by a hash of the whole row, so that only these columns are shuffled."""
    t = table(s, d, name)
    return t.select(*columns, F.xxhash64(*t.columns).alias("__row"), F.hash(*t.columns).alias("__row2")).distinct().drop("__row", "__row2")


def _req(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return _rows(s, d, "requirements", columns)


def _ass(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return _rows(s, d, "assessments", columns)


def _manual(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return _rows(s, d, "product_manual_evidence", columns)


_REQ, _ASSESSED, _MAN = "(select distinct * from requirements)", "(select distinct * from assessments)", "(select distinct * from product_manual_evidence)"


# ---------------------------------------------------------------- text
@_query(f"select id, {_fold_sql('requirement_text')} as folded, length(requirement_text) as chars from {_REQ}")
def text_normalize(s, d):
    """Folded text."""
    return _req(s, d, "id", "requirement_text").select("id", tx.fold(F.col("requirement_text")).alias("folded"), F.char_length("requirement_text").alias("chars"))


def _repair_sql(c: str) -> str:
    """The repairs in this dialect, which has no look-ahead: what follows is caught and put back."""
    for pattern, right, cased in REPAIRS:
        pattern, right = pattern.replace("(?=", "(").replace("'", "''"), right.replace("$1", r"\1")
        if pattern.endswith(r"(\s*61850)"):
            right += r"\1"
        c = f"regexp_replace({c}, '{pattern}', '{right}', '{'g' if cased else 'gi'}')"
    return c


@_query(f"select id, {_repair_sql('source_quote')} as repaired from {_REQ}")
def ocr_repair(s, d):
    """Ordered repairs."""
    return _req(s, d, "id", "source_quote").select("id", tx.repair(F.col("source_quote")).alias("repaired"))


@_query(f"select id, regexp_matches({_repair_sql('source_quote')}, '{GARBLED}', 'i') as garbled from {_REQ}")
def garble_detect(s, d):
    """Quotes that are garbled also after the repairs."""
    return _req(s, d, "id", "source_quote").select("id", tx.garbled(tx.repair(F.col("source_quote"))).alias("garbled"))


@_query(rf"select id, len(regexp_extract_all(text, '[.!?;]\s+\(?[A-Z0-9]')) + 1 as sentences from {_MAN} where text is not null")
def sentence_counts(s, d):
    """P5: sentences per record."""
    return _manual(s, d, "id", "text").where("text is not null").select("id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


_SENTENCES = r"string_split(regexp_replace({0}, '([.!?;])\s+(\(?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@_query(f"select id, unnest(generate_series(1, len(x))) as n, unnest(x) as sentence from (select id, {_SENTENCES.format('source_quote')} as x from {_REQ} where source_quote is not null)")
def sentence_rows(s, d):
    """P5: the sentences of quotes."""
    q = _req(s, d, "id", "source_quote").where("source_quote is not null")
    return q.select("id", F.posexplode(tx.sentences(F.col("source_quote"))).alias("n", "sentence")).withColumn("n", (F.col("n") + 1).cast("long"))


def _obliged_sql(c: str) -> str:
    return f"({_has_sql(c, MODAL)} or regexp_matches({c}, '{_word_sql(ACTORS)}[^\\n]{{0,100}}{_word_sql(ACTIONS)}', 'i'))"


def _complete_sql(c: str) -> str:
    return f"""(len(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9/-]*')) >= 6 and not regexp_matches({c}, '{_word_sql(DANGLING)}\\s*[:,-]?\\z', 'i')
        and length({c}) - length(replace({c}, '|', '')) < 4 and not regexp_matches({c}, '\\.{{4,}}\\s*\\d+')
        and length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\s.,;:()/%+-]', '', 'g')) / greatest(length({c}), 1) >= 0.9)"""


@_query(f"select id, {_obliged_sql('requirement_text')} as obliged, {_has_sql('requirement_text', TECHNICAL_TERMS)} as technical, {_complete_sql('requirement_text')} as complete, regexp_matches(requirement_text, '{VALUES}', 'i') as stated from {_REQ}")
def obligation_filter(s, d):
    """Predicates of an obligation."""
    t = F.col("requirement_text")
    return _req(s, d, "id", "requirement_text").select("id", tx.obligation(t).alias("obliged"), tx.has(t, tx.any_word(TECHNICAL_TERMS)).alias("technical"), tx.complete(t).alias("complete"), tx.value_or_standard(t).alias("stated"))


_TABLE = rf"(?:\|[^\n]*\|)|(?:\b\d+(?:\.\d+)?\s*(?:{TABLE_UNITS})\b)"


@_query(f"""select id, obligations, technical, tables, (obligations >= 2 and technical >= 2) or technical >= 10 or (technical >= 3 and tables >= 5) as relevant from (
    select id, len(regexp_extract_all(text, '{_word_sql(OBLIGATION)}', 0, 'i')) as obligations, len(regexp_extract_all(text, '{_word_sql(TECHNICAL)}', 0, 'i')) as technical,
    len(regexp_extract_all(text, '{_TABLE}', 0, 'i')) as tables from {_MAN} where text is not null)""")
def page_triage(s, d):
    """signals and relevance of pages."""
    p = _manual(s, d, "id", "text").where("text is not null").select("id", tx.page_signals(F.col("text")).alias("x"))
    return p.select("id", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("obligations", "technical", "tables")], tx.relevant(F.col("x")).alias("relevant"))


_CATEGORY = "case " + " ".join(f"when regexp_matches({{0}}, '{_word_sql(w)}', 'i') then '{c}'" for c, w in CATEGORIES) + " else 'Technical' end"


@_query(f"""select id, {_CATEGORY.format('requirement_text')} as category_found, case evidence_scope when 'product_manual' then 'product' when 'hybrid' then 'product' when 'test_report' then 'testing'
    when 'engineering_deliverable' then 'deliverables' when 'system_design' then 'design' else 'engineer' end as lane from {_REQ}""")
def category_assign(s, d):
    """Ordered rules and lanes."""
    return _req(s, d, "id", "requirement_text", "evidence_scope").select("id", ru.first_match(F.col("requirement_text"), ru.CATEGORY, "Technical").alias("category_found"), ru.lane(F.col("evidence_scope")).alias("lane"))


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: length(t) > 1 and t not in (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"
_MAT = rf"list_distinct(list_transform(regexp_extract_all({{0}}, '\b(?:\d+(?:\.\d+)?\s*(?:{UNITS})?|{STANDARDS})\b', 0, 'i'), lambda t: lower(regexp_replace(t, '\s+', '', 'g'))))"


@_query(f"""select id, round(len(list_intersect(need, have)) / greatest(len(need), 1), 4) as overlap, (len(m) = 0 or list_has_any(m, mh)) and len(list_filter(m, lambda t: regexp_matches(t, '^\\d') and not list_contains(mh, t))) = 0 as hard_values_met
    from (select a.id, {_TOK.format('r.requirement_text')} as need, {_TOK.format('a.rationale')} as have, {_MAT.format('r.requirement_text')} as m, {_MAT.format('a.rationale')} as mh
    from {_ASSESSED} a join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id)) where a.rationale is not null and r.requirement_text is not null)""")
def evidence_gate(s, d):
    """Lexical overlap and hard values of a rationale against its requirement."""
    a = _ass(s, d, "id", "requirement_id", "rationale").select("id", norm_key("requirement_id").alias("k"), "rationale").where("k is not null and rationale is not null")
    r = _req(s, d, "id", "requirement_text").select(norm_key("id").alias("k"), "requirement_text").where("requirement_text is not null")
    t = a.join(r, "k").select("id", *[f(F.col(c)).alias(n) for f, c, n in ((tx.tokens, "requirement_text", "need"), (tx.tokens, "rationale", "have"), (tx.material_tokens, "requirement_text", "m"), (tx.material_tokens, "rationale", "mh"))])
    return t.select("id", F.round(tx.containment(F.col("need"), F.col("have")), 4).alias("overlap"), tx.hard_values(F.col("m"), F.col("mh")).alias("hard_values_met"))


_RAW = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@_query(rf"""select id, case when length(q) <= 200 then q else regexp_replace(left(q, 200), ' [^ ]*\z', '') end as quote from (select id, (list_sort(list_transform(x, lambda p: {{'s': -len(list_intersect({_RAW.format('p')}, need)), 'l': length(p), 'p': p}})))[1].p as q from (
    select id, {_RAW.format('requirement_text')} as need, list_filter(list_transform(string_split(regexp_replace(source_quote, '([.!?;])\s+|\n{{2,}}', '\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^{_SPACE}|{_SPACE}$', '', 'g')), lambda p: p <> '') as x from {_REQ} where source_quote is not null and requirement_text is not null))""")
def evidence_quotes(s, d):
    """The sentence of a quote that says most of the requirement, at most 200 characters."""
    q = _req(s, d, "id", "source_quote", "requirement_text").where("source_quote is not null and requirement_text is not null")
    return q.select("id", tx.best_quote(F.col("source_quote"), F.col("requirement_text"), 200).alias("quote"))


@_query()
def mojibake_simple(s, d):
    """Whole-value repair of UTF-8 read as Latin-1."""
    m = _manual(s, d, "id", "text").where("text is not null")
    return m.withColumn("fixed", tx.repair_mojibake(F.col("text"))).where("fixed != text").select("id", "fixed")


# ---------------------------------------------------------------- pages, blocks, sections
@_query(r"select id, b - 1 as block, parts[b] as text from (select id, string_split_regex(text, '\r?\n') as parts from (select distinct * from product_manual_evidence) where text is not null), unnest(generate_series(1, len(parts))) as g(b) where trim(parts[b]) <> ''")
def block_explode(s, d):
    """Lines as blocks."""
    return pg.blocks(_manual(s, d, "id", "text").where("text is not null"), "text", ["id"]).withColumn("block", F.col("block").cast("long"))


@_query("""select id, c as chunk, substr(text, cast(c * 1550 + 1 as bigint), 1800) as chunk_text from (select distinct * from product_manual_evidence) e,
    unnest(generate_series(0, greatest(1, cast(ceil((length(text) - 250) / 1550.0) as bigint)) - 1)) as g(c) where length(text) > 0""")
def fixed_chunks(s, d):
    """Fixed stride."""
    return pg.fixed_chunks(_manual(s, d, "id", "text"), "text", ["id"])


# headings and registers, as windows over the blocks of a document
_LINE_SQL = rf"list_filter(list_transform(string_split_regex(x, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {_norm_sql('l')}), lambda l: l <> '')"
_CAPS_SQL = r"length(regexp_replace({0}, '[^\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')), 1)"
_SECTIONS_SQL = rf"""b as (select document_id, coalesce(page_number, -1) as page, id, n, parts[n] as x from (select *, string_split_regex(text, '\r?\n') as parts from {_MAN} where text is not null), unnest(generate_series(1, len(parts))) as g(n) where trim(parts[n]) <> ''),
    l as (select *, {_LINE_SQL} as ls from b), f as (select *, case when regexp_matches(ls[1], '{BARE_NUMBER}') and ls[2] is not null then ls[1] || ' ' || ls[2] else ls[1] end as h0 from l),
    h as (select *, case when regexp_matches(h0, '^section\s+[A-Z0-9]+\z', 'i') or (length(h0) <= 170 and not {_has_sql('h0', NO_HEADING)} and (regexp_matches(h0, '{TOP_LEVEL}', 'i') or ({_has_sql('h0', HEADING_WORDS)}
        and (regexp_matches(h0, '{NUMBERED_HEADING}', 'i') or ({_CAPS_SQL.format('h0')} >= 0.8 and len(string_split(h0, ' ')) between 2 and 18))))) then h0 end as h from f),
    r as (select *, case when {_has_sql('h', ADMIN_HEADINGS)} and (regexp_matches(h, '{TOP_LEVEL}', 'i') or {_CAPS_SQL.format('h')} >= 0.8) then h when regexp_matches(h, '{TOP_LEVEL}', 'i') then '' end as adm from h),
    c as (select document_id, page, id, n, last_value(h ignore nulls) over w as active, nullif(last_value(adm ignore nulls) over w, '') as above from r window w as (partition by document_id order by page, id, n rows unbounded preceding)),
    s as (select document_id, page, id, n, concat_ws(' > ', above, case when active is distinct from above then active end) as section from c)"""


def _carried(s, d):
    m = _manual(s, d, "document_id", "page_number", "id", "text").where("text is not null").withColumn("page_number", F.coalesce("page_number", F.lit(-1)))
    return se.carry_sections(pg.blocks(m, "text", ["document_id", "page_number", "id"]), order=("page_number", "id", "block"))


@_query(f"with {_SECTIONS_SQL} select document_id, page as page_number, id, n - 1 as block, section from s")
def section_carry_forward(s, d):
    """The section of every block."""
    return _carried(s, d).select("document_id", "page_number", "id", F.col("block").cast("long").alias("block"), "section")


@_query(f"with {_SECTIONS_SQL} select document_id, page as page_number, case when z = '' then 'RFQ page ' || page else z end as section from (select document_id, page, arg_max(section, (id, n)) as z from s group by all)")
def page_sections(s, d):
    """The section after the last block of a page, else the page."""
    return se.page_section(_carried(s, d).withColumn("at", F.struct("id", "block")), "document_id", "page_number", "at")


_GOES_ON = rf"""(length(a.cur) < 1600 and {_obliged_sql('a.cur')} and not regexp_matches(a.cur, '[.!?;]["'')\]]?\z') and not (b.cur = '' or regexp_matches(b.cur, '^\d+(?:\.\d+)*[.)]?\s+\S+\s+(?:shall|must)\b', 'i'))
    and (regexp_matches(a.cur, '{_word_sql(DANGLING)}\s*[:,-]?\z', 'i') or regexp_matches(b.cur, '^[a-z]') or regexp_matches(a.cur, '\b(?:on|in|by|from)\s*\z', 'i') or regexp_matches(a.cur, '[,(:]\s*\z')))"""


@_query(rf"""select id, unnest(generate_series(1, len(c))) as n, unnest(c) as clause from (select id, list_append(r.done, r.cur) as c from (select id, list_reduce(list_transform(string_split_regex(text, '\r?\n'), lambda x: {{'done': []::varchar[], 'cur': {_norm_sql('x')}}}),
    lambda a, b: case when {_GOES_ON} then {{'done': a.done, 'cur': a.cur || ' ' || b.cur}} else {{'done': list_append(a.done, a.cur), 'cur': b.cur}} end) as r from {_MAN} where text is not null))""")
def clause_stitching(s, d):
    """Clauses split over blocks."""
    m = _manual(s, d, "id", "text").where("text is not null")
    return m.select("id", F.posexplode(se.stitch(F.split("text", r"\r?\n"))).alias("n", "clause")).withColumn("n", (F.col("n") + 1).cast("long"))


@_query("""select document_id, string_agg(case when lo = hi then cast(lo as varchar) else lo || '-' || hi end, ',' order by lo) as ranges from (
    select document_id, min(p) as lo, max(p) as hi from (select document_id, page_number as p, page_number - row_number() over (partition by document_id order by page_number) as g
    from (select distinct document_id, page_number from product_manual_evidence where page_number is not null)) group by document_id, g) group by document_id""")
def page_ranges(s, d):
    """Pages as ranges."""
    return se.page_ranges(table(s, d, "product_manual_evidence"), "document_id", "page_number")


@_query("""with b as (select distinct job_id, start_page, end_page, status from extraction_batches where job_id is not null and start_page is not null and end_page >= start_page),
    w as (select distinct job_id, p as page from b, unnest(generate_series(start_page, end_page)) as g(p)), c as (select distinct job_id, p as page from b, unnest(generate_series(start_page, end_page)) as g(p) where lower(status) = 'completed')
    select job_id, cast(page as integer) as page from w where not exists (select 1 from c where c.job_id = w.job_id and c.page = w.page)""")
def uncovered_pages(s, d):
    """Pages of a job that no completed batch covers."""
    b = table(s, d, "extraction_batches").select("job_id", "start_page", "end_page", "status").where("job_id is not null and end_page >= start_page").distinct()
    wanted = b.select("job_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return se.uncovered(wanted, b.where("lower(status) = 'completed'"), "job_id", "page", "start_page", "end_page")


@_query(f"""with recursive m as (select document_id, id, coalesce(length(text), 0) as n, row_number() over (partition by document_id order by coalesce(page_number, 0), id) as k from {_MAN}),
    g as (select document_id, id, k, n as size, 1 as items, 0 as batch from m where k = 1 union all
    select m.document_id, m.id, m.k, case when g.items >= 12 or g.size + m.n > 12000 then m.n else g.size + m.n end, case when g.items >= 12 or g.size + m.n > 12000 then 1 else g.items + 1 end,
    case when g.items >= 12 or g.size + m.n > 12000 then g.batch + 1 else g.batch end from g join m on m.document_id = g.document_id and m.k = g.k + 1) select document_id, id, batch from g""")
def capacity_batches(s, d):
    """Batches of at most 12 records and 12,000 characters in the order of a manual."""
    m = _manual(s, d, "document_id", "page_number", "id", "text").select("document_id", F.coalesce("page_number", F.lit(0)).alias("page"), "id", F.char_length("text").alias("n"))
    return se.batch_numbers(m, "document_id", ["page", "id"], "n", 12, 12000).select("document_id", "id", "batch")


# ---------------------------------------------------------------- dedupe, joins, state
def _identity_sql(c: str) -> str:
    c = _fold_sql(c)
    for pattern, right in IDENTITY_REPAIRS:
        c = f"regexp_replace({c}, '{pattern.replace('(?=', '(')}', '{right}{chr(92) + '1' if '(?=' in pattern else ''}', 'g')"
    return f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"


_IDENT = _identity_sql("requirement_text")


@_query(f"select document_id, id from (select *, row_number() over (partition by document_id, {_IDENT} order by created_at, id) as n from {_REQ}) where n = 1")
def dedupe_exact(s, d):
    """The first requirement of each text in a document."""
    r = _req(s, d, "document_id", "requirement_text", "created_at", "id").select("document_id", "created_at", "id", dd.identity_text(F.col("requirement_text")).alias("__t"))
    return r.groupBy("document_id", "__t").agg(F.min_by("id", F.struct("created_at", "id")).alias("id")).select("document_id", "id")


@_query()
def near_duplicate(s, d):
    """Greedy near-duplicates per document and category over all pages, with numbers protected."""
    r = _req(s, d, "id", "document_id", "category", "created_at", "requirement_text")
    return dd.greedy_near_duplicates(r, ["document_id", "category"], "requirement_text", ["created_at"], "id")


@_query(f"""select id from {_REQ} r where {_fold_sql('requirement_text')} <> '' and exists (select 1 from {_REQ} p where p.document_id = r.document_id and p.page_number = r.page_number
    and contains({_fold_sql('p.source_quote')}, {_fold_sql('r.requirement_text')}))""")
def source_validation(s, d):
    """Requirements whose text stands in a quote of their page."""
    r = _req(s, d, "id", "document_id", "page_number", "requirement_text", "source_quote")
    return ca.validated(r.select("id", "document_id", "page_number", "requirement_text"), r.select("document_id", "page_number", "source_quote"), ["document_id", "page_number"], "requirement_text", "source_quote").select("id")


@_query("""select job_id, batch_index, id, status, attempts from (select *, row_number() over (partition by job_id, batch_index order by updated_at desc nulls last, attempts desc nulls last, id) as n
    from (select distinct * from extraction_batches) where job_id is not null) where n = 1""")
def latest_batches(s, d):
    """The last version of each batch."""
    b = table(s, d, "extraction_batches").distinct().where("job_id is not null")
    return dd.latest(b, ["job_id", "batch_index"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("attempts"), F.asc("id")]).select("job_id", "batch_index", "id", "status", "attempts")


@_query("""select job_id, count(*) as batches, count(*) filter (lower(trim(status)) = 'completed') as completed, count(*) filter (lower(trim(status)) = 'failed') as failed, coalesce(max(batch_index), -1) as last_index,
    cast(floor(100.0 * count(*) filter (lower(trim(status)) = 'completed') / count(*) + 0.5) as bigint) as percent from (select distinct * from extraction_batches) where job_id is not null group by job_id""")
def job_progress(s, d):
    """Counts and progress per job."""
    b = table(s, d, "extraction_batches").distinct().where("job_id is not null").withColumn("st", F.lower(F.trim("status")))
    done = F.count_if(F.col("st") == "completed")
    return b.groupBy("job_id").agg(F.count(F.lit(1)).alias("batches"), done.alias("completed"), F.count_if(F.col("st") == "failed").alias("failed"), F.coalesce(F.max("batch_index"), F.lit(-1)).alias("last_index"), cx.half_up_percent(done, F.count(F.lit(1))).alias("percent"))


@_query("select job_id, cast(sum(json_array_length(requirements_json)) as bigint) as requirements from (select distinct * from extraction_batches) where job_id is not null and json_valid(requirements_json) and json_type(requirements_json) = 'ARRAY' group by job_id")
def requirements_found(s, d):
    """Array lengths summed per job."""
    b = table(s, d, "extraction_batches").distinct().where("job_id is not null").withColumn("n", F.json_array_length("requirements_json")).where("n is not null")
    return b.groupBy("job_id").agg(F.sum("n").cast("long").alias("requirements"))


@_query("""select b.id, b.job_id from (select distinct id, job_id from extraction_batches) b where exists (select 1 from extraction_jobs j where j.id = b.job_id and j.pipeline_version = (select max(pipeline_version) from extraction_jobs))""")
def stale_guard(s, d):
    """Batches of jobs of the current pipeline version."""
    j = table(s, d, "extraction_jobs").select(F.col("id").alias("job_id"), "pipeline_version")
    top = j.agg(F.max("pipeline_version").alias("pipeline_version"))
    return st.guard(table(s, d, "extraction_batches").select("id", "job_id").distinct(), j.join(F.broadcast(top), "pipeline_version"), ["job_id"])


@_query("""select document_id, count(*) as rows, sum(cast('0x' || substr(m, 1, 16) as ubigint))::varchar || ':' || sum(cast('0x' || substr(m, 17, 16) as ubigint))::varchar as digest
    from (select document_id, md5(concat_ws(chr(31), coalesce(id, chr(0)), coalesce(requirement_text, chr(0)), coalesce(cast(page_number as varchar), chr(0)))) as m from (select distinct * from requirements)) group by document_id""")
def input_fingerprint(s, d):
    """Fingerprint per document, in any row order."""
    return st.fingerprint(_req(s, d, "document_id", "id", "requirement_text", "page_number"), ["document_id"], ["id", "requirement_text", "page_number"])


@_query("""select entity_type, entity_id, action, created_at from (select *, row_number() over (partition by entity_type, entity_id order by created_at desc nulls last, id) as n from (select distinct * from audit_events)) where n = 1""")
def audit_latest(s, d):
    """The last audit action of each entity."""
    return dd.latest(table(s, d, "audit_events").distinct(), ["entity_type", "entity_id"], [F.desc_nulls_last("created_at"), F.asc("id")]).select("entity_type", "entity_id", "action", "created_at")


# ---------------------------------------------------------------- summaries
_DECISION = "case lower(trim(decision)) when 'compliant' then 'Compliant' when 'conditional' then 'Conditional' when 'non-compliant' then 'Non-compliant' else 'Unknown' end"


@_query(f"select coalesce(d, 'all') as decision, count(*) as assessments from (select {_DECISION} as d from {_ASSESSED}) group by rollup (d)")
def decision_counts(s, d):
    """Counts with the total, in one pass."""
    r = _ass(s, d, "id", "decision").select(cx.decision(F.col("decision")).alias("decision")).rollup("decision").agg(F.count(F.lit(1)).alias("assessments"), F.grouping_id().alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("decision")).alias("decision"), "assessments")


@_query(f"""select compliance_job_id, count(*) filter (d = 'Compliant') as compliant, count(*) filter (d in ('Conditional', 'Non-compliant')) as exceptions, count(*) filter (d = 'Unknown') as unresolved,
    cast(floor(100.0 * count(*) filter (d <> 'Unknown') / count(*) + 0.5) as bigint) as coverage from (select *, {_DECISION} as d from {_ASSESSED}) group by compliance_job_id""")
def kpis(s, d):
    """Key figures per run."""
    c = _ass(s, d, "id", "decision", "compliance_job_id").withColumn("d", cx.decision(F.col("decision")))
    known = F.count_if(F.col("d") != "Unknown")
    return c.groupBy("compliance_job_id").agg(F.count_if(F.col("d") == "Compliant").alias("compliant"), F.count_if(F.col("d").isin("Conditional", "Non-compliant")).alias("exceptions"), F.count_if(F.col("d") == "Unknown").alias("unresolved"), cx.half_up_percent(known, F.count(F.lit(1))).alias("coverage"))


_JOINED = f"(select r.*, a.id as aid, a.decision as dec, a.product_name as product from {_ASSESSED} a join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id)))"


@_query(f"""with j as (select solution_package as p, subcategory as s, compliance_object as o, aid, case lower(trim(dec)) when 'compliant' then 'c' when 'conditional' then 'k' when 'non-compliant' then 'n' else 'u' end as d from {_JOINED}),
    ob as (select p, s, string_agg(o, '|' order by n) as objects from (select p, s, o, row_number() over (partition by p, s order by f, o) as n from (select p, s, o, min(aid) as f from j where o <> '' group by p, s, o)) where n <= 12 group by p, s)
    select j.p as solution_package, j.s as subcategory, count(*) as requirements, count(*) filter (d = 'c') as compliant, count(*) filter (d = 'k') as conditional, count(*) filter (d = 'n') as non_compliant, count(*) filter (d = 'u') as unknown, any_value(ob.objects) as objects
    from j left join ob on ob.p = j.p and ob.s = j.s where j.p is not null and j.s is not null group by j.p, j.s""")
def solution_context(s, d):
    """Bounded summary per package and subcategory."""
    a = _ass(s, d, "id", "requirement_id", "decision", "product_name").select(F.col("id").alias("aid"), norm_key("requirement_id").alias("k"), "decision", F.col("product_name"))
    r = _req(s, d, "id", "solution_package", "subcategory", "compliance_object", "requirement_text").select(norm_key("id").alias("k"), "solution_package", "subcategory", "compliance_object", "requirement_text").where("solution_package is not null and subcategory is not null")
    out = cx.solution_context(a.join(r, "k"), ["solution_package", "subcategory"], "aid", "compliance_object", "product_name", "requirement_text")
    return out.select("solution_package", "subcategory", "requirements", "compliant", "conditional", "non_compliant", "unknown", "objects")


@_query(f"""select a.id, coalesce(r.requirement_key, '') as requirement_key, coalesce(r.package_order, 99) as package_order, coalesce(r.page_number, 9999) as page_number, {_DECISION.replace('decision', 'a.decision')} as decision, a.product_name
    from {_ASSESSED} a left join {_REQ} r on lower(trim(a.requirement_id)) = lower(trim(r.id))""")
def compliance_matrix(s, d):
    """Assessments with their requirement, missing ones kept with defaults."""
    a = _ass(s, d, "id", "requirement_id", "decision", "product_name").select("id", norm_key("requirement_id").alias("k"), cx.decision(F.col("decision")).alias("decision"), "product_name")
    r = _req(s, d, "id", "requirement_key", "package_order", "page_number").select(norm_key("id").alias("k"), "requirement_key", "package_order", "page_number")
    return a.join(r, "k", "left").select("id", F.coalesce("requirement_key", F.lit("")).alias("requirement_key"), F.coalesce("package_order", F.lit(99)).alias("package_order"), F.coalesce("page_number", F.lit(9999)).alias("page_number"), "decision", "product_name")


@_query(f"select id, n as position from (select id, row_number() over (order by package_order nulls last, subcategory_order nulls last, page_number nulls last, requirement_key nulls last, id) as n from {_REQ}) where n between 21 and 40")
def paged_results(s, d):
    """The second page of twenty in narrative order; the limit is the feature."""
    order = [F.asc_nulls_last(c) for c in ("package_order", "subcategory_order", "page_number", "requirement_key", "id")]
    return page_of(_req(s, d, "id", "package_order", "subcategory_order", "page_number", "requirement_key"), order, 2).select("id", "position")


# ---------------------------------------------------------------- vectors, events
@_query("""select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, c.vec_id, round(list_dot_product(q.embedding::double[], c.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(c.embedding::double[], c.embedding::double[]))), 6) as score
    from embeddings q, embeddings c where q.vec_id % 100 = 0)) where rank <= 10""")
def vector_topk(s, d):
    """Exact top 10 of every hundredth vector against all."""
    e = table(s, d, "embeddings")
    return top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)


@_query("select event_type, cast(json_extract_string(props, '$.k') as varchar) as k, count(*) as events from events group by all")
def json_payload(s, d):
    """Members of JSON payloads."""
    return table(s, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("events"))


@_query("select event_type, count(*) as events, round(sum(value), 2) as total from events group by event_type")
def stream_resume(s, d):
    """A resumable stream gives what a batch gives."""
    return counted_by_type(s, f"{d}/events.parquet")
