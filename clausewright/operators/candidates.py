"""Requirement candidates from the blocks and tables of pages, and what becomes of them.

Pages are told by document and number.  Every predicate looks at one row, so
the order in which they apply doesn't matter; duplicates of a page fall to the
first by an aggregate that combines map-side.  Defined results: null texts
give no candidate; a null page number stands for a page of its own; repeated
blocks give one candidate.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.fixed import ACCEPTED, CATEGORIES, MANDATORY, TECHNICAL_TERMS
from clausewright.functions.text import any_word, complete, fold, garbled, has, modal, normalize, obligation, page_signals, relevant, repair, sentences, value_or_standard
from clausewright.operators.rules import first_match
from clausewright.sources.pages import table_text

Excluded = Callable[[Column, Column], Column]
_NONE: Excluded = lambda section, quote: F.lit(False)


def explicit_clause(quote: Column, section: Column, excluded: Excluded = _NONE) -> Column:
    """Whether a sentence is a technical obligation that stands alone (F8).

    excluded: contexts of a project's own that count for nothing, by section and quote.
    """
    n = F.length(quote)
    stub = quote.endswith(":") & (n < 300)
    heading_only = has(quote, r"\bscope of\s*work\b") & ~modal(quote)
    return n.between(25, 1600) & ~stub & ~excluded(section, quote) & obligation(quote) & ~heading_only & has(quote, any_word(TECHNICAL_TERMS)) & complete(quote)


def table_clause(quote: Column, section: Column, excluded: Excluded = _NONE) -> Column:
    """Whether the text of a table states technical values."""
    index = has(quote, r"\b(?:table of contents|page\s+no\.?|price schedule)\b")
    return F.length(quote).between(20, 6000) & ~excluded(section, quote) & ~index & (has(quote, any_word(TECHNICAL_TERMS)) | value_or_standard(quote))


_AT = ["document_id", "page_number"]


def _numbered(found: DataFrame) -> DataFrame:
    """Candidate rows of (document_id, page_number, pass, at, type, quote, section, bbox), first of each quote of a page and pass."""
    one = found.groupBy(*_AT, "pass", F.lower("quote").alias("__k")).agg(F.min_by(F.struct("at", "type", "quote", "section", "bbox"), "at").alias("c")).select(*_AT, "pass", "c.*")
    n = F.row_number().over(Window.partitionBy(*_AT, "pass").orderBy("at")) - 1
    name = F.concat(F.lit("p"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit("-"), F.col("type"), F.lit("-"), n.cast("string"))
    return one.select(
        *_AT, "pass", "at", name.alias("candidate_id"), F.col("type").alias("candidate_type"), "section", F.col("quote").alias("source_quote"), F.col("bbox").alias("source_bbox"),
        first_match(F.col("quote"), CATEGORIES, "Technical").alias("category"),
        F.when(has(F.col("quote"), any_word(MANDATORY)), "Mandatory").otherwise("Preferred").alias("criticality"),
        F.when(F.col("type") == "explicit", 92).otherwise(65).alias("confidence"),
    )


def explicit_candidates(blocks: DataFrame, excluded: Excluded = _NONE) -> DataFrame:
    """Candidates of the sentences of blocks (document_id, page_number, block, text, section, bbox), stitched before where wanted.

    block: of any type that has an order; the place among the blocks of the page.
    """
    s = blocks.select(*_AT, "block", "section", "bbox", F.posexplode(sentences(normalize(F.col("text")))).alias("n", "__s"))
    s = s.withColumn("quote", normalize(F.col("__s"))).where(explicit_clause(F.col("quote"), F.col("section"), excluded))
    kind = F.when(garbled(repair(F.col("quote"))), "ambiguous").otherwise("explicit")
    return _numbered(s.select(*_AT, F.lit(0).alias("pass"), F.struct("block", "n").alias("at"), kind.alias("type"), "quote", "section", "bbox"))


def table_candidates(tables: DataFrame, excluded: Excluded = _NONE) -> DataFrame:
    """Candidates of tables (document_id, page_number, block, header, rows, section, bbox)."""
    t = tables.withColumn("quote", table_text(F.transform("header", normalize), F.transform("rows", lambda r: F.transform(r, normalize))))
    t = t.where(table_clause(F.col("quote"), F.col("section"), excluded)).withColumn("quote", normalize(F.col("quote")))
    return _numbered(t.select(*_AT, F.lit(1).alias("pass"), F.struct("block", F.lit(0).alias("n")).alias("at"), F.lit("table").alias("type"), "quote", "section", "bbox"))


def merged_candidates(*passes: DataFrame) -> DataFrame:
    """The candidates of all passes, first of each quote of a page, earlier passes first."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    rest = [c for c in every.columns if c not in _AT]
    one = every.groupBy(*_AT, fold(F.col("source_quote")).alias("__k")).agg(F.min_by(F.struct(*rest), F.struct("pass", "at")).alias("c"))
    return one.select(*_AT, "c.*")


def direct_requirements(candidates: DataFrame) -> DataFrame:
    """Requirement rows of candidates that need no interpretation: repaired text, verbatim quote."""
    quote = normalize(F.col("source_quote"))
    return candidates.select(*_AT, F.lit("").alias("requirement_key"), "section", repair(quote).alias("requirement_text"), quote.alias("source_quote"), "source_bbox", "category", "criticality", "confidence")


def relevant_pages(pages: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """pages + (obligations, technical, tables): those with a candidate or with enough signals."""
    has_one = candidates.select(*_AT, F.lit(True).alias("__has")).distinct()
    j = pages.withColumn("__x", page_signals(F.coalesce(F.col(text), F.lit("")))).join(has_one.hint("merge"), _AT, "left")
    keep = F.col("__has") | relevant(F.col("__x"))
    return j.where(keep).select(*[F.col(c) for c in pages.columns], *[F.col(f"__x.{c}").cast("long").alias(c) for c in ("obligations", "technical", "tables")])


def open_characters(candidates: DataFrame) -> DataFrame:
    """(document_id, page_number, open_chars): length of the quotes of a page that need interpretation."""
    return candidates.where("candidate_type <> 'explicit'").groupBy(*_AT).agg(F.sum(F.length("source_quote")).alias("open_chars"))


def batch_complexity(batches: DataFrame, key: list[str], flag: str | None = None) -> DataFrame:
    """key + (pages, obligations, technical, tables, complex): sums of the signals of a batch's pages."""
    marked = F.bool_or(F.coalesce(F.col(flag), F.lit(False))) if flag else F.lit(False)
    o, t, b = (F.sum(c) for c in ("obligations", "technical", "tables"))
    return batches.groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), o.alias("obligations"), t.alias("technical"), b.alias("tables"), (marked | (b >= 30) | (o >= 35) | (t >= 100)).alias("complex"))


def accepted_decisions(decisions: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """Requirement rows of decisions (on + accept, requirement_text, category, criticality, confidence) on known candidates.

    Quote, page and box come from the candidate; the text must oblige or state a capability.
    """
    d = decisions.where(F.coalesce(F.col("accept"), F.lit(False)) & (F.trim("requirement_text") != "") & has(F.col("requirement_text"), any_word(ACCEPTED)))
    c = candidates.select(*on, *[x for x in ("section", "source_quote", "source_bbox") if x in candidates.columns])
    d = d.select(*on, F.trim("requirement_text").alias("requirement_text"), "category", "criticality", F.least("confidence", F.lit(88)).alias("confidence"))
    return d.join(c, on)


def validated(items: DataFrame, pages: DataFrame, on: list[str], quote: str = "source_quote", text: str = "text") -> DataFrame:
    """The items whose folded quote stands in the folded text of their page."""
    p = pages.select(*[F.col(c).alias(f"__{c}") for c in on], fold(F.col(text)).alias("__t"))
    i = items.withColumn("__q", fold(F.col(quote))).where("__q <> ''")
    same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in on])
    return i.join(p, same & F.contains("__t", "__q"), "left_semi").drop("__q")


def numbered_requirements(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """items + (requirement_key): REQ-001, REQ-002 ... in the order of each group; more digits past 999."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return items.withColumn("requirement_key", F.concat(F.lit("REQ-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))
