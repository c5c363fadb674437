"""Grouped summaries of classified and assessed requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.session import cut


def decision(c: Column) -> Column:
    """Decision names in one spelling; anything else is Unknown."""
    d = F.lower(F.trim(c))
    return F.when(d == "compliant", "Compliant").when(d == "conditional", "Conditional").when(d == "non-compliant", "Non-compliant").otherwise("Unknown")


def _firsts(rows: DataFrame, group: list[str], value: str, order: str, n: int, name: str, unique: bool) -> DataFrame:
    """Per group the first n values in order; unique keeps the first place of each value."""
    v = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"), F.col(order).alias("o"))
    if unique:
        v = v.groupBy(*group, "v").agg(F.min("o").alias("o"))
    r = v.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("o", "v"))).where(F.col("n") <= n)
    return r.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(name))


def solution_context(rows: DataFrame, group: list[str], order: str, objects: str, products: str, text: str, most_objects: int = 12, samples: int = 4, unresolved: int = 6, sample_chars: int = 400, evidence: str | None = None, per_row: int = 2, most_evidence: int = 6, quote_chars: int = 350) -> DataFrame:
    """group + (requirements, one count per decision, objects, products, samples, unresolved[, evidence]); lists of texts are joined by |.

    evidence: column of array<struct<file_name, location, quote>>; at most
    `per_row` of a row count, each different one once.  Every list is bounded
    per group before it is gathered, so no group grows with the data; the input
    is written once and read for each list.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    d = rows.withColumn("decision", decision(F.col("decision"))).withColumns({"__s": F.substring(F.coalesce(F.col(text), F.lit("")), 1, sample_chars), "__ob": blank(objects), "__pr": blank(products)})
    d = cut(d.select(*group, "decision", order, "__s", "__ob", "__pr", *([F.slice(evidence, 1, per_row).alias("__e")] if evidence else [])), "context")
    out = d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("requirements"),
        *[F.count_if(F.col("decision") == x).alias(n) for x, n in (("Compliant", "compliant"), ("Conditional", "conditional"), ("Non-compliant", "non_compliant"), ("Unknown", "unknown"))],
    )
    parts = [
        _firsts(d, group, "__ob", order, most_objects, "objects", True),
        _firsts(d, group, "__pr", order, most_objects, "products", True),
        _firsts(d, group, "__s", order, samples, "samples", False),
        _firsts(d.where("decision in ('Non-compliant', 'Unknown')"), group, "__s", order, unresolved, "unresolved", False),
    ]
    parts = [p.withColumn(p.columns[-1], F.array_join(F.col(p.columns[-1]), "|")) for p in parts]
    if evidence:
        e = d.select(*group, order, F.posexplode("__e").alias("__n", "x"))
        item = F.struct("x.file_name", "x.location", F.substring(F.coalesce("x.quote", F.lit("")), 1, quote_chars).alias("quote"))
        parts.append(_firsts(e.select(*group, F.struct(order, "__n").alias("o2"), item.alias("e")), group, "e", "o2", most_evidence, "evidence", True))
    for p in parts:
        out = out.join(p, group, "left")
    return out


def package_tree(rows: DataFrame, package: str, part: str, package_order: str, part_order: str) -> DataFrame:
    """(package, package_order, parts): two levels in order, each ordered by its least order, then by name."""
    inner = rows.groupBy(package, part).agg(F.min(package_order).alias("__p"), F.min(part_order).alias("__s"), F.count(F.lit(1)).alias("requirements"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("__s", F.lit(99)).alias("o"), F.col(part).alias("name"), "requirements"))), lambda x: F.struct(x["name"].alias("name"), x["requirements"].alias("requirements")))
    return inner.groupBy(package).agg(F.coalesce(F.min("__p"), F.lit(99)).alias("package_order"), listed.alias("parts"))


def half_up_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up, 0 for nothing."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5)).otherwise(F.lit(0)).cast("long")


def half_even_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to even, 0 for nothing."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole)).otherwise(F.lit(0)).cast("long")
