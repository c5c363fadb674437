"""Retrieved evidence: gates, bounded packing, citations and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import containment, hard_values, material_overlap, material_tokens, tokens
from clausewright.operators.records import gate_score


def gated_evidence(requirements: DataFrame, retrieved: DataFrame, key: str, need: str, text: str, score: str, rank: str, least_score: float = 0.52, least_overlap: float = 0.16, most: int = 4) -> DataFrame:
    """retrieved + (lexical_overlap, material_overlap, prematch_score, place): the evidence that passes, at most `most` per requirement.

    Passes: vector score and lexical overlap reach their bounds, some material
    token is shared where there are any, and every number needed is there.
    Places follow the rounded score, then the rank of the retrieval.  A score
    that is null or not a number passes nothing.
    """
    r = requirements.select(F.col(key), tokens(F.col(need)).alias("__n"), material_tokens(F.col(need)).alias("__m"))
    e = retrieved.withColumns({"__h": tokens(F.col(text)), "__mh": material_tokens(F.col(text))})
    j = e.join(r, key).withColumns({"__o": containment(F.col("__n"), F.col("__h")), "__mo": material_overlap(F.col("__m"), F.col("__mh"))})
    good = j.where((F.col(score) >= least_score) & ~F.isnan(score) & (F.col("__o") >= least_overlap) & hard_values(F.col("__m"), F.col("__mh")))
    s = good.select(*[F.col(c) for c in retrieved.columns], F.round("__o", 4).alias("lexical_overlap"), F.round("__mo", 4).alias("material_overlap"), gate_score(F.col(score), F.col("__o")).alias("prematch_score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("prematch_score"), F.asc(rank)))
    return s.withColumn("place", place).where(F.col("place") <= most)


def packed_evidence(gated: DataFrame, key: str, columns: list[str], text: str, chars: int = 1400) -> DataFrame:
    """key + (evidence): items E1.. in order of place, texts cut (P21); `most` of the gate bounds the list."""
    item = F.struct("place", F.concat(F.lit("E"), F.col("place").cast("string")).alias("evidence_id"), *columns, F.substring(text, 1, chars).alias("text"))
    listed = F.array_sort(F.collect_list(item))
    return gated.groupBy(key).agg(F.transform(listed, lambda x: x.dropFields("place")).alias("evidence"))


def with_evidence(requirements: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """requirements + (evidence), an empty list where none was found."""
    kind = packed.schema["evidence"].dataType.simpleString()
    return requirements.join(packed, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def alternate(product: Column, rationale: Column) -> Column:
    """A struct of the alternate only where a product is named, its rationale '' by default (K4)."""
    return F.when(product.isNotNull() & (product != ""), F.struct(product.alias("product_name"), F.coalesce(rationale, F.lit("")).alias("rationale")))


def calibrated(confidence: Column, scores: Column, decision: Column) -> Column:
    """A confidence of 0 replaced: the best score of the selected evidence in percent, halves to even, else 70 for Unknown."""
    known = F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x))
    best = F.bround(F.array_max(known) * 100).cast("int")
    return F.when(confidence != 0, confidence).when(F.size(known) > 0, best).when(decision == "Unknown", F.lit(70)).otherwise(confidence)


def merged_metrics(batches: DataFrame, key: str, metrics: str) -> DataFrame:
    """(key, metric, total): the counters of all batches of a job summed (A4)."""
    return batches.select(key, F.explode(metrics).alias("metric", "n")).groupBy(key, "metric").agg(F.sum("n").alias("total"))
