"""Record-level operators: evidence packing, citation checks, edits, replacement, evaluators and routing tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.text import fold


def stable_id(*parts: Column) -> Column:
    """Reproducible id of a natural key."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def pack_evidence(df: DataFrame, key: str, text: str, score: str, rank: str, most: int = 4, chars: int = 1400) -> DataFrame:
    """key + (evidence): at most `most` items E1.. by rank, texts cut, scores rounded (P21, O2); bounded before it is gathered."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.asc(rank)))
    top = df.withColumn("__n", n).where(F.col("__n") <= most)
    item = F.struct(F.col("__n").alias("n"), F.concat(F.lit("E"), F.col("__n").cast("string")).alias("evidence_id"), F.substring(text, 1, chars).alias("text"), F.round(score, 4).alias("score"))
    return top.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def resolve_ids(cited: Column, allowed: Column) -> Column:
    """The cited ids that are allowed, once each, in the order cited (P20)."""
    return F.filter(F.array_distinct(cited), lambda x: F.array_contains(allowed, x))


def gate_score(vector: Column, lexical: Column, weight: float = 0.7, other: float = 0.3) -> Column:
    """Weighted similarity, four places, halves up."""
    return F.floor((F.lit(weight) * vector + F.lit(other) * lexical) * 10000 + 0.5) / 10000


def validate_citations(citations: DataFrame, sources: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """citations + (valid): whether the folded quote stands in some source of its key.

    Sources meet citations only within their key; the first hit ends it by a semi-join.
    """
    c = citations.withColumn("__q", fold(F.col(quote)))
    s = sources.select(F.col(key).alias("__k"), fold(F.col(text)).alias("__t"))
    good = (F.col(key) == F.col("__k")) & F.contains(F.col("__t"), F.col("__q")) & (F.col("__q") != "")
    hit, miss = c.join(s, good, "left_semi"), c.join(s, good, "left_anti")
    return hit.withColumn("valid", F.lit(True)).unionByName(miss.withColumn("valid", F.lit(False))).drop("__q")


def apply_edits(df: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the non-blank values of the edits."""
    e = edits.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(e, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(f"__{c}").cast("string")), F.lit("")).cast(df.schema[c].dataType), F.col(c)))
    return out.select(*df.columns)


def replace_preserving(new: DataFrame, old: DataFrame, key: list[str], order: str, keep: list[str]) -> DataFrame:
    """new rows with the `keep` columns of the old row at the same place among the rows of its key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    o = old.withColumn("__n", n).select(*key, "__n", *[F.col(c).alias(f"__{c}") for c in keep])
    j = new.withColumn("__n", n).join(o, [*key, "__n"], "left")
    return j.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])


def route(df: DataFrame, rules: list[tuple[Column, dict[str, Column]]], default: dict[str, Column]) -> DataFrame:
    """df + the outcome columns of the first rule that holds: a decision table given as data (M1 to M4)."""
    out = df
    for name, other in default.items():
        chain = None
        for cond, outcome in rules:
            value = outcome.get(name, other)
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        out = out.withColumn(name, other if chain is None else chain.otherwise(other))
    return out


def evaluate(df: DataFrame, eligible: Column, evaluator: Callable[[pd.DataFrame], pd.DataFrame], schema: str, ineligible: dict[str, Column]) -> DataFrame:
    """The evaluator over the eligible rows, in Arrow batches, and fixed outcomes for the rest.

    The rows are split first, so the evaluator never sees an ineligible one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield evaluator(b)

    ok = F.coalesce(eligible, F.lit(False))
    done = df.where(ok).mapInPandas(run, schema)
    rest = df.where(~ok).withColumns(ineligible)
    return done.unionByName(rest.select(*[F.col(c).cast(done.schema[c].dataType) for c in done.columns]))


def upsert_vectors(index: DataFrame | None, chunks: DataFrame, key: str, seq: str) -> DataFrame:
    """The index with the last version of every chunk, by a stable point id."""
    fresh = chunks.withColumn("point_id", stable_id(F.col(key)))
    every = fresh if index is None else index.unionByName(fresh, allowMissingColumns=True)
    return every.withColumn("__n", F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc_nulls_last(seq)))).where("__n = 1").drop("__n")


def ui_punctuation(c: Column) -> Column:
    """Em dash to comma, en dash to hyphen."""
    return F.translate(c, "—–", ",-")


Work = Callable[[pd.DataFrame], str]


def with_fallback(workers: list[Work], bisect: bool = True) -> Work:
    """Work that tries each worker in turn; where all fail, the halves of the batch are tried on their own (M7).

    The results of halves are joined by line ends.  A single row that fails everywhere raises the last error.
    """

    def work(rows: pd.DataFrame) -> str:
        last: Exception | None = None
        for w in workers:
            try:
                return w(rows)
            except Exception as e:  # noqa: BLE001  # whatever a worker fails with, the next one is tried
                last = e
        if not bisect or len(rows) < 2:
            raise last or ValueError("no worker")
        half = len(rows) // 2
        return "\n".join(work(part) for part in (rows.iloc[:half], rows.iloc[half:]))

    return work


def run_isolated(df: DataFrame, batch: str, order: list[str], work: Work) -> DataFrame:
    """(batch, status, result, error): the work of each batch, by itself: one that fails leaves the others alone (T4).

    Batches are small by their making; a worker holds one of them at a time.
    Null batches are left out.
    """
    d = df.where(F.col(batch).isNotNull())
    schema = T.StructType([d.schema[batch], *[T.StructField(n, T.StringType()) for n in ("status", "result", "error")]])

    def one(rows: pd.DataFrame) -> tuple:
        key = rows[batch].iloc[0]
        try:
            return key, "completed", work(rows.reset_index(drop=True)), None
        except Exception as e:  # noqa: BLE001  # the error is the result
            return key, "failed", None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
                if rest.empty:
                    continue
                last = int((rest[batch] != rest[batch].iloc[-1]).sum())
                whole, rest = rest.iloc[:last], rest.iloc[last:]
            else:
                whole, rest = rest, None
            if whole is not None and len(whole):
                yield pd.DataFrame([one(g) for _, g in whole.groupby(batch, sort=False)], columns=schema.names)

    return d.repartition(batch).sortWithinPartitions(batch, *order).mapInPandas(run, schema)


def job_outcome(runs: DataFrame, key: list[str]) -> DataFrame:
    """key + (completed, failed, status): a job has failed if one of its batches has."""
    failed = F.count_if(F.col("status") == "failed")
    return runs.groupBy(*key).agg(F.count_if(F.col("status") == "completed").alias("completed"), failed.alias("failed"), F.when(failed > 0, "failed").otherwise("completed").alias("status"))
