"""Fingerprints, resumable runs and guards over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digests(columns: list[Column]) -> list[Column]:
    """Two unsigned 64-bit numbers of a row's canonical text."""
    text = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))
    return [F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def fingerprint(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key + (rows, digest): of the rows in any order; combined map-side, so no group is gathered.

    digest: the sums of two 64-bit halves of the rows' MD5.  Equal rows have
    equal digests; different ones are told apart but for collisions of both
    sums, about one in 2^128 by chance (MD5 isn't proof against intent).
    """
    a, b = row_digests([F.col(c) for c in columns])
    digest = F.concat_ws(":", *[F.sum(x).cast("string") for x in (a, b)])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def stale(stored: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """key of the stored fingerprints that the current inputs no longer have."""
    return stored.join(current, [*key, "rows", "digest"], "left_anti").select(*key)


def require(ok: Column, message: str) -> Column:
    """True, or an error when a row is read that doesn't meet the condition."""
    return F.when(ok, True).otherwise(F.raise_error(message).cast("boolean"))


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The planned batches that no completed batch covers."""
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def guard(writes: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """The writes that belong to a current run; stale ones fall out before anything is replaced."""
    return writes.join(current.select(*on).distinct(), on, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
