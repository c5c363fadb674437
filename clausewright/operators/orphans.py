"""References to records that do not exist.

Method: fixpoint cascade.  Every foreign key gives its direct orphans by a
join with the parent keys; records that refer to an orphaned record are then
marked as inheriting, level by level down the foreign-key graph, until a
level adds nothing.

A valid parent has the key (trimmed, without regard to case), is not marked
deleted and was created no later than the child.  Defined results: a null or
blank reference is no orphan; a parent without a time counts as always
there; a child without a time is an orphan only if no valid parent has its
key; repeated records count once; empty parent tables make every reference
an orphan.  Parents are first reduced to one row per key (the earliest valid
time), so a hot key on the child side meets one parent row, and where the
parents are too many to broadcast, the rows of hot keys are spread over salts.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.session import BROADCAST_BYTES, cut, join_checked, norm_key, rows_up_to


@dataclass(frozen=True)
class ForeignKey:
    """child.column names a row of parent; times and deletion marks are columns."""

    child: str
    column: str
    child_time: str
    parent: str
    parent_time: str = "created_at"
    parent_status: str = "status"
    key: str = "id"


def valid_parents(parents: DataFrame, fk: ForeignKey) -> DataFrame:
    """(ref, since): one row per key that has a row not marked deleted, with the earliest time of such rows."""
    p = parents.select(norm_key(fk.key).alias("ref"), F.col(f"`{fk.parent_time}`").alias("since"), norm_key(fk.parent_status).alias("mark"))
    p = p.where(F.col("ref").isNotNull() & (F.coalesce(F.col("mark"), F.lit("")) != "deleted"))
    return p.groupBy("ref").agg(F.when(F.count("since") == F.count(F.lit(1)), F.min("since")).alias("since"))


def direct_orphans(children: DataFrame, parents: DataFrame, fk: ForeignKey, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(table_name, row_id, ref, at, reason) of the child rows without a valid parent; reason: missing or later.

    Rows deleted and rows that never were can't be told apart by their key alone; both are `missing`.
    """
    c = children.select(F.col(f"`{fk.key}`").alias("row_id"), norm_key(fk.column).alias("ref"), F.col(f"`{fk.child_time}`").alias("at")).where("ref is not null")
    p = valid_parents(parents, fk).withColumn("there", F.lit(True))
    j = join_checked(c, p, ["ref"], "left", broadcast_bytes)
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("since") > F.col("at"), "later")
    return j.select(F.lit(fk.child).alias("table_name"), "row_id", "ref", "at", reason.alias("reason")).where("reason is not null")


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(table_name, row_id, ref, at, kind, level): direct orphans at level 0 and those that inherit at the level reached first.

    Each level is written to the shared folder, so that a lost executor costs no
    earlier level.  The loop ends when a level adds no row or no key leads further, so the number of
    levels is at most the longest path of the foreign-key graph, or, for graphs
    with cycles, the longest chain of records; nothing else bounds it.
    """
    direct = None
    for fk in keys:
        d = direct_orphans(tables[fk.child], tables[fk.parent], fk)
        direct = d if direct is None else direct.unionByName(d)
    direct = direct.select("table_name", "row_id", "ref", "at", F.lit("direct").alias("kind"), F.lit(0).alias("level")).distinct()
    known = cut(direct, "orphans-0")
    frontier, found = known, known
    reached = {fk.child for fk in keys}  # the tables that the last level may have rows of
    for level in itertools.count(1):
        parts = None
        active = [fk for fk in keys if fk.parent in reached]
        if not active:
            break
        reached = {fk.child for fk in active}
        for fk in active:
            bad = frontier.where(F.col("table_name") == fk.parent).select(norm_key("row_id").alias("ref")).where("ref is not null").distinct()
            c = tables[fk.child].select(F.col(f"`{fk.key}`").alias("row_id"), norm_key(fk.column).alias("ref"), F.col(f"`{fk.child_time}`").alias("at")).where("ref is not null")
            part = join_checked(c, bad, ["ref"], "inner").select(F.lit(fk.child).alias("table_name"), "row_id", "ref", "at")
            parts = part if parts is None else parts.unionByName(part)
        fresh = parts.distinct().join(found.select("table_name", "row_id").hint("merge"), ["table_name", "row_id"], "left_anti")
        fresh = cut(fresh.select("table_name", "row_id", "ref", "at", F.lit("inherited").alias("kind"), F.lit(level).alias("level")), f"orphans-{level}")
        if rows_up_to(fresh, 0) == 0:
            break
        found, frontier = found.unionByName(fresh), fresh
    return found


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(table_name, period, kind, orphans): counts per table and month of the child's time; period is null where it has none."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    return orphans.groupBy("table_name", period, "kind").agg(F.count_distinct("row_id").alias("orphans"))


#: The references of this project's tables.
PROJECT_KEYS = [
    ForeignKey("assessments", "requirement_id", "created_at", "requirements", parent_status="review_status"),
    ForeignKey("requirements", "document_id", "created_at", "source_documents"),
    ForeignKey("extraction_batches", "job_id", "updated_at", "extraction_jobs"),
]
