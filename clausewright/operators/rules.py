"""Ordered rule tables compiled into one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.fixed import CATEGORIES as CATEGORY
from clausewright.functions.text import any_word, has

# Lanes of the evidence scopes; all others go to the engineer.
LANES = {"product_manual": "product", "hybrid": "product", "test_report": "testing", "engineering_deliverable": "deliverables", "system_design": "design"}


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule one of whose alternatives occurs."""
    out = None
    for label, words in rules:
        cond = has(text, any_word(words))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def lane(scope: Column) -> Column:
    """Lane of an evidence scope."""
    out = None
    for k, v in LANES.items():
        out = F.when(scope == k, v) if out is None else out.when(scope == k, v)
    return out.otherwise("engineer")
