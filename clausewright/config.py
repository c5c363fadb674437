"""Settings with their defaults; the session may override each."""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession


@dataclasses.dataclass(frozen=True)
class Settings:
    """Bounds of chunking, retrieval, gates and batches."""

    chunk_size: int = 1800
    chunk_overlap: int = 250
    retrieval_limit: int = 10
    evidence_limit: int = 4
    vector_threshold: float = 0.52
    lexical_threshold: float = 0.16
    pages_per_batch: int = 12
    characters_per_batch: int = 12000
    requirements_per_batch: int = 8

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The settings of a session: spark.clausewright.<name> where set, else the default."""
        given = {f.name: spark.conf.get(f"spark.clausewright.{f.name}", None) for f in dataclasses.fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})
