"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(app: str = "clausewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; settings given by the cluster win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; only then do they share the machine's folders."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="clausewright-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; in local mode, where that is unset, a folder that ends with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/clausewright-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, uri: str) -> tuple:
    """The file system of a URI and its path there."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames that were returned can't be read any more."""
    fs, path = _path(spark, shared_dir(spark))
    fs.delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clausewright_cut = True
    return out


def rows_up_to(df: DataFrame, bound: int) -> int:
    """The number of rows, counted no further than bound + 1."""
    return df.limit(bound + 1).count()


def extent(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame whose columns are texts and plain values."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) + 24 if isinstance(f.dataType, T.StringType) else F.lit(16) for f in df.schema), F.lit(16))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return r["n"], r["b"] or 0


#: A side is broadcast up to this size, counted before.
BROADCAST_BYTES = 16 << 20


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_BYTES, share: int = 256, salts: int = 32) -> DataFrame:
    """Join, inner, left, left_semi or left_anti, where one key of left may hold a great part of its rows.

    right is written to the shared folder, unless it was just read from there,
    so it is computed once and counted;
    it is broadcast only if it has at most `most` bytes.  Beyond that both
    sides are sorted and merged.  Keys that hold more than 1 / `share` of left
    are counted first (fewer than `share` by their definition); their rows are
    spread over `salts` tasks and only their rows of right are repeated.  Rows
    with a null key are spread as well.  The result is the same either way.
    """
    right = right if getattr(right, "_clausewright_cut", False) else cut(right, "side")
    if extent(right)[1] <= most:
        return left.join(F.broadcast(right), on, how)
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    counted = cut(counted.where(" and ".join(f"`{c}` is not null" for c in on)), "keys")
    total = counted.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("__n") * share > total).select(*on, F.lit(True).alias("__hot")))
    null = functools.reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    spread = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot") | null, spread).otherwise(0)).drop("__hot")
    copies = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0)))).drop("__hot")
    return spread.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def norm_key(c: Column | str) -> Column:
    """Keys are compared without surrounding white space and without regard to case; blank counts as null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application; executors fetch it from the shared folder."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_clausewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    target = f"{shared_dir(spark)}/clausewright_pkg.zip"
    fs, path = _path(spark, target)
    out = fs.create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(target)
    sc._clausewright_shipped = True
