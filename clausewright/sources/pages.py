"""Page sources: paged text files, layout, blocks, tables, and fixed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, page_number, text) of text files whose pages are parted by form feeds, from any path Spark can read.

    Empty pages are skipped; a file without any text is an error when it is read.
    """
    f = spark.read.format("binaryFile").load(path)
    f = f.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path"), F.split(F.decode("content", "UTF-8"), "\f").alias("pages"))
    some = F.exists("pages", lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    f = f.select("file_name", F.when(some, F.col("pages")).otherwise(F.raise_error(F.concat(F.lit("no text in "), "path")).cast("array<string>")).alias("pages"))
    return f.select("file_name", F.posexplode("pages").alias("n", "text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("file_name", (F.col("n") + 1).alias("page_number"), "text")


def layout_merged(pages: DataFrame, layout: DataFrame, on: list[str], least: int = 20) -> DataFrame:
    """pages with the text of the layout pages (on + text, ocr) where that was recognised anew and is long enough (S2, J1); all pages stay."""
    t = F.trim(F.col("__text"))
    anew = F.coalesce(F.col("__ocr"), F.lit(False)) & (F.length(t) >= least)
    j = pages.join(layout.select(*on, F.col("text").alias("__text"), F.col("ocr").alias("__ocr")), on, "left")
    return j.select(*[F.when(anew, t).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in pages.columns], anew.alias("ocr_applied"))


def catalog_status(spark: SparkSession, path: str) -> int:
    """Rows of a catalog, 0 where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path).count() if there else 0


def blocks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys + (block, text): the non-blank lines in order."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("block", "text")).where(F.trim("text") != "")


def bbox(c: Column) -> Column:
    """Four numbers rounded to three places."""
    return F.when(F.size(c) == 4, F.transform(c, lambda x: F.round(x, 3)))


def bbox_union(a: Column, b: Column) -> Column:
    """Smallest box around both; the other one where one is null."""
    both = F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def table_text(header: Column, rows: Column) -> Column:
    """Cells joined by bars, rows by line ends; rows without content dropped."""
    line = lambda r: F.array_join(F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))), " | ")
    lines = F.transform(F.concat(F.array(header), rows), line)
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"[|\s]", "") != ""), "\n")


def fixed_chunks(df: DataFrame, text: str, keys: list[str], size: int = 1800, overlap: int = 250) -> DataFrame:
    """keys + (chunk, chunk_text): windows of a fixed stride."""
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / (size - overlap)))
    c = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("chunk"))
    return c.select(*keys, "chunk", F.substr("__t", (F.col("chunk") * (size - overlap) + 1).cast("int"), F.lit(size)).alias("chunk_text"))


def ingest(spark: SparkSession, path: str, kind: str, document_id: str, root: str, size: int = 1800, overlap: int = 250) -> int:
    """Read a document's pages, and for products its chunks, into root; returns the rows written.

    kind: rfq or product; anything else is refused.  What the document had
    before is replaced, one folder per document; the outcome is appended to
    root/status, also where reading fails.
    """
    if kind not in ("rfq", "product"):
        raise ValueError(f"kind must be rfq or product, not {kind}")

    def note(status: str, rows: int, error: str | None) -> None:
        spark.createDataFrame([(document_id, kind, status, rows, error)], "document_id string, kind string, status string, rows long, error string").coalesce(1).write.mode("append").parquet(f"{root}/status")

    try:
        pages = read_pages(spark, path)
        out = f"{root}/{'chunks' if kind == 'product' else 'pages'}/document_id={document_id}"
        (fixed_chunks(pages, "text", ["file_name", "page_number"], size, overlap) if kind == "product" else pages).write.mode("overwrite").parquet(out)
        rows = spark.read.parquet(out).count()
    except Exception as e:
        note("failed", 0, str(e).splitlines()[0])
        raise
    note("indexed" if kind == "product" else "ready", rows, None)
    return rows
