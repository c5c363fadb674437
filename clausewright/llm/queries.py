"""Queries of the training-data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm.encoding import repair_encoding
from clausewright.llm import neardup
from clausewright.llm.mixing import mix
from clausewright.llm.packing import pack
from clausewright.llm.residue import fit_residue, score_residue
from clausewright.llm.scans import repair_scans, scan_findings
from clausewright.llm.splitting import split_oversized
from clausewright.llm.tokens import count_tokens
from clausewright.session import cut, table


def _fields(spark: SparkSession, sf_dir: str, fields: list[tuple[str, str]]) -> DataFrame:
    """(table_name, row_id, field_name, text) of text columns."""
    out = None
    for t, c in fields:
        d = table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), F.lit(c).alias("field_name"), F.col(c).alias("text"))
        out = d if out is None else out.unionByName(d)
    return out


_KEYS = ["table_name", "row_id", "field_name"]


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the manual evidence."""
    e = table(spark, sf_dir, "product_manual_evidence").select(F.col("id").alias("row_id"), "page_number", "text")
    return split_oversized(e, "text", ["row_id", "page_number"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut into more than one piece."""
    e = table(spark, sf_dir, "product_manual_evidence").select(F.col("id").alias("row_id"), "text")
    return split_oversized(e, "text", ["row_id"], with_text=False).where("piece > 0").select("row_id").distinct()


_P3 = [("requirements", "source_quote"), ("requirements", "requirement_text"), ("product_manual_evidence", "text")]


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with scanning damage, repaired."""
    return repair_scans(_fields(spark, sf_dir, _P3), "text", _KEYS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with scanning damage."""
    found = scan_findings(_fields(spark, sf_dir, _P3), "text", _KEYS)
    f, s, m = (found[k].select(*_KEYS) for k in ("furniture", "splits", "misread"))
    return f.unionByName(s).unionByName(m).distinct()


_P5 = [("requirements", "source_quote"), ("product_manual_evidence", "text")]


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with encoding damage, restored."""
    return repair_encoding(_fields(spark, sf_dir, _P5), "text", _KEYS).select(*_KEYS, "restored", F.concat_ws(",", "states").alias("states"), "lost").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with encoding damage."""
    return repair_encoding(_fields(spark, sf_dir, _P5), "text", _KEYS).select(*_KEYS).distinct()


_P6 = ["requirement_text", "source_quote"]
_P6_SIMILAR = {"threshold": 0.5, "width": 3}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar requirements."""
    docs, members = neardup.contents(table(spark, sf_dir, "requirements"), "id", _P6)
    pairs = neardup.similar_contents(docs, _P6, **_P6_SIMILAR)
    return neardup.expand_members(pairs, members, "id", neardup.with_shingles(docs, _P6, 3))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per requirement with the class of its near-duplicates and its number of similar contents."""
    docs, members = neardup.contents(table(spark, sf_dir, "requirements"), "id", _P6)
    pairs = neardup.similar_contents(docs, _P6, **_P6_SIMILAR)
    return members.join(neardup.groups(pairs, docs), "rid").select("id", "class_id", "links")


CAPACITY = 2048


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, digest, tokens) of the documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["id"])
    return cut(count_tokens(d, "text", ["id", "source", "digest"]), "tokens")


def p8_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one over the capacity."""
    items = _sizes(spark, sf_dir).select("id", F.col("tokens").alias("size"))
    return pack(items, CAPACITY).select(F.col("id").alias("doc_id"), "piece", "size", "container")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of the containers."""
    p = p8_placement(spark, sf_dir)
    return p.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"), (F.lit(CAPACITY) - F.sum("size")).alias("unused"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in order of slot and offset."""
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    return mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any placement: all texts placed once and whole, none over the capacity, pieces only where needed."""
    p = cut(p8_placement(spark, sf_dir), "placement")
    per = p.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("pieces"))
    over = p.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("over_capacity"))
    need = F.ceil(F.col("size") / CAPACITY)
    facts = per.agg(F.count(F.lit(1)).alias("placed"), F.count_if((F.col("n") != need) | (F.col("pieces") != F.col("n"))).alias("split_wrongly"))
    sizes = _sizes(spark, sf_dir).where("tokens > 0").select(F.col("id").alias("doc_id"), F.col("tokens"))
    wrong = sizes.join(per, "doc_id", "full_outer").agg(F.count_if(~F.col("tokens").eqNullSafe(F.col("size"))).alias("wrong_size"))
    return facts.join(over).join(wrong)  # one row each


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any mix, per source: no text over its repeats, shares reached, or all there is used, but for one text."""
    m, shares = mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    uses = m.groupBy("source", "id").count().groupBy("source").agg(F.max("count").alias("most"))
    kept = shares.join(uses, "source", "left").na.fill(0, ["most"])
    longest = m.groupBy("source").agg(F.max("tokens").alias("longest"))
    kept = kept.join(longest, "source", "left").na.fill(0, ["longest"])
    total = F.col("available") * F.col("max_repeats")
    whole = F.sum("available").over(Window.partitionBy())
    aim = F.least(F.col("target_share") * whole, total)
    return kept.select("source", (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("tokens") - aim) <= F.col("longest") + 1).alias("share_kept"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return score_residue(d, "text", ["doc_id"], fit_residue(d, "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue of templates or failed page loads."""
    return _residue(spark, sf_dir).select("doc_id").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without them."""
    return table(spark, sf_dir, "documents").distinct().join(p10_found(spark, sf_dir), "doc_id", "left_anti")


def queries() -> dict:
    """All queries of this subpackage."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    words = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')".format
    shingles = " union all ".join(f"select distinct id, '{f}' as f, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from (select id, {words(f)} as w from requirements)" for f in _P6)
    return {
        "p2_found": "select distinct id as row_id from product_manual_evidence where length(text) > 1800",
        "p6_found": f"""with g as ({shingles}), n as (select id, f, count(*) as n from g group by all), c as (select a.id as id_a, b.id as id_b, a.f, count(*) as c from g a join g b on a.g = b.g and a.f = b.f and a.id < b.id group by all)
            select distinct id_a, id_b from c join n x on x.id = id_a and x.f = c.f join n y on y.id = id_b and y.f = c.f where 2 * c >= x.n + y.n - c""",
        "p8_checked": "select count(*) as placed, 0 as split_wrongly, 0 as over_capacity, 0 as wrong_size from documents where length(text) > 0",
        "p9_checked": "select distinct source, true as repeats_kept, true as share_kept from mix_targets",
    }
