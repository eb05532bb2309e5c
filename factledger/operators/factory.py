"""Building evaluation sets: routing, verdicts, families, balance and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import text

# what a changed scale becomes in the older, shorter attack; `attacks.SCALES` has the fixed values
SCALE_DRIFT = (("million", "billion"), ("billion", "million"), ("thousand", "million"), ("percent", "basis points"))


def route(rules: list[tuple[str, Column]], default: str = "skip") -> Column:
    """The first rule that holds names the target."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def waterfall(candidates: DataFrame, human: DataFrame, ai: DataFrame, teacher: DataFrame) -> DataFrame:
    """id, verdict, audit_source: people first, then the AI proxy, then the teacher unless a rule rejects it; others go.

    The decision tables have (id, label); the teacher's has (id, status, label, valid_sabotage) too.
    """
    joined = (
        candidates.join(human.select("id", F.col("label").alias("_human")), "id", "left")
        .join(ai.select("id", F.col("label").alias("_ai")), "id", "left")
        .join(teacher.select("id", "status", F.col("label").alias("_teacher"), "valid_sabotage"), "id", "left")
    )
    rejected = (
        (F.col("status") == "discarded")
        | (F.contains(F.lower("source"), F.lit("axiom")) & (F.coalesce(F.initcap("_teacher"), F.lit("")) != "General"))
        | ((F.initcap("label") == "Supported") & (F.initcap("_teacher") == "Unfounded"))
    )
    accepted = ~F.coalesce(rejected, F.lit(False)) & F.coalesce((F.col("status") == "verified") | F.col("valid_sabotage"), F.lit(False))
    verdict = F.coalesce("_human", "_ai", F.when(accepted, F.coalesce("_teacher", "label")))
    source = F.when(F.col("_human").isNotNull(), "human").when(F.col("_ai").isNotNull(), "ai").when(accepted, "teacher")
    return joined.select("id", verdict.alias("verdict"), source.alias("audit_source")).where("audit_source IS NOT NULL")


def family_id(record: Column) -> Column:
    """The original's id of a mutated record; other ids stay."""
    inner = F.regexp_extract(record, "^sabotaged_(.*)_[^_]*$", 1)
    return F.when(inner != "", inner).otherwise(record)


def family_buckets(members: DataFrame) -> DataFrame:
    """family, bucket from (family, label, axiom): axioms, then pairs, then unfounded, then supported."""
    flags = members.groupBy("family").agg(
        F.bool_or("axiom").alias("a"), F.bool_or(F.col("label") == "Unfounded").alias("u"), F.bool_or(F.col("label") == "Supported").alias("s")
    )
    bucket = F.when(F.col("a"), "axiom").when(F.col("u") & F.col("s"), "sabotage_pair").when(F.col("u"), "natural_fail").otherwise("natural_supp")
    return flags.select("family", bucket.alias("bucket"))


def split_families(families: DataFrame, share: float = 0.10) -> DataFrame:
    """family, bucket, split: a tenth of each bucket to test and to val (at least one of three), in hash order.

    Ranks within a bucket come from counts of hash ranges: first the two-digit prefixes are summed up, then families are
    numbered inside their prefix, so no bucket is sorted by one task.
    """
    hashed = families.withColumn("_h", F.md5(F.col("family").cast("string"))).withColumn("_p", F.substring("_h", 1, 2))
    counts = hashed.groupBy("bucket", "_p").agg(F.count("*").alias("_n"))
    by_prefix = Window.partitionBy("bucket").orderBy("_p")
    starts = counts.select(
        "bucket", "_p", (F.sum("_n").over(by_prefix) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy("bucket")).alias("_all")
    )
    inside = Window.partitionBy("bucket", "_p").orderBy("_h", "family")
    ranked = hashed.withColumn("_i", F.row_number().over(inside)).join(starts, ["bucket", "_p"])
    rank, n = F.col("_start") + F.col("_i"), F.col("_all")
    part = F.when((F.floor(n * share) == 0) & (n >= 3), 1).otherwise(F.floor(n * share))
    split = F.when(rank <= part, "test").when(rank <= 2 * part, "val").otherwise("train")
    return ranked.select("family", "bucket", split.alias("split"))


def replicate(rows: DataFrame, quota: int) -> DataFrame:
    """``rows`` (id) repeated to exactly ``quota`` rows, earlier ids once more than later ones; a larger pool is cut in hash order."""
    n = rows.count()
    if not n:
        return rows.withColumn("copy", F.lit(0))
    ordered = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(quota) if n > quota else rows
    if n > quota:
        return ordered.withColumn("copy", F.lit(0))
    factor, rest = divmod(quota, n)
    extra = rows.orderBy("id").limit(rest).withColumn("copy", F.lit(factor))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).unionByName(extra)


def time_warp(query: Column, key: Column) -> Column:
    """The first year of a query moved by one, up or down by the key's hash; null without a year."""
    year = F.regexp_extract(query, r"\b((?:19|20)[0-9]{2})\b", 1)
    up = F.conv(F.substring(F.md5(key.cast("string")), 1, 2), 16, 10).cast("int") % 2 == 0
    return F.when(year != "", text.replace_first_word(query, year, (F.nullif(year, F.lit("")).cast("int") + F.when(up, 1).otherwise(-1)).cast("string")))


def scale_drift(answer: Column) -> Column:
    """The first scale word of an answer exchanged; appended where there is none."""
    out = F.concat(answer, F.lit(" million"))
    for old, new in reversed(SCALE_DRIFT):
        out = F.when(text.has_word(answer, old), text.replace_first_word(answer, F.lit(old), F.lit(new))).otherwise(out)
    return out


def neighbours(grid: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Each cell with its neighbours below, above and to the right."""
    down, across = Window.partitionBy(column).orderBy(row), Window.partitionBy(row).orderBy(column)
    return grid.withColumns({"below": F.lead(value).over(down), "above": F.lag(value).over(down), "right": F.lead(value).over(across)})


def distractors(records: DataFrame) -> DataFrame:
    """id, distractor: the next record by hash within a hash prefix, if it comes from another source."""
    hashed = records.withColumn("_h", F.md5(F.col("id").cast("string")))
    order = Window.partitionBy(F.substring("_h", 1, 2)).orderBy("_h", "id")
    other = F.when(F.lead("source").over(order) != F.col("source"), F.lead("id").over(order))
    return hashed.select("id", other.alias("distractor")).where("distractor IS NOT NULL")
