"""Scores over predictions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.functions.once import once


def pairs(rows: DataFrame) -> DataFrame:
    """family, kind, pool and the predictions of parent and child, from (family, role, pool, kind, pred)."""
    one = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return (
        rows.groupBy("family")
        .agg(one("parent", "pred").alias("parent_pred"), one("child", "pred").alias("child_pred"), one("child", "kind").alias("kind"), one("parent", "pool").alias("pool"))
        .where("parent_pred IS NOT NULL AND child_pred IS NOT NULL")
    )


def flipped() -> Column:
    """Both right at once: the parent supported (0), the child unfounded (1)."""
    return ((F.col("parent_pred") == 0) & (F.col("child_pred") == 1)).cast("double")


def composite(hits: list[tuple[Column, Column]]) -> Column:
    """Product of the square roots of posterior means of (hits, n)."""
    out = F.lit(1.0)
    for k, n in hits:
        out = out * F.sqrt(numeric.posterior_mean(k, n))
    return out


def taxonomy(r: dict[str, Column]) -> Column:
    """Why an answer is wrong, by the first rule that holds."""
    numeric_tail = (
        F.when(r["refusal"], "TYPE_1_RETRIEVAL_BLINDNESS")
        .when(r["gold_in_context"], "TYPE_3_ARITHMETIC_HALLUCINATION")
        .when(r["bleed"] & ~r["code_ok"], "TYPE_0_UFL_BLEED")
        .otherwise("TYPE_2_GENERATIVE_CONFLATION")
    )
    return (
        F.when(r["correct"], "NONE")
        .when(r["failed"], "TYPE_7_GENERATION_FAILURE")
        .when(r["ambiguous"], "TYPE_6_GOLD_AMBIGUITY")
        .when(r["gap"], "TYPE_5_COVERAGE_GAP")
        .when(~r["retrieved"], "TYPE_1_RETRIEVAL_BLINDNESS")
        .when(~r["numeric"] & r["code_ok"], "TYPE_4_MODALITY_MISMATCH")
        .when(r["numeric"], numeric_tail)
        .when(r["refusal"], "TYPE_1_RETRIEVAL_BLINDNESS")
        .otherwise("TYPE_2_GENERATIVE_CONFLATION")
    )


def survivor_class(runs: list[Column]) -> Column:
    """Who solves a question, baseline first and full system last; null where a run is missing."""
    first, *rest = runs
    every = first & rest[0] & rest[1] & rest[2]
    none = ~first & ~rest[0] & ~rest[1] & ~rest[2]
    return (
        F.when(every, "ALL_WIN")
        .when(none, "ALL_FAIL")
        .when(rest[2] & ~first & ~rest[0] & ~rest[1], "ONLY_4_WINS")
        .when(~first & (rest[0] | rest[1] | rest[2]), "BASELINE_FAILS")
        .when(every.isNotNull() & none.isNotNull(), "OTHER")
    )


def first_ids(rows: DataFrame, group: str, key: str, n: int = 20) -> DataFrame:
    """Each group's rows counted, with its first ``n`` ids in order: only these are gathered."""
    ranked = rows.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_n") <= n)
    some = ranked.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(some, group)


def pairs_only(rows: DataFrame, pools: tuple[str, ...]) -> DataFrame:
    """Rows drawn for the subsample that belong to a pool of pairs."""
    return rows.where(F.coalesce(F.col("subsample"), F.lit(False)) & F.col("pool").isin(*pools))


def percentiles(rows: DataFrame, per: str, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    p = F.expr(f"percentile({value}, array(0.25, 0.5, 0.75, 0.95))")
    return rows.groupBy(per).agg(p.alias("p"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("n")).select(
        per, F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), F.col("p")[3].alias("p95"), "min", "max", "n"
    )


def ema(rows: DataFrame, per: str, order: str, value: str, span: int) -> DataFrame:
    """Exponential moving average (alpha = 2 / (span + 1), from the first value), folded over each group in order.

    Groups are series of aggregated points such as days, so they stay small.
    """
    alpha = 2.0 / (span + 1)
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v"))))
    folded = F.aggregate(
        F.slice("points", 2, 1_000_000_000),
        F.array(F.col("points")[0]["v"]),
        lambda done, p: F.array_append(done, p["v"] * alpha + F.element_at(done, -1) * (1 - alpha)),
    )
    rolled = rows.groupBy(per).agg(points.alias("points")).withColumn("ema", folded)
    return rolled.select(per, F.explode(F.arrays_zip(F.col("points.at").alias("at"), F.col("ema").alias("ema"))).alias("x")).select(per, F.col("x.at").alias(order), "x.ema")


def exact_match(answer: Column, gold: Column, label: Column, lookup: Column) -> Column:
    """Whether an answer is right: an unfounded question must be declined; numbers match within tolerances; where the gold answer
    has no number, or the question is a look-up, its text may be contained or share 70 % of its words."""
    said, wanted = numeric.number_values(answer), numeric.number_values(gold)
    by_number = F.exists(wanted, lambda g: F.exists(said, lambda p: numeric.values_match(g, p)))
    plain = text.without_citations(answer)
    clean = F.lower(F.trim(F.regexp_replace(gold, r"(?i)\s*[(\[\-].*?(\$|usd|nzd|eur|gbp|£|€|¥|\d).*$", "")))
    of = lambda t: F.filter(text.words(t), lambda w: ~w.isin(*text.SMALL_WORDS))
    by_text = F.contains(plain, clean) | F.coalesce(text.overlap(of(clean), of(plain)) >= 0.7, F.lit(False))
    right = by_number | ((F.coalesce(lookup, F.lit(False)) | (F.size(wanted) == 0)) & by_text)
    judged = F.when(label == "Unfounded", text.contains_any(answer, text.REFUSALS)).otherwise(right)
    return F.when(F.coalesce(answer, F.lit("")) == "", False).otherwise(F.coalesce(judged, F.lit(False)))


def golden_chunks(samples: DataFrame, chunks: DataFrame, fallback: int = 3) -> DataFrame:
    """record, chunk: a record's chunks that share a number with its answer or trace, contain the answer, or a fifth of its words.

    ``samples`` has (record, target, trace), ``chunks`` (record, chunk, text). A record without any gets all of its chunks, if
    they are ``fallback`` at most.
    """
    evidence = F.array_union(numeric.number_set(F.col("target")), numeric.number_set(F.col("trace")))
    asked = samples.select("record", "target", evidence.alias("evidence"), F.filter(text.words(F.col("target")), lambda w: ~w.isin(*text.SMALL_WORDS) & (F.length(w) > 3)).alias("asked"))
    shares = F.arrays_overlap("evidence", numeric.number_set(F.col("text")))
    says = (F.col("target") != "") & F.contains(F.lower("text"), F.lower("target"))
    like = F.coalesce(text.overlap(F.col("asked"), text.words(F.col("text"))) >= 0.2, F.lit(False))
    judged = chunks.join(asked, "record").select("record", "chunk", F.coalesce(shares | says | like, F.lit(False)).alias("gold"))
    counts = judged.groupBy("record").agg(F.count_if("gold").alias("n"), F.count("*").alias("all"))
    kept = judged.join(counts, "record").where(F.col("gold") | ((F.col("n") == 0) & (F.col("all") <= fallback)))
    return kept.select("record", "chunk")


def hallucinated(answer: Column, context: Column, query: Column, correct: Column, retrieved: Column) -> Column:
    """Whether a wrong answer has a number that neither context nor query has and that two of the context's don't give; never where
    retrieval failed."""
    said, known = numeric.number_values(F.regexp_replace(answer, "(?s)```.*?```", "")), numeric.number_values(context)
    free = lambda k: F.array_union(F.array_union(k, numeric.number_values(query)), F.array(F.lit(0.0), F.lit(1.0), F.lit(100.0)))
    made_up = lambda k: once(free(k), lambda f: F.exists(said, lambda n: ~F.array_contains(f, n) & ~numeric.derivable_from(n, k)))
    return retrieved & ~correct & once(known, made_up)


def with_global(rates: DataFrame, per: str, n: str, rate: str) -> DataFrame:
    """``rates`` with a row ``global``: the mean of all strata, weighted by their sizes."""
    whole = rates.agg(F.lit("global").alias(per), F.sum(n).alias(n), F.try_divide(F.sum(F.col(n) * F.col(rate)), F.sum(n)).alias(rate))
    return rates.select(per, n, F.round(rate, 6).alias(rate)).unionByName(whole.withColumn(rate, F.round(rate, 6)))


def means_of(rows: DataFrame, per: str, part: str) -> DataFrame:
    """n and the mean of each column whose name contains ``part``, as text, by ``per``; N/A where there is no value."""
    mean = lambda c: F.coalesce(F.round(F.try_divide(F.sum(c).cast("double"), F.count(c)), 6).cast("string"), F.lit("N/A")).alias(c)
    return rows.groupBy(per).agg(F.count("*").alias("n"), *(mean(c) for c in rows.columns if part in c))
