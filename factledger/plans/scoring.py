"""Answers scored from their texts: numbers, exact match, evidence, made-up values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.operators import evaluation as S
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


@query("""
WITH v AS (SELECT o_orderkey, o_totalprice::DOUBLE AS p, year(o_orderdate)::DOUBLE AS y FROM orders),
l AS (SELECT o_orderkey, unnest([p, p * 1e6, y]) AS x FROM v),
c AS (SELECT DISTINCT o_orderkey, CASE WHEN x = floor(x) THEN x::DECIMAL(38,0)::VARCHAR ELSE printf('%.4f', x) END AS n FROM l)
SELECT o_orderkey, string_agg(n, ' ' ORDER BY n) AS numbers FROM c GROUP BY o_orderkey
""")
def number_sets(t) -> DataFrame:
    """The numbers of a sentence, as they stand and in full."""
    said = F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" million (in "), F.year("o_orderdate"), F.lit(")."))
    return t("orders").select("o_orderkey", F.array_join(numeric.number_set(said), " ").alias("numbers"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN o_totalprice = 0 WHEN 5 THEN false WHEN 7 THEN false ELSE true END AS is_match FROM orders
""")
def exact_match_answers(t) -> DataFrame:
    """Answers in eight forms: other notation, within and beyond tolerance, percent, declined, worded, wrong."""
    k, price = F.col("o_orderkey") % 8, F.round("o_totalprice", 2)
    plain = lambda x: F.format_string("%.2f", x)
    said = (
        F.when(k == 0, F.concat(F.lit("It was $"), F.format_number(price, 2), F.lit(" (Source: order).")))
        .when(k == 1, F.concat(F.lit("About "), plain(price * 1.004)))
        .when(k == 2, plain(price * 1.2)).when(k == 3, F.concat(plain(price * 100), F.lit("%")))
        .when(k == 4, "There is insufficient data.").when(k == 5, F.concat(F.lit("It is "), plain(price)))
        .when(k == 6, "Shipped by the clerk to building segment").otherwise("nothing of the kind")
    )
    gold = F.when(k >= 6, "the clerk of the building segment").otherwise(plain(price))
    label = F.when(k.isin(4, 5), "Unfounded").otherwise("Supported")
    return t("orders").select("o_orderkey", S.exact_match(said, gold, label, k == 6).alias("is_match"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q FROM lineitem),
s AS (SELECT l_orderkey, max(q) + CASE WHEN l_orderkey % 4 = 0 THEN 100 ELSE 0 END AS target FROM w GROUP BY l_orderkey),
g AS (SELECT w.*, q = target AS gold, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (q = target) OVER (PARTITION BY l_orderkey) AS hits FROM w JOIN s USING (l_orderkey))
SELECT l_orderkey AS record, l_linenumber AS chunk FROM g WHERE gold OR (hits = 0 AND n <= 3)
""")
def golden_chunks(t) -> DataFrame:
    """The lines that hold an order's answer; all of a short order where none does."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("chunk"), F.col("l_quantity").cast("int").alias("q"))
    most = rows.groupBy("record").agg(F.max("q").alias("q")).withColumn("q", F.col("q") + F.when(F.col("record") % 4 == 0, 100).otherwise(0))
    samples = most.select("record", F.concat(F.lit("units "), "q").alias("target"), F.lit("").alias("trace"))
    return S.golden_chunks(samples, rows.select("record", "chunk", F.concat(F.lit("line with "), "q", F.lit(" pieces")).alias("text")))


DERIVED = """
  SELECT l_orderkey, list_distinct(list(l_quantity::INT::DOUBLE)) AS q FROM lineitem GROUP BY l_orderkey
"""
NEAR = "abs({0} - {1}) <= greatest(abs({1}) * 0.01, 0.01)"


def _ways(x: str, y: str, n: str) -> str:
    near = lambda e: "abs({0} - {1}) <= greatest(abs({1}) * 0.01::DOUBLE, 0.01::DOUBLE)".format(e, n)
    return f"({near(f'({x} + {y})')} OR {near(f'({x} - {y})')} OR coalesce({near(f'(({x} - {y}) / abs({y}) * 100)')} OR {near(f'({x} / {y} * 100)')} OR {near(f'({x} / {y})')}, false))"


@query(f"""
WITH l AS ({DERIVED}), a AS (SELECT l_orderkey, q, ((l_orderkey % 200) + 3)::DOUBLE AS n FROM l),
p AS (SELECT l_orderkey, n, unnest(q) AS x FROM a), j AS (SELECT p.l_orderkey, bool_or({_ways("p.x", "b.x", "p.n")}) AS d FROM p JOIN p b ON p.l_orderkey = b.l_orderkey AND p.x <> b.x GROUP BY p.l_orderkey)
SELECT a.l_orderkey, coalesce(d, false) AS derivable FROM a LEFT JOIN j USING (l_orderkey)
""")
def derivable_number(t) -> DataFrame:
    """Whether a number is a sum, difference, change, share or ratio of two of an order's quantities."""
    q = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int").cast("double")).alias("q"))
    return q.select("l_orderkey", numeric.derivable_from((F.col("l_orderkey") % 200 + 3).cast("double"), F.col("q")).alias("derivable"))


@query(f"""
WITH l AS ({DERIVED}), a AS (SELECT l_orderkey, q, ((l_orderkey % 200) + 3)::DOUBLE AS n FROM l),
p AS (SELECT l_orderkey, n, unnest(q) AS x FROM a), j AS (SELECT p.l_orderkey, bool_or({_ways("p.x", "b.x", "p.n")}) AS d FROM p JOIN p b ON p.l_orderkey = b.l_orderkey AND p.x <> b.x GROUP BY p.l_orderkey),
f AS (
  SELECT a.l_orderkey, list_contains(q, n) AS correct, l_orderkey % 7 <> 0 AS retrieved, list_contains(list_concat(q, [0, 1, 100]), n) OR coalesce(d, false) AS known FROM a LEFT JOIN j USING (l_orderkey)
)
SELECT l_orderkey, retrieved AND NOT correct AND NOT known AS hallucinated FROM f
""")
def hallucination_flag(t) -> DataFrame:
    """Wrong answers with a number that neither context nor arithmetic gives."""
    q = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int")).alias("q")).withColumn("q", F.transform("q", lambda x: x.cast("string")))
    n = (F.col("l_orderkey") % 200 + 3).cast("string")
    flag = S.hallucinated(F.concat(F.lit("It is "), n), F.array_join("q", " and "), F.lit("how many"), F.array_contains("q", n), F.col("l_orderkey") % 7 != 0)
    return q.select("l_orderkey", flag.alias("hallucinated"))


@query(f"""
WITH l AS ({DERIVED}), a AS (SELECT l_orderkey, q, ((l_orderkey % 60) + 1)::DOUBLE AS n, list_max(q) AS gold FROM l),
m AS (
  SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN false WHEN gold = 0 THEN abs(gold - n) < 0.015 ELSE abs(gold - n) / abs(gold) <= 0.005 OR abs(gold * 100 - n) / abs(gold * 100) <= 0.01 OR abs(gold - n * 100) / abs(gold) <= 0.01 END AS correct FROM a
)
SELECT l_orderkey, CASE WHEN correct THEN 'NONE' WHEN l_orderkey % 13 = 0 THEN 'TYPE_7_GENERATION_FAILURE' WHEN len(q) = 1 THEN 'TYPE_5_COVERAGE_GAP' WHEN l_orderkey % 3 = 0 THEN 'TYPE_1_RETRIEVAL_BLINDNESS'
  WHEN l_orderkey % 11 = 0 THEN 'TYPE_1_RETRIEVAL_BLINDNESS' ELSE 'TYPE_3_ARITHMETIC_HALLUCINATION' END AS failure FROM m
""")
def failure_from_answers(t) -> DataFrame:
    """Failure classes whose predicates are computed from answers and contexts."""
    key = F.col("l_orderkey")
    q = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int")).alias("q"))
    gold, context = F.array_max("q").cast("string"), F.array_join(F.transform("q", lambda x: x.cast("string")), " and ")
    said = F.when(key % 11 == 0, "It was not found.").otherwise(F.concat(F.lit("It is "), (key % 60 + 1).cast("string")))
    flags = {
        "correct": S.exact_match(said, gold, F.lit("Supported"), F.lit(False)), "failed": key % 13 == 0, "ambiguous": F.lit(False), "gap": F.size("q") == 1, "retrieved": key % 3 != 0,
        "numeric": F.size(numeric.number_set(gold)) > 0, "code_ok": F.lit(False), "refusal": text.contains_any(said, text.REFUSALS),
        "gold_in_context": F.size(F.array_intersect(numeric.number_set(gold), numeric.number_set(context))) > 0, "bleed": F.lit(False),
    }
    return q.select("l_orderkey", S.taxonomy(flags).alias("failure"))


@query(r"""
SELECT conv_id, turn, coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS words, floor(length(text) / 4)::BIGINT AS quarter, floor(len(regexp_extract_all(text, '\S+')) / 0.75::DOUBLE)::BIGINT AS by_words FROM conversations
""")
def token_estimates(t) -> DataFrame:
    """Three estimates of a text's tokens."""
    e = text.estimates(F.col("text"))
    return t("conversations").select("conv_id", "turn", e["words"].alias("words"), e["quarter"].alias("quarter"), e["by_words"].cast("long").alias("by_words"))


@query("""
SELECT role, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) < 128) AS short, count(*) FILTER (length(text) >= 128 AND length(text) < 512) AS middle,
  count(*) FILTER (length(text) >= 512) AS long FROM conversations GROUP BY role
""")
def length_histogram(t) -> DataFrame:
    """Lengths by part: least, most, mean and how many are short, middling and long."""
    n = F.length("text")
    return t("conversations").groupBy("role").agg(
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n < 128).alias("short"), F.count_if((n >= 128) & (n < 512)).alias("middle"),
        F.count_if(n >= 512).alias("long"),
    )


@query("""
WITH p AS (SELECT doc_id, quality, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 END AS pred FROM labels)
SELECT quality, count(*) AS n, count(pred) AS covered, round(avg((pred = 0)::INT), 6) AS valid_rate, count(*) - count(pred) AS missing FROM p GROUP BY quality
""")
def validity_rate(t) -> DataFrame:
    """Predictions joined to a manifest; a missing one counts as -1 and is left out of the rate."""
    manifest = t("labels").select("doc_id", "quality")
    predictions = manifest.where("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 3).alias("pred"))
    rows = manifest.join(predictions, "doc_id", "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))
    have = F.col("pred") >= 0
    return rows.groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if(have).alias("covered"), F.round(F.avg(F.when(have, (F.col("pred") == 0).cast("int"))), 6).alias("valid_rate"), F.count_if(~have).alias("missing")
    )


@query("""
WITH s AS (SELECT toxic, count(*) AS n, avg((quality = doc_id % 2)::INT) AS rate FROM labels GROUP BY toxic)
SELECT CASE WHEN toxic = 1 THEN 'long' ELSE 'short' END AS pool, n, round(rate, 6) AS rate FROM s UNION ALL SELECT 'global', sum(n)::BIGINT, round(sum(n * rate) / sum(n), 6) FROM s
""")
def weighted_rates(t) -> DataFrame:
    """Rates by stratum and their mean weighted by size."""
    by = t("labels").groupBy(F.when(F.col("toxic") == 1, "long").otherwise("short").alias("pool")).agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("doc_id") % 2).cast("int")).alias("rate"))
    return S.with_global(by, "pool", "n", "rate")


@query("""
WITH x AS (
  SELECT user_id % 5 AS run, user_id, sum(value::DECIMAL(18,2)) FILTER (event_type = 'view') AS a, sum(value::DECIMAL(18,2)) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id
)
SELECT run, count(*) AS n, coalesce(round(sum(a)::DOUBLE / count(a), 6)::VARCHAR, 'N/A') AS tokens_a, coalesce(round(sum(b)::DOUBLE / count(b), 6)::VARCHAR, 'N/A') AS tokens_b FROM x GROUP BY run
""")
def run_means(t) -> DataFrame:
    """Means of every token column of each run; missing values don't count, and a column without any is N/A."""
    total = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value").cast("decimal(18,2)")))
    rows = t("events").groupBy((F.col("user_id") % 5).alias("run"), "user_id").agg(total("view").alias("tokens_a"), total("purchase").alias("tokens_b"))
    return S.means_of(rows, "run", "tokens")


QUERIES, ORACLES = registry.queries, registry.oracles
