"""Failures, validation, groundedness and bleed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import judging as J
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


@query("""
WITH a AS (
  SELECT o_orderkey AS k, any_value(o_custkey) AS c, any_value(o_orderpriority) AS p, any_value(o_orderstatus) AS s, any_value(o_totalprice) AS price, year(any_value(o_orderdate)) AS y, lower(any_value(c_mktsegment)) AS seg, list(DISTINCT l_quantity::INT) AS q,
    list(DISTINCT l_partkey) AS golden, coalesce(list(DISTINCT l_partkey) FILTER (l_quantity > 8), []) AS got, bool_or(l_partkey % 60 = 0) AS gap
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
), b AS (
  SELECT *, (c % 60 + 1)::DOUBLE AS n, list_max(q)::DOUBLE AS gold, list_filter(q, lambda x: x % 2 = 0) AS evens, CASE WHEN price >= 60000 THEN price < 300000 END AS code_ok,
    CASE WHEN p = '1-URGENT' AND c % 10 = 0 THEN 'broken' WHEN p = '2-HIGH' THEN 'declined' WHEN p = '3-MEDIUM' THEN 'goodwill' WHEN p = '5-LOW' AND c % 2 = 0 THEN 'segment' ELSE 'number' END AS said FROM a
), d AS (
  SELECT *, said IN ('goodwill', 'number') AS has_n, CASE WHEN s = 'P' THEN said = 'segment' ELSE said IN ('goodwill', 'number') AND (abs(gold - n) / gold <= 0.005 OR abs(gold * 100 - n) / (gold * 100) <= 0.01 OR abs(gold - n * 100) / gold <= 0.01) END AS correct,
    said = 'declined' OR c % 13 = 0 AS refusal FROM b
)
SELECT k AS o_orderkey, CASE WHEN correct THEN 'NONE' WHEN said = 'broken' OR ((s = 'F' OR c % 4 = 1) AND code_ok IS NULL) OR price > 480000 THEN 'TYPE_7_GENERATION_FAILURE' WHEN y % 2 = 0 AND said = 'goodwill' THEN 'TYPE_6_GOLD_AMBIGUITY'
  WHEN gap THEN 'TYPE_5_COVERAGE_GAP' WHEN len(list_filter(golden, lambda x: NOT list_contains(got, x))) > 0 THEN 'TYPE_1_RETRIEVAL_BLINDNESS' WHEN s = 'P' AND c % 4 = 1 AND code_ok THEN 'TYPE_4_MODALITY_MISMATCH' WHEN refusal THEN 'TYPE_1_RETRIEVAL_BLINDNESS' WHEN s = 'P' THEN 'TYPE_2_GENERATIVE_CONFLATION'
  WHEN list_contains(evens, gold::INT) OR (c % 7 <> 0 AND list_contains(q, gold::INT)) THEN 'TYPE_3_ARITHMETIC_HALLUCINATION' WHEN c % 3 = 0 AND NOT coalesce(code_ok, false) AND has_n AND list_contains(evens, n::INT) THEN 'TYPE_0_UFL_BLEED' ELSE 'TYPE_2_GENERATIVE_CONFLATION' END AS failure FROM d
""")
def failure_classes(t) -> DataFrame:
    """Why answers about orders are wrong: all ten predicates are worked out from answers, contexts, evidence and runs."""
    lines = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = lambda c: F.any_value(c).alias(c)
    part, quantity = F.col("l_partkey"), F.col("l_quantity").cast("int")
    rows = lines.groupBy("o_orderkey").agg(
        *map(one, ("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate", "c_mktsegment")), F.collect_set(quantity).alias("q"),
        F.collect_set(part).alias("golden"), F.collect_set(F.when(F.col("l_quantity") > 8, part)).alias("retrieved"), F.collect_set(F.when(part % 60 != 0, part)).alias("indexed"),
    )
    c, p, price = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_totalprice")
    n, seg = (c % 60 + 1).cast("string"), F.lower("c_mktsegment")
    listed = lambda odd: F.array_join(F.transform(F.filter("q", lambda x: x % 2 == odd), lambda x: x.cast("string")), ", ")
    built = rows.select(
        "o_orderkey", "golden", "retrieved", "indexed", F.lit("Supported").alias("label"), F.lit(False).alias("lookup"), F.when(F.col("o_orderstatus") == "P", seg).otherwise(F.array_max("q").cast("string")).alias("gold"),
        F.when((p == "1-URGENT") & (c % 10 == 0), "TIMEOUT_FAILURE").when(p == "2-HIGH", "It was not found.").when(p == "3-MEDIUM", F.concat(F.lit("The goodwill is "), n)).when((p == "5-LOW") & (c % 2 == 0), F.concat(F.lit("Of "), seg))
        .otherwise(F.concat(F.lit("It is "), n)).alias("answer"),
        F.when((F.col("o_orderstatus") == "F") | (c % 4 == 1), "run_3").otherwise("run_1").alias("run"), F.when(price >= 60_000, price < 300_000).alias("code_ok"), F.when(price > 480_000, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"),
        F.when(F.year("o_orderdate") % 2 == 0, "TATQA_dev").otherwise("finqa").alias("source"), (c % 13 == 0).alias("warned"), (c % 3 == 0).alias("bleed"),
        F.concat(F.lit("# LEDGER "), listed(0), F.lit(f" {J.CHUNKS} "), F.when(c % 7 != 0, listed(1)).otherwise("")).alias("context"),
    )
    return built.select("o_orderkey", J.failure(built, ("run_3", "run_4")).alias("failure"))


PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in J.OPPOSITES)


@query(f"""
WITH x AS (SELECT a, b, row_number() OVER () - 1 AS i FROM (VALUES {PAIRS}) v(a, b)),
r AS (SELECT p_partkey, p_size, (SELECT string_agg(a, ' and ' ORDER BY i) FROM x WHERE ((p_size + i) % 4) = 0) AS q, (SELECT string_agg(upper(b), ' or ' ORDER BY i) FROM x WHERE ((p_partkey + i) % 3) = 0) || CASE WHEN p_type = 'PROMO' THEN 's' ELSE '' END AS c FROM part),
m AS (SELECT p_partkey, count(*) FILTER (hit) AS checked, count(*) FILTER (hit AND back) AS triggered FROM (SELECT p_partkey, regexp_matches(lower(q), '\\b' || a || '\\b') AS hit, regexp_matches(lower(c), '\\b' || b || '\\b') AS back FROM r, x) GROUP BY p_partkey)
SELECT p_partkey, checked::INT AS checked, triggered::INT AS triggered, CASE WHEN checked > 0 THEN triggered::DOUBLE / checked ELSE 0 END AS ratio FROM m
""")
def opposite_terms(t) -> DataFrame:
    """Terms of a question whose opposites are in its context, over all ten pairs."""
    size, key = F.col("p_size"), F.col("p_partkey")
    said = lambda side, of, n, put: F.array_join(F.array_compact(F.array(*(F.when((of + i) % n == 0, put(F.lit(p[side]))) for i, p in enumerate(J.OPPOSITES)))), " and " if side == 0 else " or ")
    context = F.concat(said(1, key, 3, F.upper), F.when(F.col("p_type") == "PROMO", "s").otherwise(""))
    return t("part").select("p_partkey", J.opposite_terms(said(0, size, 4, lambda x: x), context).alias("b")).select("p_partkey", "b.*")


@query("""
WITH r AS (
  SELECT CASE WHEN lang = 'en' THEN 'sabotaged_' ELSE '' END || doc_id::VARCHAR AS id, CASE WHEN source < 'src2' THEN 'Unfounded' WHEN source < 'src5' THEN 'General' WHEN source IS NOT NULL THEN 'Supported' ELSE 'None' END AS label, lang <> 'de' AS inputs,
    length(text) % 5 = 0 AS no_query, length(text) % 3 = 0 AS no_context, CASE WHEN n_chars % 7 = 0 THEN '' WHEN n_chars % 7 = 1 THEN 'error' WHEN n_chars % 7 = 2 THEN 'none' WHEN regexp_matches(substr(text, 1, 12), '^[A-Za-z]+$') THEN 'valid' ELSE 'syntax' END AS trace,
    n_chars % 2 = 0 AS marked FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL AND regexp_matches(substr(text, 1, 12), '^[A-Za-z ]*$') AND regexp_matches(substr(text, 1, 12), '^[A-Za-z]+$|^[A-Za-z]+ +[A-Za-z]+')
    AND NOT regexp_matches(substr(text, 1, 12), '(?i)(^| )(is|in|and|or|not|for|if|as|the .* is)( |$)')
)
SELECT 'total_rows' AS check, count(*) AS n FROM r UNION ALL SELECT 'schema_errors', count(*) FROM r WHERE NOT inputs HAVING count(*) > 0 UNION ALL SELECT 'empty_query', count(*) FROM r WHERE inputs AND no_query HAVING count(*) > 0
UNION ALL SELECT 'empty_context', count(*) FROM r WHERE inputs AND no_context AND label <> 'General' HAVING count(*) > 0 UNION ALL SELECT 'label_' || label, count(*) FROM r WHERE inputs GROUP BY label
UNION ALL SELECT CASE trace WHEN 'error' THEN 'trace_errors' WHEN 'none' THEN 'no_trace' WHEN 'valid' THEN 'valid_traces' ELSE 'trace_syntax_errors' END, count(*) FROM r WHERE inputs AND trace <> '' GROUP BY ALL
UNION ALL SELECT 'missing_sabotage_info', count(*) FROM r WHERE inputs AND label = 'Unfounded' AND contains(id, 'sabotaged') AND NOT marked HAVING count(*) > 0
""")
def validation_counts(t) -> DataFrame:
    """What a data set's records break, by rule and label; the first letters of texts stand for traces, which parse where they are one word."""
    start = F.expr("substring(text, 1, 12)")
    plain = start.rlike("^[A-Za-z ]*$") & start.rlike("^[A-Za-z]+$|^[A-Za-z]+ +[A-Za-z]+") & ~start.rlike("(?i)(^| )(is|in|and|or|not|for|if|as|the .* is)( |$)")
    k, source = F.col("n_chars") % 7, F.col("source")
    rows = t("documents").where(F.col("text").isNotNull() & F.col("n_chars").isNotNull() & plain).select(
        F.concat(F.when(F.col("lang") == "en", "sabotaged_").otherwise(""), F.col("doc_id").cast("string")).alias("id"), F.when(source < "src2", "Unfounded").when(source < "src5", "General").when(source.isNotNull(), "Supported").alias("label"),
        (F.col("lang") != "de").alias("has_inputs"), F.when(F.length("text") % 5 == 0, "").otherwise("q").alias("query"), F.when(F.length("text") % 3 != 0, F.array(F.lit("c"))).alias("context_chunks"),
        F.when(k == 0, "").when(k == 1, "# TRACE_GENERATION_ERROR").when(k == 2, "# NO_TRACE_AVAILABLE (").otherwise(start).alias("trace"), F.when(F.col("n_chars") % 2 == 0, "info").alias("sabotage"),
    )
    return J.validation_stats(rows)


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= '2000-01-01' THEN (['GROUNDED', 'HALLUCINATION', 'COMMON'])[(l_partkey % 3)::INT + 1] END AS p, l_tax > 0.06 AS failed FROM lineitem)
SELECT o_orderkey, count(l_linenumber) AS sentences, coalesce(round(count(*) FILTER (p = 'GROUNDED' AND NOT failed)::DOUBLE / nullif(count(l_linenumber), 0), 6), 0) AS groundedness FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def groundedness(t) -> DataFrame:
    """Share of each answer's sentences (here: an order's lines) that a judge found grounded; some have no verdict, some failed."""
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    sentences = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("l_orderkey").isNotNull(), key).alias("sentence"))
    verdicts = t("lineitem").where("l_shipdate >= '2000-01-01'")
    names = F.element_at(F.array(F.lit("GROUNDED"), F.lit("HALLUCINATION"), F.lit("COMMON")), (F.col("l_partkey") % 3 + 1).cast("int"))
    judged = verdicts.select(key.alias("sentence"), names.alias("prediction"), F.when(F.col("l_tax") > 0.06, "timeout").alias("error")).dropDuplicates(["sentence"])
    return J.groundedness(sentences, judged, "o_orderkey", "sentence")


@query(r"""
WITH d AS (SELECT doc_id, replace(replace(replace(text, 'er', '|'), 'en', ','), 'on', ' 12 3.5 1,7 ') AS c FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, c, list_filter(string_split_regex(c, '\r\n|[\n\r]'), lambda x: trim(x) <> '') AS ls FROM d),
n AS (SELECT *, len(ls) AS n, list_filter(list_transform(ls, lambda x: length(x) - length(replace(x, '|', ''))), lambda k: k > 0) AS ps FROM l)
SELECT doc_id, length(trim(c)) >= 10 AND ((contains(c, '|') AND contains(c, '---')) OR (n >= 3 AND (len(list_filter(ls, lambda x: length(x) - length(replace(x, ',', '')) >= 3)) >= n * 0.6 OR len(list_filter(ls, lambda x: length(x) - length(replace(x, chr(9), '')) >= 3)) >= n * 0.6
  OR len(list_filter(ls, lambda x: regexp_matches(x, '-?\d[\d,.]*(?:\s+-?\d[\d,.]*){2,}'))) >= 3 OR (len(ps) >= 3 AND len(list_filter(list_distinct(ps), lambda k: k >= 2 AND len(list_filter(ps, lambda p: p = k)) >= len(ps) * 0.7)) > 0)))) AS tabular FROM n
""")
def tabular_blocks(t) -> DataFrame:
    """Which texts look like tables, by pipes, commas, tabs and columns of numbers."""
    content = F.col("text")
    for old, new in (("er", "|"), ("en", ","), ("on", " 12 3.5 1,7 ")):
        content = F.replace(content, F.lit(old), F.lit(new))
    return t("documents").where("text IS NOT NULL").select("doc_id", J.looks_tabular(content).alias("tabular"))


@query("SELECT event_type AS run, CASE WHEN count(v) = 0 THEN 'N/A' ELSE printf('%.2f%%', avg(v) * 100) END AS mean FROM (SELECT event_type, CASE WHEN event_type <> 'error' AND value > 3 THEN floor(value)::DOUBLE / 64 END AS v FROM events) GROUP BY event_type")
def made_up_means(t) -> DataFrame:
    """Mean hallucination of each run, N/A for a run without any."""
    rate = F.when((F.col("event_type") != "error") & (F.col("value") > 3), F.floor("value") / 64)
    return J.made_up_rates(t("events").select(F.col("event_type").alias("run"), rate.alias("rate")), "run", "rate")


QUERIES, ORACLES = registry.queries, registry.oracles
