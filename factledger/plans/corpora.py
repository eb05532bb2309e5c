"""Five corpora by their own rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import corpora as C
from factledger.plans.common import Registry

registry = Registry()
query = registry.query

NAMES = ", ".join("'" + n.replace("'", "''") + "'" for n in dict.fromkeys(C.COMPANIES))
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""
WITH finqa AS (
  SELECT 'finqa_' || o_orderkey::VARCHAR AS id, 'finqa' AS dataset_source, 'Supported' AS label, 'total of ' || o_orderpriority AS query, list_concat(CASE WHEN o_orderstatus <> 'P' THEN [o_orderpriority, ''] ELSE [] END,
    CASE WHEN o_custkey % 3 > 0 THEN ['| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_custkey::VARCHAR || ' |  |' || chr(10)] ELSE [] END) AS chunks,
    CASE WHEN o_custkey % 5 = 0 THEN '# NO_TRACE_AVAILABLE' ELSE 'step_0 = ' || o_custkey::VARCHAR || ' + 7' || chr(10) || 'print(step_0)' END AS trace, o_orderstatus AS target FROM orders
), pages AS (
  SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant' AND text IS NOT NULL), []) AS paragraphs FROM conversations GROUP BY conv_id
), tatqa AS (
  SELECT 'tatqa_' || c.conv_id::VARCHAR || '-' || turn::VARCHAR, 'tatqa', 'Supported', text, paragraphs, CASE WHEN length(text) % 4 = 0 AND length(text) % 3 > 0 THEN 'result = ' || length(text)::VARCHAR || ' - 2' || chr(10) || 'print(result)' WHEN length(text) % 4 = 1 THEN '{C.LOOKUP}' WHEN length(text) % 4 = 2 THEN '{C.COUNTING}' ELSE '{C.ANALYSIS}' END,
    left(text, 5) || ', ' || right(text, 4) FROM conversations c JOIN pages USING (conv_id) WHERE role = 'user' AND text IS NOT NULL AND length(text) % 7 > 0
), gold AS (
  SELECT 'finbench_gold_' || doc_id::VARCHAR, 'financebench_gold', 'Supported', coalesce(source, ''), list_filter([CASE WHEN lang <> 'de' THEN left(text, 90) END, CASE WHEN n_chars % 2 = 0 THEN right(text, 30) END], lambda x: x IS NOT NULL), '{C.ANALYSIS}', coalesce(lang, '') FROM documents
  WHERE text IS NOT NULL AND (lang <> 'de' OR n_chars % 2 = 0)
), judged AS (
  SELECT 'finbench_test_' || item_id::VARCHAR, 'financebench_test', CASE WHEN length(text) % 3 = 0 THEN 'Unfounded' ELSE 'Supported' END, {STRIP.format("left(text, 12)")}, [{STRIP.format("text")}], '{C.ANALYSIS}', {STRIP.format("right(text, 9)")} FROM benchmark
  WHERE length(text) % 3 < 2 AND {STRIP.format("right(text, 9)")} <> '' AND {STRIP.format("text")} <> ''
), phantom AS (
  SELECT doc_id::VARCHAR, 'phantom_hallucination', CASE WHEN n_chars % 3 = 0 THEN 'Supported' ELSE 'Unfounded' END, {STRIP.format("left(text, 30)")}, [{STRIP.format("text")}], '{C.ANALYSIS}', {STRIP.format("right(text, 20)")} FROM documents WHERE text <> '' AND n_chars % 3 < 2
), axioms AS (
  SELECT event_type, 'truthfulqa_axioms', 'General', props, [], '{C.ANALYSIS}', event_type FROM events WHERE (contains(event_type, 'view') OR contains(event_type, 'click')) AND value > 5
)
SELECT dataset_source, label, CASE WHEN dataset_source IN ('phantom_hallucination', 'truthfulqa_axioms') THEN '' ELSE id END AS id, md5(query) AS query_md5, len(chunks)::INT AS n_chunks, md5(array_to_string(chunks, '|')) AS chunks_md5, md5(trace) AS trace_md5, md5(target) AS target_md5
FROM (FROM finqa UNION ALL FROM tatqa UNION ALL FROM gold UNION ALL FROM judged UNION ALL FROM phantom UNION ALL FROM axioms)
""")
def five_corpora(t) -> DataFrame:
    """Programs, tables with texts, filings (gold and judged), labelled hallucinations and axioms in one schema; rows of the given tables stand for the corpora's."""
    c, turns, docs, n = F.col("o_custkey"), t("conversations"), t("documents"), F.length("text")
    array = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    finqa = t("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") != "P", array(F.col("o_orderpriority"), "")).alias("pre_text"), F.when(c % 3 > 0, F.array(array("a", "b"), array(c.cast("string")))).alias("table"),
        F.lit(None).cast("array<string>").alias("post_text"), F.concat(F.lit("total of "), "o_orderpriority").alias("question"), F.when(c % 5 > 0, F.concat(F.lit("add("), c.cast("string"), F.lit(", 7)"))).alias("program"), F.col("o_orderstatus").alias("exe_ans"),
    )
    kind = F.when(n % 4 == 0, "arithmetic").when(n % 4 == 1, F.when(n % 8 == 1, "span").otherwise("multi-span")).when(n % 4 == 2, "count").otherwise("other")
    question = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("uid"), F.col("text").alias("question"), F.when(n % 7 > 0, F.array(F.expr("left(text, 5)"), F.expr("right(text, 4)"))).otherwise(F.array().cast("array<string>")).alias("answer"), kind.alias("answer_type"),
        F.when(n % 3 > 0, F.concat(n.cast("string"), F.lit("-2"))).alias("derivation"), F.lit("million").alias("scale"),
    )
    said = F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"])
    pages = turns.groupBy("conv_id").agg(said.alias("paragraphs"), F.collect_list(F.when((F.col("role") == "user") & F.col("text").isNotNull(), question)).alias("questions")).withColumn("table", F.lit(None).cast("array<array<string>>"))
    gold = docs.where("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("financebench_id"), F.col("source").alias("question"), F.col("lang").alias("answer"), F.array(F.when(F.col("lang") != "de", F.expr("left(text, 90)")), F.when(F.col("n_chars") % 2 == 0, F.expr("right(text, 30)"))).alias("evidence"),
        F.lit(None).cast("string").alias("doc_name"), F.col("n_chars").alias("doc_period"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("doc_link"),
    )
    prompt = F.concat(F.lit("QUESTION (THIS DOES NOT COUNT AS BACKGROUND INFORMATION):\n"), F.expr("left(text, 12)"), F.lit("\n--\nDOCUMENT:\n"), "text", F.lit("\n--\nANSWER:\n"), F.expr("right(text, 9)"), F.lit("\n--\n"))
    judged = t("benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(n % 3 == 0, "Failed").when(n % 3 == 1, "pass").otherwise("unclear").alias("label"), F.array(prompt).alias("messages"))
    phantom = docs.select(
        F.expr("left(text, 30)").alias("query"), F.col("text").alias("context"), F.expr("right(text, 20)").alias("answer"), F.lit("10k").alias("doc_type"),
        F.when(F.col("n_chars") % 3 == 0, " Not Hallucination").when(F.col("n_chars") % 3 == 1, "hallucination").otherwise("unsure").alias("label"),
    )
    axioms = t("events").where("value > 5").select(F.col("event_type").alias("category"), F.col("props").alias("question"), F.col("event_type").alias("best_answer"), F.lit(None).cast("string").alias("source"))
    parts = [C.programs(finqa), C.tables_and_texts(pages), C.gold_filings(gold), C.judged_filings(judged), C.hallucinations(phantom), C.axioms(axioms, ("View", "click"))]
    drawn = F.col("dataset_source").isin("phantom_hallucination", "truthfulqa_axioms")
    return reduce(DataFrame.unionByName, parts).select(
        "dataset_source", "label", F.when(drawn, "").otherwise(F.col("id")).alias("id"), F.md5("query").alias("query_md5"), F.size("context_chunks").alias("n_chunks"), F.md5(F.array_join("context_chunks", "|")).alias("chunks_md5"),
        F.md5("trace_code").alias("trace_md5"), F.md5("target_sentence").alias("target_md5"),
    )


@query(f"""
WITH n AS (SELECT name, row_number() OVER () AS i FROM (SELECT unnest([{NAMES}]) AS name)),
t AS (SELECT p_partkey, 'A filing of ' || CASE WHEN p_size % 4 > 0 THEN upper((SELECT name FROM n WHERE i = p_partkey % 84 + 1)) || ' and ' || (SELECT name FROM n WHERE i = p_size + 1) ELSE p_name END AS c FROM part)
SELECT p_partkey, CASE coalesce(first, '') WHEN 'CVS' THEN 'CVS Health' WHEN 'PGE' THEN 'PG&E' WHEN '' THEN 'Global_Entity' ELSE first END AS company
FROM (SELECT p_partkey, (SELECT arg_min(name, i) FROM n WHERE contains(lower(c), lower(name))) AS first FROM t)
""")
def companies_in_texts(t) -> DataFrame:
    """The first known company that a text names."""
    names = F.array(*map(F.lit, dict.fromkeys(C.COMPANIES)))
    at = lambda i: F.get(names, i.cast("int"))
    told = F.when(F.col("p_size") % 4 > 0, F.concat(F.upper(at(F.col("p_partkey") % 84)), F.lit(" and "), at(F.col("p_size")))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", C.company_in(F.concat(F.lit("A filing of "), told)).alias("company"))


QUERIES, ORACLES = registry.queries, registry.oracles
