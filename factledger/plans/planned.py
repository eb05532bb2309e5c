"""Retrieval plans by the hundred: facts, chunks and contexts of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import planned as P
from factledger.plans.common import SQL_LEDGER, Registry, sql_tokens
from factledger.plans.ledger import facts

registry = Registry()
query = registry.query

SQL_PLANS = f"""
l AS (
  SELECT *, CASE WHEN round(num_value)::BIGINT % 3 = 0 THEN 'EXP_GLOBAL' WHEN right(entity_id, 1) IN ('1', '3') THEN 'ODD' ELSE 'EVEN' END AS company_label, 'r' || right(period_end, 1) AS source_record_id, CASE WHEN round(num_value)::BIGINT % 5 < 2 THEN 'As Restated' END AS text_nuance,
    CASE WHEN round(num_value)::BIGINT % 11 = 0 THEN 'UNALIGNED' WHEN round(num_value)::BIGINT % 2 = 0 THEN 'EXACT' END AS alignment_status, entity_id || period_end AS ord FROM ({SQL_LEDGER})
), p AS (
  SELECT c_custkey AS query_id, CASE WHEN c_nationkey < 12 THEN ['ID_NATION_' || c_nationkey::VARCHAR, 'ID_NATION_' || (c_nationkey + 1)::VARCHAR, 'ID_NATION_' || c_nationkey::VARCHAR] WHEN c_nationkey < 15 THEN [] END AS entity_ids, CASE WHEN c_acctbal > 5000 THEN 'r' || (c_custkey % 10)::VARCHAR END AS record,
    CASE WHEN c_acctbal < 2000 THEN 'ODD' WHEN c_acctbal < 4000 THEN '' END AS company, CASE WHEN c_mktsegment < 'C' THEN ['1999', '200'] END AS years,
    CASE c_mktsegment WHEN 'BUILDING' THEN ['Revenue', 'nothing'] WHEN 'MACHINERY' THEN ['discount of the years', 'discount'] WHEN 'FURNITURE' THEN [] END AS metrics, CASE WHEN c_custkey % 4 = 0 THEN 'restated' END AS nuance FROM customer
)"""


@query(f"""
WITH {SQL_PLANS}, x AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(metrics) AS m FROM p) WHERE m IN (SELECT metric_name FROM l))
SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY ord, row_id)::INT AS rank FROM p JOIN l ON alignment_status IS DISTINCT FROM 'UNALIGNED'
  AND CASE WHEN len(entity_ids) > 0 AND record <> '' THEN list_contains(entity_ids, entity_id) OR source_record_id = record WHEN len(entity_ids) > 0 THEN list_contains(entity_ids, entity_id) WHEN record <> '' THEN source_record_id = record ELSE true END
  AND (coalesce(company, '') = '' OR company_label IN ('EXP_GLOBAL', 'Global_Entity', company)) AND (coalesce(len(years), 0) = 0 OR len(list_filter(years, lambda y: contains(period_end, y))) > 0)
  AND (coalesce(len(metrics), 0) = 0 OR CASE WHEN query_id IN (SELECT query_id FROM x) THEN list_contains(metrics, metric_name) ELSE len(list_filter(metrics, lambda m: contains(lower(metric_name), lower(m)))) > 0
    AND len(list_filter({sql_tokens("array_to_string(metrics, ' ')")}, lambda w: list_contains({sql_tokens("metric_name")}, w))) > 0 END)
  AND (nuance IS NULL OR contains(lower(text_nuance), nuance)) QUALIFY rank <= 10
""")
def planned_facts(t) -> DataFrame:
    """The first ten facts of each plan in ledger order: scopes of entities, records, both or neither, companies, years, metrics and nuances."""
    return P.facts_of(plans(t), ledger(t)).select("query_id", "row_id", "rank")


def ledger(t) -> DataFrame:
    n = F.round("num_value").cast("bigint")
    return facts(t).select(
        "*", F.when(n % 3 == 0, "EXP_GLOBAL").when(F.expr("right(entity_id, 1)").isin("1", "3"), "ODD").otherwise("EVEN").alias("company_label"), F.concat(F.lit("r"), F.expr("right(period_end, 1)")).alias("source_record_id"),
        F.when(n % 5 < 2, "As Restated").alias("text_nuance"), F.when(n % 11 == 0, "UNALIGNED").when(n % 2 == 0, "EXACT").alias("alignment_status"), F.concat("entity_id", "period_end").alias("ord"),
    )


def plans(t) -> DataFrame:
    nation, balance, segment = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    name = lambda n: F.concat(F.lit("ID_NATION_"), n.cast("string"))
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    return t("customer").select(
        F.col("c_custkey").alias("query_id"), F.when(nation < 12, F.array(name(nation), name(nation + 1), name(nation))).when(nation < 15, words()).alias("entity_ids"),
        F.when(balance > 5000, F.concat(F.lit("r"), (F.col("c_custkey") % 10).cast("string"))).alias("record"), F.when(balance < 2000, "ODD").when(balance < 4000, "").alias("company"), F.when(segment < "C", words("1999", "200")).alias("years"),
        F.when(segment == "BUILDING", words("Revenue", "nothing")).when(segment == "MACHINERY", words("discount of the years", "discount")).when(segment == "FURNITURE", words()).alias("metrics"), F.when(F.col("c_custkey") % 4 == 0, "restated").alias("nuance"),
    )


@query(r"""
WITH c AS (SELECT conv_id AS query_id, conv_id::VARCHAR || '/' || (turn // 2)::VARCHAR AS id, turn AS ord, coalesce(text, '') AS content, role FROM conversations),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY ord) = 1),
s AS (SELECT *, CASE WHEN length(content) % 4 = 0 THEN 5 ELSE 0 END + contains(lower(content), 'tion')::INT + contains(lower(content), 'êa')::INT + contains(lower(content), 'zz')::INT AS score, count(*) OVER (PARTITION BY query_id) AS n FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 2 THEN -score END, ord, id) AS rank FROM s QUALIFY rank <= 2),
f AS (SELECT conv_id AS query_id, length(text) AS v, min(turn) AS rank, any_value(role) AS role FROM conversations WHERE role = 'user' AND length(text) % 2 = 0 GROUP BY conv_id, length(text)),
m AS (SELECT query_id, '| metric_name | num_value |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || v::VARCHAR || ' |' || chr(10), '' ORDER BY rank) AS t FROM f GROUP BY query_id),
x AS (SELECT query_id, string_agg('--- CHUNK_ID: ' || id || ' ---' || chr(10) || 'SECTION: ' || CASE WHEN role = 'user' THEN 'Talk > user' ELSE 'Unknown' END || chr(10) || 'CONTENT:' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS t FROM r GROUP BY query_id)
SELECT q.query_id, md5(chr(10) || '# VERIFIABLE FACT LEDGER (UFL) ROWS' || chr(10) || coalesce(m.t, 'No structured facts found.') || chr(10) || chr(10) || '# SOURCE TEXT CHUNKS' || chr(10) || coalesce(x.t, 'No source text available.') || chr(10) || chr(10) || '# INSTRUCTIONS FOR REASONING:' || chr(10) || 'Cite ids.' || chr(10)) AS context_md5
FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) q LEFT JOIN m ON m.query_id = q.query_id LEFT JOIN x ON x.query_id = q.query_id
""")
def planned_contexts(t) -> DataFrame:
    """Prompt contexts: a conversation's turns stand for its chunks, lengths of what users say for its facts."""
    turns = t("conversations").withColumnRenamed("conv_id", "query_id")
    key = F.concat(F.col("query_id").cast("string"), F.lit("/"), F.floor(F.col("turn") / 2).cast("string"))
    section = F.when(F.col("role") == "user", F.array(F.lit("Talk"), F.lit("user"))).otherwise(F.array().cast("array<string>"))
    chunks = turns.select("query_id", key.alias("id"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("content"), section.alias("section_path"))
    first = chunks.groupBy("query_id", "id").agg(F.min_by("content", "ord").alias("content"))
    linked = first.where(F.length("content") % 4 == 0).select("query_id", F.col("id").alias("source_chunk_id"))
    words = turns.select("query_id").distinct().withColumn("keywords", F.array(F.lit("TION"), F.lit("êa"), F.lit("zz")))
    said = turns.where("role = 'user' AND length(text) % 2 = 0").select("query_id", F.lit("e").alias("entity_id"), F.col("role").alias("metric_name"), F.lit("p").alias("period_end"), F.length("text").alias("num_value"), F.col("turn").alias("rank"))
    out = P.contexts(turns.select("query_id").distinct(), said, P.chunks_of(chunks, linked, words, limit=2), ["metric_name", "num_value", "unit"], "Cite ids.")
    return out.select("query_id", F.md5("context").alias("context_md5"))


QUERIES, ORACLES = registry.queries, registry.oracles
