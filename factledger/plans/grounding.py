"""Proposed facts grounded in texts, whole tables melted, ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import text
from factledger.operators import grounding as G
from factledger.plans.common import Registry

registry = Registry()
query = registry.query

TAIL = "while the clerk of the building segment kept all of the other papers of that office in good order for the whole time"


def proposals(t) -> DataFrame:
    """A fact for each order, quoted in six ways from a sentence that says its price."""
    k, price = F.col("o_orderkey") % 6, F.format_string("%.2f", "o_totalprice")
    source = F.concat(F.lit("Revenues of order were "), price, F.lit(f" dollars, {TAIL}."))
    quote = (
        F.when(k == 0, F.concat(F.lit("were "), price)).when(k == 1, F.concat(F.lit("were  "), price, F.lit("\n dollars"))).when(k == 2, F.concat(F.lit("amounted to "), price, F.lit(" in all")))
        .when(k == 3, "no such words anywhere").when(k == 4, TAIL.replace("papers", "paperss").replace("kept", "keeps")).otherwise(F.concat(F.lit("were "), price))
    )
    return t("orders").select(
        F.lit("ID_ORDERS").alias("entity_id"), F.concat(F.lit("block_"), F.col("o_orderkey").cast("string")).alias("block_id"), F.col("o_orderkey").alias("at"),
        F.when(k == 5, "Shareholder dividends").otherwise("Net revenue").alias("metric_name"), F.col("o_totalprice").cast("double").alias("num_value"), F.lit(None).cast("double").alias("scale"),
        F.lit(None).cast("string").alias("period_start"), F.year("o_orderdate").cast("string").alias("period_end"), F.when(k == 2, "Building").alias("related_entity"),
        F.lit(None).cast("string").alias("text_nuance"), quote.alias("grounding_quote"), source.alias("source"), F.lit("Item 7").alias("section"), F.array(F.lit("Part II"), F.lit("Item 7")).alias("section_path"),
    )


GROUNDED = """
  SELECT o_orderkey, o_totalprice::DOUBLE AS v, year(o_orderdate)::VARCHAR AS y, o_orderkey % 6 AS k, (['EXACT', 'EXACT', 'PARTIAL', 'UNALIGNED', 'FUZZY', 'UNALIGNED'])[(o_orderkey % 6 + 1)::INT] AS status,
    ([0.70::DOUBLE, 0.70::DOUBLE, 0.70::DOUBLE * 0.90::DOUBLE, 0, 0.61::DOUBLE, 0])[(o_orderkey % 6 + 1)::INT] AS confidence FROM orders
"""


@query(f"SELECT o_orderkey, status, round(confidence, 6) AS confidence, (CASE k WHEN 0 THEN 18 WHEN 1 THEN 18 WHEN 2 THEN 23 END)::INT AS start FROM ({GROUNDED})")
def grounded_facts(t) -> DataFrame:
    """How quotes are found (word for word, collapsed, by number, by like words, not at all) and how far facts are trusted."""
    found = G.ground(G.sanitise(proposals(t)))
    start = F.when(F.col("alignment_status") != "FUZZY", F.col("start"))
    return found.select(F.col("at").alias("o_orderkey"), F.col("alignment_status").alias("status"), F.round("confidence", 6).alias("confidence"), start.alias("start"))


@query(f"""
SELECT md5('ID_ORDERS_Net revenue_' || y || '_block_' || o_orderkey::VARCHAR || '_' || v::VARCHAR) AS row_id, 'ID_ORDERS' AS entity_id, 'Net revenue' AS metric_name, v AS num_value, 1.0::DOUBLE AS scale, y AS period_end,
  'Part II > Item 7' AS doc_section, 'block_' || o_orderkey::VARCHAR AS source_chunk_id, CASE WHEN k = 2 THEN 'Related entity (unresolved): Building' END AS text_nuance, status AS alignment_status, round(confidence, 6) AS confidence
FROM ({GROUNDED}) WHERE confidence >= 0.6
""")
def ledger_from_proposals(t) -> DataFrame:
    """Ledger rows end to end: two passes merged, quotes cleaned and grounded, facts under 0.60 left out."""
    first = proposals(t).withColumn("pass", F.lit(1))
    again = proposals(t).withColumns({"pass": F.lit(2), "metric_name": F.upper("metric_name"), "num_value": F.lit(0.0)})
    merged = G.merge_passes(first.unionByName(again), ["block_id"])
    return G.ledger_rows(G.ground(G.sanitise(merged))).withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT status AS alignment_status, count(*) AS n, sum((confidence >= 0.6)::INT)::BIGINT AS accepted, count(*) - sum((confidence >= 0.6)::INT)::BIGINT AS rejected FROM ({GROUNDED}) GROUP BY status")
def alignment_counts(t) -> DataFrame:
    """Proposals by how they aligned, and how many pass the gate."""
    found = G.ground(G.sanitise(proposals(t))).withColumn("ok", F.col("confidence") >= G.ACCEPTED)
    return found.groupBy("alignment_status").agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


SUMS = """
  SELECT n_name, sum(l_quantity::DECIMAL(18,2))::BIGINT AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
"""


def nation_sums(t) -> DataFrame:
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("long").alias("q"), F.count("*").alias("n"))


@query(f"""
WITH s AS ({SUMS})
SELECT n_name AS id, metric_name, num_value, unit, scale, period_end, nuance FROM (
  SELECT n_name, unnest([
    {{'metric_name': 'Sales > Goods', 'num_value': q * 1e3::DOUBLE, 'unit': 'USD', 'scale': 1e3::DOUBLE, 'period_end': 'Fiscal 2023', 'nuance': NULL}},
    {{'metric_name': 'Sales > Goods', 'num_value': -n * 1e3::DOUBLE, 'unit': 'USD', 'scale': 1e3::DOUBLE, 'period_end': 'Fiscal 2022 restated', 'nuance': 'Negative (parentheses) (Restated)'}},
    {{'metric_name': 'Sales > EPS', 'num_value': n::DOUBLE, 'unit': 'USD/Share', 'scale': 1::DOUBLE, 'period_end': 'Fiscal 2023', 'nuance': NULL}},
    {{'metric_name': 'Sales > EPS', 'num_value': NULL, 'unit': 'USD/Share', 'scale': 1::DOUBLE, 'period_end': 'Fiscal 2022 restated', 'nuance': 'Restated'}},
    {{'metric_name': 'Sales', 'num_value': NULL, 'unit': 'USD', 'scale': 1e3::DOUBLE, 'period_end': 'Fiscal 2023', 'nuance': NULL}},
    {{'metric_name': 'Sales', 'num_value': NULL, 'unit': 'USD', 'scale': 1e3::DOUBLE, 'period_end': 'Fiscal 2022 restated', 'nuance': 'Restated'}},
    {{'metric_name': 'Gross margin', 'num_value': 0::DOUBLE, 'unit': 'Ratio', 'scale': 1::DOUBLE, 'period_end': 'Fiscal 2023', 'nuance': 'Dash treated as zero'}},
    {{'metric_name': 'Gross margin', 'num_value': q::DOUBLE, 'unit': 'Ratio', 'scale': 1::DOUBLE, 'period_end': 'Fiscal 2022 restated', 'nuance': 'Restated'}}
  ], recursive := true) FROM s)
""")
def table_melt_hierarchy(t) -> DataFrame:
    """Tables with a header of two lines, indented labels, a restated column and placeholders."""
    n, q = F.col("n").cast("string"), F.col("q").cast("string")
    content = F.concat_ws(
        "\n", F.lit("| | Fiscal | Fiscal |"), F.lit("| Item | 2023 | 2022 restated |"), F.lit("|---|---|---|"), F.lit("| Sales | | |"), F.concat(F.lit("| &nbsp;Goods (1) | $ "), q, F.lit(" | ("), n, F.lit(") |")),
        F.concat(F.lit("| &nbsp;&nbsp;EPS | "), n, F.lit(" | n/a |")), F.concat(F.lit("| Gross margin | — | "), q, F.lit(" |")),
    )
    tables = nation_sums(t).select(F.col("n_name").alias("id"), content.alias("content"), F.lit("Results (in thousands)").alias("context"))
    return G.melt_table(tables).select("id", "metric_name", "num_value", "unit", "scale", "period_end", "nuance")


@query(f"""
WITH s AS ({SUMS})
SELECT n_name AS id, unnest(['Base ($) of ' || n_name || ' Corp', n_name || ' Corp: Score', n_name || ' Corp']) AS metric_name, unnest([100::DOUBLE, n::DOUBLE, q::DOUBLE]) AS num_value, unnest([NULL, NULL, '2021']) AS period_end, n_name || ' Corp' AS related_entity FROM s
""")
def table_melt_entities(t) -> DataFrame:
    """Tables whose first column names companies: columns are the metrics, labels the related entities."""
    content = F.concat_ws("\n", F.lit("| Company | Base ($) | Score | 2021 |"), F.lit("|---|---|---|---|"), F.concat(F.lit("| "), "n_name", F.lit(" Corp | 100 | "), F.col("n").cast("string"), F.lit(" | "), F.col("q").cast("string"), F.lit(" |")))
    tables = nation_sums(t).select(F.col("n_name").alias("id"), content.alias("content"), F.lit("").alias("context"))
    return G.melt_table(tables).select("id", "metric_name", "num_value", "period_end", "related_entity")


@query("""
WITH c AS (SELECT doc_id, text, trim(text) AS s, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM documents)
SELECT doc_id FROM c WHERE length(s) >= 10 AND (contains(text, '$') OR d > 4)
""")
def substantial_blocks(t) -> DataFrame:
    """Texts that may hold a fact: not too short, with money or digits."""
    return G.substantial(t("documents").select("doc_id", F.col("text").alias("content"))).select("doc_id")


@query("""
SELECT l_partkey % 40 AS chunk, md5(string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR)) AS row_ids FROM lineitem WHERE l_quantity > 45 GROUP BY 1
""")
def chunk_row_links(t) -> DataFrame:
    """Each chunk's ledger rows."""
    rows = t("lineitem").where("l_quantity > 45").select((F.col("l_partkey") % 40).alias("chunk"), F.col("l_orderkey").cast("string").alias("row"))
    return G.link_back(rows, "chunk", "row").select("chunk", F.md5(F.array_join("row_ids", ",")).alias("row_ids"))


@query("""
WITH o AS (SELECT o_custkey, min(o_orderkey) AS record FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN record IS NULL THEN 'ID_UNKNOWN' ELSE 'ID_' || record::VARCHAR END AS entity_id, 'ID_' || record::VARCHAR AS company_label, record AS source_record_id FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def entity_patch(t) -> DataFrame:
    """Rows under the entity of their first source record; those without one keep theirs."""
    owners = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("ID_"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.col("o_orderkey").alias("record"))
    rows = t("customer").select("c_custkey", F.lit("ID_UNKNOWN").alias("entity_id"))
    return G.patch_entity(rows, owners, "c_custkey").select("c_custkey", "entity_id", "company_label", "source_record_id")


@query(r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, text FROM documents),
s AS (
  SELECT doc_id, text, len(list_filter(l, lambda x: length(x) - length(replace(x, ',', '')) >= 2)) / nullif(len(l), 0) AS c, len(list_filter(l, lambda x: length(x) - length(replace(x, chr(9), '')) >= 2)) / nullif(len(l), 0) AS t,
    len(list_filter(l, lambda x: len(regexp_extract_all(x, '\d[\d,.]*')) >= 2)) AS n, len(list_filter(l, lambda x: contains(x, '|'))) / nullif(len(l), 0) AS p FROM l
)
SELECT doc_id, CASE WHEN contains(text, '|') AND contains(text, '---') THEN 'pipe' WHEN c >= 0.6 THEN 'csv' WHEN t >= 0.6 THEN 'tsv' WHEN n >= 3 THEN 'numeric' WHEN p >= 0.7 THEN 'pipe' END AS kind FROM s
""")
def table_kinds(t) -> DataFrame:
    """What sort of table a text looks like, if any."""
    return t("documents").select("doc_id", text.table_kind(F.col("text")).alias("kind"))


QUERIES, ORACLES = registry.queries, registry.oracles
