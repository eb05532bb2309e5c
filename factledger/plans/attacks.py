"""Attacks in their order, and contrast sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators import attacks as A
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


def sql_draw(key: str, n: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % ({n}))"


NO_NAMES = ", ".join(f"'{w}'" for w in A.NO_NAMES)


def sql_names(content: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all({content}, '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])([A-Z][a-z]+)(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])', 1), lambda w: length(w) > 2 AND w NOT IN ({NO_NAMES}))))"


SQL_RECORDS = """
  SELECT o_orderkey AS id, o_orderkey::VARCHAR AS k, CASE WHEN o_totalprice > 100000 THEN 'orders of ' || year(o_orderdate)::VARCHAR || ' and 1999' ELSE 'all orders' END AS query,
    'Sold by ' || c_name || ' for ' || (floor(o_totalprice)::BIGINT)::VARCHAR || ' million in ' || c_mktsegment || ' by Acme' AS answer,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'f(' || (floor(o_totalprice)::BIGINT)::VARCHAR || ', 2)' WHEN o_orderpriority = '2-HIGH' THEN '# VERIFICATION f(7)' WHEN o_orderpriority = '3-MEDIUM' THEN '70 + 8' END AS trace,
    CASE WHEN o_custkey % 4 = 0 THEN 'nothing said' ELSE 'Bolt and Corvid of ' || n_name || ' sold ' || (100 + o_custkey)::VARCHAR || ' and 30 pieces' END AS context,
    CASE WHEN o_orderstatus = 'P' THEN 'Million' WHEN o_custkey % 9 = 0 THEN 'USD' WHEN o_custkey % 11 = 0 THEN 'dozen' END AS scale, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS company,
    lead(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR AS below, lag(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::VARCHAR AS above,
    (floor(o_totalprice)::BIGINT)::VARCHAR AS cell, o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND o_custkey % 3 = 0 AS tabled, CASE WHEN o_custkey % 5 = 0 THEN 'elsewhere ' || c_mktsegment END AS distractor
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


@query(rf"""
WITH r AS ({SQL_RECORDS}), n AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(trace, '\b\d+\b'))) AS tn, list_sort(list_distinct(regexp_extract_all(context, '\b\d+\b'))) AS cn,
    {sql_names("replace(answer, ' ', '  ')")} AS an, {sql_names("replace(context, ' ', '  ')")} AS xn FROM r
), l AS (
  SELECT *, list_filter(tn, lambda x: x NOT IN ('0', '1', '2')) AS old, list_filter(cn, lambda x: NOT list_contains(tn, x)) AS new FROM n
), m AS (
  SELECT *, CASE WHEN contains(trace, '(') AND NOT contains(trace, '# VERIFICATION') AND len(old) > 0 AND len(new) > 0
      THEN regexp_replace(trace, '\b' || old[{sql_draw("k", "len(old)")} + 1] || '\b', new[{sql_draw("k || 'n'", "len(new)")} + 1]) END AS logic,
    CASE WHEN tabled THEN coalesce(CASE WHEN below <> cell THEN below END, CASE WHEN above <> cell THEN above END) END AS other,
    CASE WHEN contains(query, 'orders of') THEN 'orders of ' || (split_part(query, ' ', 3)::INT + CASE WHEN {sql_draw("k", "2")} = 0 THEN 1 ELSE -1 END)::VARCHAR || ' and 1999' END AS warped,
    CASE lower(scale) WHEN 'million' THEN (['billion', 'thousand'])[{sql_draw("k || 's'", "2")} + 1] WHEN 'usd' THEN (['EUR', 'GBP', 'shares'])[{sql_draw("k || 's'", "3")} + 1] END AS unit,
    CASE WHEN company IS NOT NULL THEN company ELSE an[{sql_draw("k || 't'", "greatest(len(an), 1)")} + 1] END AS target FROM l
), t AS (
  SELECT *, list_filter(xn, lambda w: w <> target) AS ns FROM m
), s AS (
  SELECT *, CASE WHEN scale IS NOT NULL THEN CASE WHEN lower(scale) = 'million' THEN regexp_replace(answer, '\bmillion\b', unit) WHEN unit IS NOT NULL THEN answer || ' ' || unit END
    WHEN target IS NOT NULL AND len(ns) > 0 THEN regexp_replace(answer, '(?i)\b' || target || '\b', ns[{sql_draw("k || 'n'", "greatest(len(ns), 1)")} + 1]) END AS drift,
    CASE WHEN other IS NOT NULL THEN replace(answer, cell, other) END AS trapped FROM t
), a AS (
  SELECT id, CASE WHEN logic IS NOT NULL THEN 'logic' WHEN trapped IS NOT NULL THEN 'numeric_neighbor_trap' WHEN coalesce(warped, distractor) IS NOT NULL AND (drift IS NULL OR {sql_draw("k || 'order'", "2")} = 0) THEN 'irrelevancy' WHEN drift IS NOT NULL THEN 'semantic_drift' END AS kind, * EXCLUDE (id) FROM s
)
SELECT id, kind, CASE kind WHEN 'logic' THEN 'trace' WHEN 'irrelevancy' THEN CASE WHEN warped IS NOT NULL THEN 'query' ELSE 'context' END WHEN 'numeric_neighbor_trap' THEN 'answer' WHEN 'semantic_drift' THEN 'answer' END AS field,
  CASE kind WHEN 'logic' THEN logic WHEN 'numeric_neighbor_trap' THEN trapped WHEN 'irrelevancy' THEN coalesce(warped, distractor) WHEN 'semantic_drift' THEN drift END AS text FROM a
""")
def attack_cascade(t) -> DataFrame:
    """The first attack that succeeds on each record (here: orders told as answers, queries, traces, contexts and table cells)."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c, price = F.col("o_custkey"), F.col("o_totalprice").cast("bigint").cast("string")
    per = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    priority = F.col("o_orderpriority")
    tabled = priority.isin("4-NOT SPECIFIED", "5-LOW") & (c % 3 == 0)
    cells = F.when(tabled, F.array(F.struct(price.alias("cell"), F.array(F.lead(price).over(per), F.lag(price).over(per), F.lit(None).cast("string")).alias("neighbours"))))
    records = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 100_000, F.concat(F.lit("orders of "), F.year("o_orderdate").cast("string"), F.lit(" and 1999"))).otherwise("all orders").alias("query"),
        F.concat(F.lit("Sold by "), "c_name", F.lit(" for "), price, F.lit(" million in "), "c_mktsegment", F.lit(" by Acme")).alias("answer"),
        F.when(priority == "1-URGENT", F.concat(F.lit("f("), price, F.lit(", 2)"))).when(priority == "2-HIGH", "# VERIFICATION f(7)").when(priority == "3-MEDIUM", "70 + 8").alias("trace"),
        F.when(c % 4 == 0, "nothing said").otherwise(F.concat(F.lit("Bolt and Corvid of "), "n_name", F.lit(" sold "), (c + 100).cast("string"), F.lit(" and 30 pieces"))).alias("context"),
        F.when(F.col("o_orderstatus") == "P", "Million").when(c % 9 == 0, "USD").when(c % 11 == 0, "dozen").alias("scale"), F.when(c % 2 == 0, F.col("c_name")).alias("company"),
        cells.alias("cells"), F.when(c % 5 == 0, F.concat(F.lit("elsewhere "), "c_mktsegment")).alias("distractor"),
    )
    return A.attack(records).select("id", "attack.*")


SQL_SET = "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'Supported' WHEN source IN ('src1', 'src2') THEN 'General' ELSE 'Unfounded' END AS label, CASE WHEN lang <> 'en' AND source NOT IN ('src1', 'src2') AND length(text) % 3 = 0 THEN (doc_id * 7 + 3) % 500 END AS parent, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"


@query(f"""
WITH r AS ({SQL_SET}), k AS (SELECT *, CASE WHEN parent IS NOT NULL THEN 'attacked' ELSE lower(label) END AS kind FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(id::VARCHAR), id) AS rank FROM k),
q AS (SELECT count(*) FILTER (kind = 'attacked') AS have, least(count(*) FILTER (kind = 'unfounded'), 120 - least(count(*) FILTER (kind = 'attacked'), 60)) AS nat, count(*) FILTER (kind = 'general') AS gen FROM k),
a AS (SELECT n.* FROM n, q WHERE kind = 'attacked' AND rank <= least(have, 120 - nat)),
s AS (SELECT *, id IN (SELECT parent FROM a) OR source = 'src7' AS first FROM n WHERE kind = 'supported'),
f AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY md5(id::VARCHAR), id) AS place FROM s)
SELECT id, label, parent, 0 AS copy FROM a UNION ALL SELECT id, label, parent, 0 FROM n, q WHERE kind = 'unfounded' AND rank <= nat
UNION ALL SELECT id, label, parent, 0 FROM f WHERE first OR place <= greatest(0, 120 - (SELECT count(*) FROM f WHERE first))
UNION ALL SELECT id, label, parent, copy::INT FROM (SELECT n.*, unnest(range(60 // gen + (rank <= 60 % gen)::INT)) AS copy FROM n, q WHERE kind = 'general')
""")
def contrast_set(t) -> DataFrame:
    """Three hundred records by label: attacked ones with their parents, a source that comes first, and general ones repeated."""
    general = F.col("source").isin("src1", "src2")
    label = F.when(F.col("lang") == "en", "Supported").when(general, "General").otherwise("Unfounded")
    parent = F.when((F.col("lang") != "en") & ~general & (F.length("text") % 3 == 0), (F.col("doc_id") * 7 + 3) % 500)
    rows = t("documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").alias("id"), label.alias("label"), parent.alias("parent"), "source")
    return A.contrast_set(rows, 300, priority=F.col("source") == "src7").drop("source")


QUERIES, ORACLES = registry.queries, registry.oracles
