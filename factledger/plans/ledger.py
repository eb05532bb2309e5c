"""Ledger look-ups and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.operators import ledger as L
from factledger.operators import retrieval as R
from factledger.plans.common import SQL_LEDGER, Registry, sql_tokens

registry = Registry()
query = registry.query


def facts(t) -> DataFrame:
    return L.facts_by_entity_year(t("lineitem"), t("orders"), t("customer"), t("nation"))


@query(f"""
WITH ledger AS ({SQL_LEDGER}), f AS (
  SELECT * FROM ledger WHERE entity_id IN ('ID_NATION_0', 'ID_NATION_1', 'ID_NATION_2') AND regexp_matches(period_end, '1999|2000')
    AND (SELECT bool_or(metric_name IN ('Revenue')) FROM ledger) AND metric_name IN ('Revenue')
)
SELECT row_id, entity_id, metric_name, num_value, period_end FROM f ORDER BY entity_id, period_end, row_id LIMIT 10
""")
def ledger_lookup(t) -> DataFrame:
    """Entity, year and exact metric filters, and the first ten facts in ledger order."""
    whole = facts(t)
    scoped = L.in_years(L.in_entities(whole, ["ID_NATION_0", "ID_NATION_1", "ID_NATION_2"]), ["1999", "2000"])
    return L.with_metrics(scoped, whole, ["Revenue"]).orderBy("entity_id", "period_end", "row_id").limit(10)


@query(f"""
WITH ledger AS ({SQL_LEDGER})
SELECT * FROM ledger WHERE contains(lower(metric_name), 'discount') OR contains(lower(metric_name), 'margin')
""")
def ledger_fuzzy_metric(t) -> DataFrame:
    """No metric is called so exactly: names that contain a keyword and pass the lexical gate."""
    whole = facts(t)
    return L.with_metrics(whole, whole, ["discount", "margin"])


@query(f"""
WITH ledger AS ({SQL_LEDGER}), two AS (
  SELECT *, 0 AS ord FROM ledger UNION ALL SELECT md5(row_id) AS row_id, entity_id, metric_name, num_value, period_end, 1 AS ord FROM ledger
)
SELECT row_id, entity_id, metric_name, num_value, period_end FROM two
QUALIFY row_number() OVER (PARTITION BY entity_id, metric_name, period_end, num_value ORDER BY ord, row_id) = 1
""")
def ledger_dedup(t) -> DataFrame:
    """Facts with equal content under other row ids: the first stays."""
    first = facts(t)
    both = first.withColumn("ord", F.lit(0)).unionByName(first.withColumns({"row_id": F.md5("row_id"), "ord": F.lit(1)}))
    return L.first_of(both, ["entity_id", "metric_name", "period_end", "num_value"], "ord", "row_id").drop("ord")


@query("""
WITH s AS (
  SELECT sn.n_name AS entity, cn.n_name AS related, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  GROUP BY ALL
)
SELECT entity, related, quantity FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY quantity DESC, related) <= 2
""")
def ledger_related_pivot(t) -> DataFrame:
    """The two entities most related to each: nations that buy most from a nation's suppliers."""
    nation = t("nation")
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("entity"))
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("related"))
    joined = (
        t("lineitem")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(seller, "s_nationkey")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(buyer, "c_nationkey")
    )
    sums = joined.groupBy("entity", "related").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    return L.top_of(sums, ["entity"], 2, F.desc("quantity"), "related")


@query("""
WITH b AS (
  SELECT p_brand AS brand, sum(p_size)::DOUBLE AS "Size in thousands", sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS "Price per share",
    count(*)::DOUBLE AS "Part ratio" FROM part GROUP BY p_brand
), u AS (UNPIVOT b ON "Size in thousands", "Price per share", "Part ratio" INTO NAME metric_name VALUE raw)
SELECT brand, metric_name, CASE WHEN contains(lower(metric_name), 'per share') THEN 'USD/Share' WHEN contains(lower(metric_name), 'ratio') THEN 'Ratio' ELSE 'USD' END AS unit,
  raw * CASE WHEN contains(metric_name, 'thousands') THEN 1000 ELSE 1 END AS num_value FROM u
""")
def melt_units(t) -> DataFrame:
    """Wide to long with units by metric name, and scales where the unit is money."""
    wide = t("part").groupBy(F.col("p_brand").alias("brand")).agg(
        F.sum("p_size").cast("double").alias("Size in thousands"),
        F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("Price per share"),
        F.count("*").cast("double").alias("Part ratio"),
    )
    long = wide.unpivot("brand", [c for c in wide.columns if c != "brand"], "metric_name", "raw")
    unit = numeric.unit_of(F.col("metric_name"))
    scale = F.when(unit == "USD", numeric.scale_of(F.col("metric_name"))).otherwise(1.0)
    return long.select("brand", "metric_name", unit.alias("unit"), (F.col("raw") * scale).alias("num_value"))


@query(r"""
WITH m AS (
  SELECT p_type AS metric_name FROM part UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT '$ ' || p_retailprice::VARCHAR FROM part
)
SELECT metric_name, count(*) AS n FROM m WHERE regexp_matches(metric_name, '[a-zA-Z]') AND NOT regexp_full_match(trim(metric_name), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
GROUP BY metric_name ORDER BY n DESC, metric_name LIMIT 500
""")
def metric_frequency_topk(t) -> DataFrame:
    """The 500 most frequent metric names; numbers and amounts are noise."""
    part = t("part")
    names = part.select(F.col("p_type").alias("metric_name")).union(part.select(F.col("p_size").cast("string"))).union(part.select(F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"))))
    counted = names.where(~numeric.is_noise(F.col("metric_name"))).groupBy("metric_name").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "metric_name").limit(500)


@query("""
WITH j AS (SELECT p_brand, p_type, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT p_brand, p_type, count(*) AS n FROM j GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c)
SELECT p_brand, string_agg(p_type, '; ' ORDER BY k) AS metrics, (SELECT string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) FROM j WHERE j.p_brand = r.p_brand) AS periods
FROM r WHERE k <= 3 GROUP BY p_brand
""")
def metrics_by_record(t) -> DataFrame:
    """For each record its most frequent metrics in order, and its distinct periods."""
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type", F.year("l_shipdate").cast("string").alias("y"))
    counted = joined.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.collect_set("y").alias("ys"))
    top = L.top_of(counted, ["p_brand"], 3, F.desc("n"), "p_type").groupBy("p_brand").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_type"))), lambda x: x["p_type"]), "; ").alias("metrics")
    )
    periods = counted.groupBy("p_brand").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ys")))), ",").alias("periods"))
    return top.join(periods, "p_brand")


@query("""
SELECT o_orderkey, c_mktsegment AS company_label FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment IN ('BUILDING', 'EXP_GLOBAL', 'Global_Entity') AND CASE WHEN o_orderstatus = 'P' THEN 'UNALIGNED' WHEN o_orderstatus = 'F' THEN 'EXACT' END IS DISTINCT FROM 'UNALIGNED'
""")
def company_scope(t) -> DataFrame:
    """One company's rows or nobody's, without those that failed to align; an unknown status stays."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "P", "UNALIGNED").when(F.col("o_orderstatus") == "F", "EXACT")
    return L.aligned(L.in_company(joined, F.col("c_mktsegment"), "BUILDING"), status).select("o_orderkey", F.col("c_mktsegment").alias("company_label"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")
def nuance_focus(t) -> DataFrame:
    return L.with_nuance(t("orders"), F.col("o_orderpriority"), "Urgent").select("o_orderkey", "o_orderpriority")


@query(f"""
WITH q AS (SELECT item_id AS query_id, list_distinct({sql_tokens("text")}) AS q FROM benchmark),
d AS (SELECT doc_id AS id, list_distinct({sql_tokens("text")}) AS w FROM documents),
h AS (SELECT query_id, id, len(list_intersect(q, w)) / len(q) AS recall FROM q, d WHERE len(q) > 0)
SELECT query_id, id, round(recall, 6) AS recall FROM h WHERE recall >= 0.8
""")
def lexical_gate(t) -> DataFrame:
    """Documents with at least 80 % of an item's distinct tokens."""
    return R.gate(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), t("documents").select(F.col("doc_id").alias("id"), "text"), 0.8)


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 4
""")
def vector_topk(t) -> DataFrame:
    """The four nearest vectors of every fiftieth vector, over all vectors."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.nearest(vectors, vectors.where("id % 50 = 0"), 4)


@query("""
WITH x AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings),
c AS (SELECT label, i, round(sum(embedding[i]::DECIMAL(18,12))::DOUBLE / count(*), 9) AS v FROM x GROUP BY ALL),
v AS (SELECT label, list(v ORDER BY i) AS v FROM c GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.label < b.label
""")
def label_orthogonality(t) -> DataFrame:
    """Cosine of each two labels' mean vectors; a row for each pair of labels."""
    cells = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("decimal(18,12)")).cast("double") / F.count("*"), 9).alias("v"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    a, b = centroids.select(F.col("label").alias("a"), F.col("v").alias("va")), centroids.select(F.col("label").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(numeric.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("""
WITH j AS (SELECT p_brand, p_type, p_size, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT p_brand, p_size, count(*) AS n FROM j WHERE l_quantity >= 40 GROUP BY ALL),
k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = n.p_brand AND p.p_size = n.p_size AND p.p_type = 'PROMO'))
SELECT p_brand, p_size, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS rank FROM k QUALIFY rank <= 3
""")
def expand_chunks_by_frequency(t) -> DataFrame:
    """The three keys that hits of a group name most often and that aren't there yet."""
    hits = t("lineitem").where("l_quantity >= 40").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.expand_by_frequency(hits, t("part").where("p_type = 'PROMO'").select("p_brand", "p_size").distinct(), "p_brand", "p_size")


@query("""
WITH f AS (SELECT doc_id, 'doc_' || doc_id::VARCHAR || CASE WHEN quality = 1 THEN '_' || substr(md5(doc_id::VARCHAR), 1, 4) ELSE '' END AS chunk FROM labels)
SELECT doc_id, chunk FROM f WHERE regexp_replace(chunk, '_[0-9a-f]{4}$', '') IN (SELECT 'doc_' || doc_id::VARCHAR FROM documents WHERE lang = 'en')
""")
def expand_facts_by_chunk(t) -> DataFrame:
    """Facts whose chunk id, without its sub-chunk suffix, is among the chunks at hand."""
    suffix = F.when(F.col("quality") == 1, F.concat(F.lit("_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4))).otherwise("")
    rows = t("labels").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix).alias("chunk"))
    present = t("documents").where("lang = 'en'").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("base"))
    return rows.join(present, R.base_chunk(F.col("chunk")) == F.col("base"), "left_semi")


RANKED = """
  SELECT source, doc_id AS id, text, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT source, d.doc_id, text, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 5 END + contains(lower(text), 'tion')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'cio')::INT AS score
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
  ) QUALIFY rank <= 5
"""


def ranked(t) -> DataFrame:
    chunks = t("documents").select(F.col("doc_id").alias("id"), "source", "text")
    linked = t("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return R.rank_chunks(chunks, linked, ["tion", "und", "cio"], "source")


@query(f"SELECT source, id, score, rank FROM ({RANKED})")
def rank_chunks(t) -> DataFrame:
    """The five best chunks of each source: linked to a fact, then keywords, then id."""
    return ranked(t).select("source", "id", "score", "rank")


@query(f"SELECT source, md5(string_agg('--- CHUNK_ID: ' || id::VARCHAR || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY rank)) AS context_md5 FROM ({RANKED}) GROUP BY source")
def assemble_context(t) -> DataFrame:
    """The context text of each source's ranked chunks."""
    return R.assemble(ranked(t), "source").select("source", F.md5("context").alias("context_md5"))


@query("""
SELECT c_custkey, bool_or(NOT o_orderpriority IN ('1-URGENT', '2-HIGH')) AS "foreign", count(DISTINCT o_orderpriority) AS entities,
  bool_or(NOT o_orderpriority IN ('1-URGENT', '2-HIGH')) OR count(DISTINCT o_orderpriority) > 1 AS bleed
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey
""")
def bleed_flag(t) -> DataFrame:
    """Whether a group's rows name an entity that wasn't asked for, or several."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.bleed(rows, "c_custkey", "o_orderpriority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("""
SELECT conv_id, bool_and(conv_id * 3 + turn IN (SELECT doc_id FROM documents)) AS eligible FROM conversations GROUP BY conv_id
""")
def eligibility_all_indexed(t) -> DataFrame:
    """Records all of whose chunks are indexed."""
    index = t("documents").select(F.col("doc_id").alias("chunk"), F.lit(True).alias("found")).distinct()
    asked = t("conversations").select("conv_id", (F.col("conv_id") * 3 + F.col("turn")).alias("chunk"))
    return asked.join(index, "chunk", "left").groupBy("conv_id").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("eligible"))


@query("""
WITH y AS (SELECT o_custkey, list_distinct(list(year(o_orderdate)::VARCHAR)) AS planned, 'sales in ' || max(year(o_orderdate))::VARCHAR || ' against ' || min(year(o_orderdate))::VARCHAR AS q FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_intersect(planned, list_concat(regexp_extract_all(q, '20[0-9]{2}\\b'), ['1999']))), ',') AS years FROM y
""".replace("\\\\", "\\"))
def year_guard(t) -> DataFrame:
    """Planned years that the question names or implies."""
    year = F.year("o_orderdate").cast("string")
    plans = t("orders").groupBy("o_custkey").agg(
        F.collect_set(year).alias("planned"), F.concat(F.lit("sales in "), F.max(year), F.lit(" against "), F.min(year)).alias("q")
    )
    guarded = R.guarded_years(F.col("planned"), F.col("q"), F.array(F.lit("1999")))
    return plans.select("o_custkey", F.array_join(F.array_sort(guarded), ",").alias("years"))


@query(r"SELECT c_custkey, 'ID_' || upper(regexp_replace(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), '\s+', '_', 'g')) AS entity_id FROM customer")
def entity_canonical(t) -> DataFrame:
    return t("customer").select("c_custkey", text.entity_id(F.col("c_name")).alias("entity_id"))


QUERIES, ORACLES = registry.queries, registry.oracles
