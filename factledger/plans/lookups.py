"""Look-ups, samples, budgets, counted filters, keyed tables and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.operators import grounding as G
from factledger.operators import lookups as L
from factledger.operators import retrieval as R
from factledger.operators import review as V
from factledger.operators import sampling as M
from factledger.operators import structure as S
from factledger.operators import vector_index as I
from factledger.plans.common import Registry
from factledger.sources import store, tables

registry = Registry()
query = registry.query


@query("""
SELECT l_partkey AS chunk_id, arg_max(l_orderkey, (o_orderdate, l_orderkey)) AS record FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey
""")
def chunk_owners(t) -> DataFrame:
    """The record of each chunk (here: the order of each part); of several the latest."""
    listed = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("chunks")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return L.owners(listed, "l_orderkey", "chunks", "o_orderdate")


SQL_META = """
  SELECT id, any_value(meta) AS meta FROM (
    SELECT 'c' || c_custkey::VARCHAR AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS meta FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
    UNION ALL SELECT 'c' || c_custkey::VARCHAR || '_' || substr(md5(c_name), 1, 4), c_mktsegment || ' part' FROM customer WHERE c_nationkey < 15
  ) GROUP BY id
"""


@query(f"""
WITH m AS ({SQL_META}), r AS (SELECT c_custkey, 'c' || c_custkey::VARCHAR AS base, 'c' || c_custkey::VARCHAR || '_' || substr(md5(c_name), 1, 4) AS raw FROM customer)
SELECT c_custkey, raw, coalesce(a.meta, b.meta) AS meta FROM r LEFT JOIN m a ON a.id = base LEFT JOIN m b ON b.id = raw
""")
def dual_key_metadata(t) -> DataFrame:
    """Metadata of a sub-chunk under its parent's id, or else under its own."""
    raw = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("_"), F.substring(F.md5("c_name"), 1, 4))
    rows = t("customer").select("c_custkey", raw.alias("raw"))
    parents = t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).select(R.base_chunk(raw).alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("meta"))
    own = t("customer").where("c_nationkey < 15").select(raw.alias("id"), F.concat("c_mktsegment", F.lit(" part")).alias("meta"))
    return L.look_up(rows, [R.base_chunk(F.col("raw")), F.col("raw")], parents.unionByName(own), "id", "meta")


@query("""
WITH f AS (SELECT CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS record, p_brand || ' ' || p_type AS metric, CASE WHEN s_nationkey % 4 <> 0 THEN year(l_shipdate)::VARCHAR END AS period FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT record, metric, row_number() OVER (PARTITION BY record ORDER BY count(*) DESC, metric) AS n FROM f WHERE record IS NOT NULL GROUP BY record, metric),
a AS (SELECT metric, row_number() OVER (ORDER BY count(*) DESC, metric) AS n FROM f GROUP BY metric),
p AS (SELECT record, list(DISTINCT period ORDER BY period) AS periods FROM f WHERE record IS NOT NULL AND period IS NOT NULL GROUP BY record),
q AS (SELECT n_nationkey AS request_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 7 = 0 THEN 1000 + n_nationkey ELSE n_nationkey END AS record FROM nation)
SELECT request_id, q.record, md5(coalesce(CASE WHEN q.record IS NULL THEN (SELECT string_agg(metric, ',' ORDER BY n) FROM a WHERE n <= 100) ELSE (SELECT string_agg(metric, ',' ORDER BY n) FROM m WHERE m.record = q.record AND n <= 20) END, '')) AS metrics_md5,
  array_to_string(coalesce(p.periods, (SELECT list(DISTINCT period ORDER BY period) FROM f WHERE period IS NOT NULL)), ',') AS periods
FROM q LEFT JOIN p ON p.record = q.record
""")
def schema_context(t) -> DataFrame:
    """What a planner is told: metrics and periods of the record asked for, or of all."""
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation = F.col("s_nationkey")
    facts = joined.select(F.when(nation != 3, nation).alias("record"), F.concat_ws(" ", "p_brand", "p_type").alias("metric"), F.when(nation % 4 != 0, F.year("l_shipdate").cast("string")).alias("period"))
    n = F.col("n_nationkey")
    requests = t("nation").select(n.alias("request_id"), F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, n + 1000).otherwise(n).alias("record"))
    out = L.schema_context(facts, requests, most=20, most_overall=100)
    return out.select("request_id", "record", F.md5(F.array_join("metrics", ",")).alias("metrics_md5"), F.array_join("periods", ",").alias("periods"))


@query("""
WITH d AS (SELECT doc_id, source, md5('pool' || doc_id::VARCHAR) AS draw, length(text) // 4 AS n FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4') AND length(text) >= 4),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, source FROM s WHERE before < 20000
""")
def distractor_pool(t) -> DataFrame:
    """Texts of some sources drawn until they come to 20,000 tokens."""
    rows = t("documents").where(F.col("source").isin("src1", "src2", "src3", "src4"))
    return M.pool(rows, "doc_id", text.word_count_estimate(F.col("text")), 20_000, "pool").select("doc_id", "source")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('pool' || o_orderkey::VARCHAR), o_orderkey LIMIT 2000")
def supported_sample(t) -> DataFrame:
    """2,000 rows of a pool, the same on every run."""
    return M.smallest(t("orders").where("o_orderstatus = 'F'"), "o_orderkey", 2000, "pool").select("o_orderkey", "o_totalprice")


@query("""
WITH s AS (SELECT conv_id AS row_id, sum(length(text))::BIGINT // 4 AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
k AS (SELECT row_id, n >= 512 AS long, row_number() OVER (PARTITION BY n >= 512 ORDER BY md5('latency' || row_id::VARCHAR), row_id) AS r FROM s WHERE row_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 0))
SELECT row_id, long FROM k WHERE r <= 50
""")
def latency_sample(t) -> DataFrame:
    """50 short and 50 long prompts."""
    sizes = t("conversations").where("text IS NOT NULL").groupBy(F.col("conv_id").alias("row_id")).agg(F.floor(F.sum(F.length("text")) / 4).alias("n"))
    return M.by_length(sizes, "row_id", "n", t("conversations").where("role = 'user' AND turn = 0").select(F.col("conv_id").alias("row_id"))).select("row_id", "long")


SQL_ITEMS = r"""
i0 AS (
  SELECT doc_id, text, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM documents WHERE length(text) > {most}
), i1 AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS a FROM i0
), i2 AS (
  SELECT doc_id, a, 1 AS b, s AS part, false AS first FROM i1 WHERE length(s) <= {most}
  UNION ALL SELECT doc_id, a, b, part, b = 1 FROM (SELECT doc_id, a, unnest(string_split_regex(s, '\s+')) AS part, generate_subscripts(string_split_regex(s, '\s+'), 1) AS b FROM i1 WHERE length(s) > {most})
), i3 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS k FROM i2
), i4 AS (
  SELECT doc_id, 1::BIGINT AS k, 1 AS piece, length(part) AS size FROM i3 WHERE k = 1
  UNION ALL
  SELECT i3.doc_id, i3.k, piece + (NOT fits)::INT, CASE WHEN fits THEN size + 1 + length(part) ELSE length(part) END
  FROM (SELECT i3.*, i4.piece, i4.size, i4.size + length(i3.part) < {most} AND NOT i3.first AS fits FROM i4 JOIN i3 ON i3.doc_id = i4.doc_id AND i3.k = i4.k + 1) i3
)"""


@query(f"""
WITH RECURSIVE {SQL_ITEMS.format(most=400)}
SELECT doc_id, piece, string_agg(part, ' ' ORDER BY k) AS text FROM i4 JOIN i3 USING (doc_id, k) GROUP BY doc_id, piece
UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= 400
""")
def sentence_pieces(t) -> DataFrame:
    """Documents in pieces of up to 400 characters at sentence ends, long sentences by words."""
    pieces = t("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(S.sentence_column(400)("text")).alias("piece", "text"))
    return pieces.select("doc_id", (F.col("piece") + 1).alias("piece"), "text")


@query("""
WITH t AS (SELECT conv_id, turn, sum(length(coalesce(text, '')) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations)
SELECT conv_id, count(*) AS kept, max(turn) AS last_turn, max(so_far)::BIGINT AS tokens FROM t WHERE so_far <= 300 GROUP BY conv_id
""")
def prompt_budget(t) -> DataFrame:
    """Turns of a conversation from its start while they fit 300 tokens."""
    rows = t("conversations").withColumn("n", text.word_count_estimate(F.coalesce("text", F.lit(""))))
    return M.within(rows, "conv_id", "turn", F.col("n"), 300).groupBy("conv_id").agg(F.count("*").alias("kept"), F.max("turn").alias("last_turn"), F.sum("n").alias("tokens"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_type = 'PROMO' AND p_size % 4 <> 1 THEN 'gold' WHEN p_type <> 'PROMO' THEN 'test' END AS shape,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_type <> 'PROMO' OR p_size % 4 <> 1 THEN p_name END AS question, CASE WHEN p_size % 4 NOT IN (0, 1) AND p_type = 'PROMO' THEN p_size END AS page, CASE WHEN p_size % 4 <> 0 AND p_type <> 'PROMO' THEN p_retailprice::DOUBLE END AS price FROM part
""")
def two_shapes(t) -> DataFrame:
    """JSON lines of two shapes, some of neither and some that are broken."""
    gold = F.to_json(F.struct(F.col("p_name").alias("question"), F.struct(F.when(F.col("p_size") % 4 != 1, F.col("p_size")).alias("page")).alias("evidence")))
    test = F.to_json(F.struct(F.struct(F.col("p_name").alias("text"), F.col("p_retailprice").cast("double").alias("price")).alias("prompt")))
    line = F.when(F.col("p_type") == "PROMO", gold).otherwise(test)
    lines = t("part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.expr("left(p_name, 3)")).otherwise(line).alias("value"))
    shapes = {"gold": {"question": ("$.question", "string"), "page": ("$.evidence.page", "int")}, "test": {"question": ("$.prompt.text", "string"), "price": ("$.prompt.price", "double")}}
    return tables.shaped(lines, shapes).drop("value")


@query(r"""
WITH d AS (SELECT *, NOT coalesce(source = 'src3' AND lang = 'en', false) AS inbound, coalesce(length(text) - length(replace(text, chr(10), '')) + 1 BETWEEN 1 AND 12 AND text <> '', false) AS sized,
  CASE WHEN contains(source, '1') THEN '1' WHEN contains(source, '2') THEN '2' WHEN contains(source, '5') THEN '5' END AS category FROM documents)
SELECT 'rows' AS counter, count(*) AS n FROM d UNION ALL SELECT 'dropped_inbound', count(*) FILTER (NOT inbound) FROM d UNION ALL SELECT 'dropped_size', count(*) FILTER (inbound AND NOT sized) FROM d
UNION ALL SELECT 'dropped_category', count(*) FILTER (inbound AND sized AND category IS NULL) FROM d UNION ALL SELECT 'kept', count(*) FILTER (inbound AND sized AND category IS NOT NULL) FROM d
UNION ALL SELECT 'category_' || category, count(*) FROM d WHERE inbound AND sized AND category IS NOT NULL GROUP BY category
""")
def counted_filters(t) -> DataFrame:
    """Rows dropped by an inbound label, a size cap and a category rule, and rows kept by category: all counted in the pass that writes what is kept."""
    lines = F.when(F.col("text") != "", F.size(F.split("text", "\n")))
    rows = t("documents").withColumn("category", L.first_category(F.col("source"), ("1", "2", "5")))
    rules = {"inbound": ~F.coalesce((F.col("source") == "src3") & (F.col("lang") == "en"), F.lit(False)), "size": lines.between(1, 12), "category": F.col("category").isNotNull()}
    kept, seen = L.counted(rows, rules)
    spark = kept.sparkSession
    place = store.scratch(spark, "kept")
    kept.select("doc_id", "category").write.parquet(place)
    totals = spark.createDataFrame(sorted(seen.get.items()), "counter string, n long")  # a row for each rule
    return totals.unionByName(spark.read.parquet(place).groupBy(F.concat(F.lit("category_"), "category").alias("counter")).agg(F.count("*").alias("n")))


@query(r"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ANSWER:' || chr(10) || left(text, 20) || chr(10) || '--' || chr(10) ELSE '' END || 'QUESTION (THIS DOES NOT COUNT AS BACKGROUND INFORMATION):' || chr(10) || split_part(text, '.', 1) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '--' || chr(10) END
  || 'DOCUMENT:' || chr(10) || text || chr(10) || ' --' || chr(10) || 'ANSWER:' || chr(10) || right(text, 30) || chr(10) || '--' AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(regexp_extract(p, '(?s)QUESTION \(THIS DOES NOT COUNT AS BACKGROUND INFORMATION\):\s*\n(.*?)\n\s*--', 1), '^\s+|\s+$', '', 'g')) AS question, md5(regexp_replace(regexp_extract(p, '(?s)DOCUMENT:\s*\n(.*?)\n\s*--', 1), '^\s+|\s+$', '', 'g')) AS context,
  md5(regexp_replace(regexp_extract(p, '(?s)ANSWER:\s*\n(.*?)\n\s*--', 1), '^\s+|\s+$', '', 'g')) AS answer FROM p
""")
def prompt_sections(t) -> DataFrame:
    """Question, document and answer of prompts; some answers come first or twice, some questions have no end of their own."""
    k, line = F.col("doc_id"), F.lit("\n")
    early = F.when(k % 3 == 0, F.concat(F.lit("ANSWER:\n"), F.expr("left(text, 20)"), F.lit("\n--\n"))).otherwise("")
    question = F.concat(F.lit("QUESTION (THIS DOES NOT COUNT AS BACKGROUND INFORMATION):\n"), F.substring_index("text", ".", 1), line, F.when(k % 5 == 0, "").otherwise("--\n"))
    prompt = F.concat(early, question, F.lit("DOCUMENT:\n"), "text", F.lit("\n --\nANSWER:\n"), F.expr("right(text, 30)"), F.lit("\n--"))
    parts = t("documents").where("text IS NOT NULL").select("doc_id", V.prompt_sections(prompt).alias("s"))
    return parts.select("doc_id", *(F.md5(F.col("s")[c]).alias(c) for c in ("question", "context", "answer")))


@query("""
WITH c AS (SELECT doc_id AS id, 1 AS change, source AS text, false AS gone FROM documents UNION ALL SELECT doc_id, 2, NULL, true FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 3, lang, false FROM documents WHERE doc_id % 14 = 0 OR doc_id % 5 = 0)
SELECT id, arg_max(coalesce(text, ''), change) AS text FROM c WHERE id % 3 = 0 GROUP BY id HAVING NOT arg_max(gone, change)
""")
def keyed_table(t) -> DataFrame:
    """Rows upserted, deleted and added again, then got by id; half-way the table is compacted."""
    docs = t("documents")
    table = store.KeyedTable(docs.sparkSession, store.scratch(docs.sparkSession, "keyed"), "id long, text string", buckets=8)
    k = F.col("doc_id")
    table.upsert(docs.select(k.alias("id"), "source").withColumnRenamed("source", "text"))
    table.delete(docs.where(k % 7 == 0).select(k.alias("id")))
    table.compact()
    table.upsert(docs.where((k % 14 == 0) | (k % 5 == 0)).select(k.alias("id"), F.col("lang").alias("text")))
    return table.get(docs.where(k % 3 == 0).select(k.alias("id"))).select("id", F.coalesce("text", F.lit("")).alias("text"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank, vec_id, similarity FROM s QUALIFY rank <= 4
""")
def cached_topk(t) -> DataFrame:
    """Nearest vectors through a cache: half of the queries are asked first, then all, and only the other half is searched for."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    place = store.scratch(vectors.sparkSession, "cache")

    def search(missing: DataFrame) -> DataFrame:
        asked = missing.select("key", F.col("query").cast("long").alias("id")).join(vectors, "id")
        found = R.nearest(vectors, asked.select("id", "embedding"), 4).join(asked.select("key", F.col("id").alias("query_id")), "query_id")
        return found.selectExpr("key", "row_number() OVER (PARTITION BY key ORDER BY similarity DESC, vec_id) AS rank", "vec_id", "similarity")

    ask = lambda part: store.cached(vectors.where(part).select(F.col("id").cast("string").alias("query"), F.lit("plain").alias("kind")), search, place, "vec_id long, similarity double", {"k": 4}, "v1")
    ask("id % 100 = 0")
    return ask("id % 50 = 0").select(F.col("query").cast("long").alias("query_id"), F.inline("results"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 5
""")
def indexed_topk(t) -> DataFrame:
    """The five nearest vectors by way of the index: near cells first, then every cell that could hold a nearer one."""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return I.search(I.build(vectors, cells=32), vectors.where("id % 50 = 0"), 5, probes=8, exact=True)


@query(r"""
SELECT event_id, event_type FROM events WHERE value > 60 OR ((json_extract_string(props, '$.k'))::INT % 4 = 0) OR (user_id % 9 = 0 AND event_type <> ' ')
  OR regexp_matches(CASE WHEN (json_extract_string(props, '$.k'))::INT > 80 THEN props ELSE event_type END, '\d') OR (event_type <> '' AND user_id % 5 = 0)
""")
def useful_facts(t) -> DataFrame:
    """Facts that hold something: a value, a period, a nuance, a digit in their quote, or a metric with a unit."""
    k = F.get_json_object("props", "$.k").cast("int")
    none = F.lit(None).cast("string")
    facts = t("events").withColumns({
        "num_value": F.when(F.col("value") > 60, F.col("value")), "period_end": F.when(k % 4 == 0, k.cast("string")).otherwise(" "), "text_nuance": F.when(F.col("user_id") % 9 == 0, F.col("event_type")).otherwise(none),
        "grounding_quote": F.when(k > 80, F.col("props")).otherwise(F.col("event_type")), "metric_name": F.col("event_type"), "unit": F.when(F.col("user_id") % 5 == 0, "USD").otherwise(""),
    })
    return G.useful(facts).select("event_id", "event_type")


@query("SELECT user_id AS entity_id, event_type AS metric_name, min((ts, event_id))[1]::TIMESTAMP AS at FROM events GROUP BY user_id, event_type")
def first_metrics(t) -> DataFrame:
    """Where each entity's metrics were first seen."""
    return G.distinct_metrics(t("events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("metric_name"), F.col("ts").alias("at")))


SQL_NUMBER = "CASE p_size % 5 WHEN 0 THEN '$' || p_retailprice::VARCHAR WHEN 1 THEN '(' || p_size::VARCHAR || ')' WHEN 2 THEN p_size::VARCHAR || '%' WHEN 3 THEN '1,' || lpad(p_partkey::VARCHAR, 6, '0') ELSE p_name END"


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_retailprice::DOUBLE WHEN 1 THEN -p_size::DOUBLE WHEN 2 THEN p_size / 100.0::DOUBLE WHEN 3 THEN 1000000 + p_partkey::DOUBLE END AS value FROM part
""")
def cleaned_numbers(t) -> DataFrame:
    """Numbers with signs, brackets, percents and separators; words are none."""
    kind = F.col("p_size") % 5
    shown = (
        F.when(kind == 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).when(kind == 1, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).when(kind == 2, F.concat(F.col("p_size").cast("string"), F.lit("%")))
        .when(kind == 3, F.format_number(F.col("p_partkey") + 1_000_000, 0)).otherwise(F.col("p_name"))
    )
    return t("part").select("p_partkey", numeric.clean_number(shown).alias("value"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace('<THINK>' || left(text, 40) || chr(10) || '</think>' || text || '```json' || right(text, 9) || '```', '(?is)<think>.*?</think>', '', 'g'), '```[a-zA-Z]*', '', 'g')) AS answer_md5 FROM documents WHERE text IS NOT NULL
""")
def reasoning_stripped(t) -> DataFrame:
    """Answers without their reasoning and code fences."""
    answer = F.concat(F.lit("<THINK>"), F.expr("left(text, 40)"), F.lit("\n</think>"), "text", F.lit("```json"), F.expr("right(text, 9)"), F.lit("```"))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.md5(text.strip_reasoning(answer)).alias("answer_md5"))


QUERIES, ORACLES = registry.queries, registry.oracles
