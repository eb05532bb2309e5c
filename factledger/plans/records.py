"""Records of evaluation sets: mapping, attacks, quotas, verdicts, manifests; retrieval legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions.similarity import token_set
from factledger.operators import records as P
from factledger.operators import retrieval as R
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


def corpora(t) -> DataFrame:
    docs, items = t("documents"), t("benchmark")
    turns = t("conversations").groupBy("conv_id").agg(
        F.max(F.when((F.col("role") == "user") & (F.col("turn") <= 1), F.col("text"))).alias("q"), F.max(F.when(F.col("role") == "assistant", F.substring("text", 1, 40))).alias("a"), F.max("turn").alias("n")
    )
    parts = [
        P.mapped(docs, "Docs", F.col("doc_id"), F.substring("text", 1, 30), F.array("text"), F.col("lang"), F.when(F.col("lang") == "en", "Supported").otherwise("General")),
        P.mapped(items, "Items", F.col("item_id"), F.substring("text", 1, 30), F.array(F.col("text"), F.lit("")), F.lit("x"), P.label_of(F.when(F.col("item_id") % 2 == 0, " PASS ").otherwise("Hallucination"))),
        P.mapped(turns, "Talk", F.col("conv_id"), F.col("q"), F.array("a"), F.col("a"), P.label_of(F.when(F.col("n") > 3, "fail"))),
    ]
    return P.corpus(parts)


@query("""
WITH t AS (
  SELECT conv_id, max(text) FILTER (role = 'user' AND turn <= 1) AS q, max(text[1:40]) FILTER (role = 'assistant') AS a, max(turn) AS n FROM conversations GROUP BY conv_id
), c AS (
  SELECT 'Docs' AS dataset_source, CASE WHEN lang = 'en' THEN 'Supported' ELSE 'General' END AS label, text[1:30] AS query, (trim(coalesce(text, '')) <> '')::INT AS chunks FROM documents
  UNION ALL SELECT 'Items', CASE WHEN item_id % 2 = 0 THEN 'Supported' ELSE 'Unfounded' END, text[1:30], (trim(coalesce(text, '')) <> '')::INT FROM benchmark
  UNION ALL SELECT 'Talk', CASE WHEN n > 3 THEN 'Unfounded' END, q, (trim(coalesce(a, '')) <> '')::INT FROM t
)
SELECT dataset_source, label, count(*) AS n, sum(chunks)::BIGINT AS chunks FROM c WHERE coalesce(query, '') <> '' AND chunks > 0 GROUP BY ALL
""")
def corpus_union(t) -> DataFrame:
    """Three corpora mapped to one schema and put together, counted by source and label."""
    return corpora(t).groupBy("dataset_source", "label").agg(F.count("*").alias("n"), F.sum(F.size("context_chunks")).alias("chunks"))


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN c_acctbal < 4000 THEN ' ' END AS meta, CASE WHEN c_nationkey < 8 THEN upper(left(c_name, 3)) || c_nationkey::VARCHAR || '_2020_10K' WHEN c_nationkey < 10 THEN '_x' END AS doc,
  CASE WHEN c_nationkey % 2 = 0 THEN 'finqa_' || left(c_mktsegment, (c_custkey % 9)::INT) || '/2010/p_1' WHEN c_nationkey % 3 = 0 THEN 'x_' || c_name || '/1' END AS record FROM customer)
SELECT c_custkey, coalesce(nullif(trim(meta), ''), nullif(trim(split_part(doc, '_', 1)), ''), nullif(regexp_extract(coalesce(record, ''), '^[a-z]+_([A-Z]{1,5})/', 1), ''), 'Global_Entity') AS company FROM r
""")
def company_resolution(t) -> DataFrame:
    """A record's company from metadata, document name or ticker, in this order."""
    nation = F.col("c_nationkey")
    meta = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).when(F.col("c_acctbal") < 4000, " ")
    doc = F.when(nation < 8, F.concat(F.upper(F.expr("left(c_name, 3)")), nation.cast("string"), F.lit("_2020_10K"))).when(nation < 10, "_x")
    record = F.when(nation % 2 == 0, F.concat(F.lit("finqa_"), F.expr("left(c_mktsegment, int(c_custkey % 9))"), F.lit("/2010/p_1"))).when(nation % 3 == 0, F.concat(F.lit("x_"), "c_name", F.lit("/1")))
    return t("customer").select("c_custkey", P.company_of(meta, doc, record).alias("company"))


@query(r"""
WITH r AS (SELECT d.doc_id, upper(lang) AS final_label, CASE WHEN toxic = 1 THEN 'unfounded' WHEN quality = 1 THEN ' ' END AS teacher, CASE WHEN n_chars % 2 = 0 THEN 'sUPPORTED' END AS label, CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE source END AS dataset, upper(lang) || ' Set' AS src,
  CASE WHEN quality = 0 THEN 'p' || source END AS parent, CASE WHEN n_chars % 5 = 0 THEN 'o' || n_chars::VARCHAR END AS original, CASE WHEN lang = 'en' THEN 'sabotaged_doc_' || d.doc_id::VARCHAR || '_' || left(md5(text), 8) ELSE 'plain' || d.doc_id::VARCHAR END AS id FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
f AS (SELECT *, coalesce(CASE WHEN final_label IN ('EN', 'DE') THEN nullif(trim(teacher), '') ELSE nullif(trim(final_label), '') END, nullif(trim(teacher), ''), nullif(trim(label), ''), 'General') AS l FROM r)
SELECT doc_id, upper(left(l, 1)) || lower(substr(l, 2)) AS label, lower(coalesce(nullif(trim(dataset), ''), nullif(trim(src), ''), 'unknown')) AS dataset_source,
  coalesce(parent, original, CASE WHEN starts_with(id, 'sabotaged_') THEN regexp_extract(id, '^sabotaged_(.*)_[^_]*$', 1) ELSE id END) AS family_id FROM f
""")
def canonical_records(t) -> DataFrame:
    """Label, source and family of a record by their chains of fields, some null and some empty."""
    n, text_ = F.col("n_chars"), F.lit(None).cast("string")
    rows = t("documents").join(t("labels"), "doc_id").select(
        "doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("sabotaged_doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.expr("left(md5(text), 8)"))).otherwise(F.concat(F.lit("plain"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("lang").isin("en", "de"), F.when(F.col("lang") == "en", text_).otherwise(" ")).otherwise(F.upper("lang")).alias("final_label"), F.when(F.col("toxic") == 1, "unfounded").when(F.col("quality") == 1, " ").alias("teacher_label"),
        F.when(n % 2 == 0, "sUPPORTED").alias("label"), F.when(n % 3 == 0, " ").otherwise(F.col("source")).alias("dataset_source"), F.concat(F.upper("lang"), F.lit(" Set")).alias("source"),
        F.when(F.col("quality") == 0, F.concat(F.lit("p"), "source")).alias("parent_id"), F.when(n % 5 == 0, F.concat(F.lit("o"), n.cast("string"))).alias("original_id"),
    )
    return P.canonical(rows).select("doc_id", "label", "dataset_source", "family_id")


VALID = "CASE doc_id % 3 WHEN 0 THEN quality = 0 AND toxic = 1 WHEN 1 THEN quality = toxic ELSE true END"


@query(f"SELECT doc_id, {VALID} AS valid, CASE WHEN {VALID} THEN 'verified' WHEN doc_id % 5 = 0 THEN 'review' WHEN doc_id % 5 = 1 THEN 'verified' ELSE 'discarded' END AS status FROM labels")
def verdict_actions(t) -> DataFrame:
    """Verdicts confirmed by their target's mode, and what becomes of the record."""
    k = F.col("doc_id")
    mode = F.when(k % 3 == 0, "strict_injection_match").when(k % 3 == 1, "label_consistency").otherwise("generate_only")
    name = lambda c: F.when(F.col(c) == 1, "supported").otherwise("UNFOUNDED")
    valid = P.validity(mode, F.lit("99 Million"), F.when(F.col("toxic") == 1, "the 99 million figure").otherwise("nothing"), name("toxic"), name("quality"))
    rows = t("labels").select("doc_id", valid.alias("valid"))
    return rows.select("doc_id", "valid", P.action(F.col("valid"), F.when(k % 5 == 0, "review").when(k % 5 == 1, "keep").otherwise("discard")).alias("status"))


SQL_SPANS = """
  SELECT a.p_partkey, lower(a.p_name || ' ' || a.p_type || ' ' || a.p_size::VARCHAR) AS x, lower('the ' || b.p_type || ' ' || b.p_name || ' of ' || b.p_brand) AS y, b.p_brand || ': ' || a.p_name AS why,
    b.p_size % 3 = 0 AS fake FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
"""


@query(f"""
WITH p AS ({SQL_SPANS}), s AS (
  SELECT *, list_sort(list_distinct(string_split(x, ' '))) AS tx, list_sort(list_distinct(string_split(y, ' '))) AS ty FROM p
), d AS (
  SELECT *, array_to_string(list_filter(tx, lambda w: list_contains(ty, w)), ' ') AS b, array_to_string(list_filter(tx, lambda w: NOT list_contains(ty, w)), ' ') AS l, array_to_string(list_filter(ty, lambda w: NOT list_contains(tx, w)), ' ') AS r FROM s
), m AS (
  SELECT *, (1::HUGEINT << length(l)) - 1 AS every, length(b) + (b <> '')::INT AS glue, length(l) + length(r) AS n FROM d
), c AS (
  SELECT *, length(l) - bit_count(list_reduce(list_transform(string_split(r, ''), lambda c: coalesce(list_sum(list_transform(range(length(l)), lambda i: CASE WHEN substr(l, i + 1, 1) = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END)), 0)::HUGEINT),
    lambda row, hit: ((row + (row & hit)) | (row - (row & hit))) & every, every)) AS common FROM m
), q AS (
  SELECT *, CASE WHEN b <> '' AND (l = '' OR r = '') THEN 100::DOUBLE ELSE greatest(100 - 100 * (n - 2 * common)::DOUBLE / (2 * glue + n), CASE WHEN b <> '' THEN greatest(100 - 100 * (1 + length(l))::DOUBLE / (length(b) + glue + length(l)), 100 - 100 * (1 + length(r))::DOUBLE / (length(b) + glue + length(r))) ELSE 0 END) END AS ratio FROM c
)
SELECT p_partkey, round(ratio, 6) AS ratio, fake AND (ratio > 60 OR contains(lower(why), x)) AS valid FROM q
""")
def span_ratios(t) -> DataFrame:
    """How like an injected value and a named error span are as sets of words, and whether that confirms an attack."""
    a, b = t("part"), t("part").select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(c).alias(f"b_{c}") for c in ("p_name", "p_type", "p_brand", "p_size")))
    put = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    span = F.concat(F.lit("the "), "b_p_type", F.lit(" "), "b_p_name", F.lit(" of "), "b_p_brand")
    teacher = F.when(F.col("b_p_size") % 3 == 0, "unfounded").otherwise("Supported")
    valid = P.validity(F.lit("strict_injection_match"), put, span, F.lit("x"), teacher, reasoning=F.concat("b_p_brand", F.lit(": "), "p_name"))
    return a.join(b, "p_partkey").select("p_partkey", F.round(token_set(F.lower(put), F.lower(span)), 6).alias("ratio"), valid.alias("valid"))


@query("""
WITH r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'verified' END AS status, toxic = 1 AS ok FROM labels)
SELECT id, status FROM r WHERE (status = 'review' OR (status IS NULL AND NOT ok)) AND id % 6 <> 0
""")
def review_queue(t) -> DataFrame:
    """What a reviewer still has to look at."""
    k = F.col("doc_id")
    rows = t("labels").select(k.alias("id"), F.when(k % 4 == 0, "review").when(k % 4 == 1, "verified").alias("status"), (F.col("toxic") == 1).alias("valid_sabotage"))
    return P.review_queue(rows, t("labels").where("doc_id % 6 = 0").select(k.alias("id"))).select("id", "status")


DRAW = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT"


@query(f"""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::VARCHAR || ' ' || (['billion', 'thousand'])[({DRAW.format("p_partkey")} % 2 + 1)::INT] || ' in sales' WHEN 1 THEN p_size::VARCHAR || ' ' || (['basis points', 'dollars'])[({DRAW.format("p_partkey")} % 2 + 1)::INT]
  WHEN 2 THEN 'eur ' || p_size::VARCHAR ELSE p_size::VARCHAR || ' units million' END AS answer FROM part
""")
def unit_drift(t) -> DataFrame:
    """Scale and unit words exchanged for one of their alternatives."""
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    answer = F.when(k == 0, F.concat(n, F.lit(" Million in sales"))).when(k == 1, F.concat(n, F.lit(" percent"))).when(k == 2, F.concat(F.lit("USD "), n)).otherwise(F.concat(n, F.lit(" units")))
    return t("part").select("p_partkey", P.drift(answer, F.col("p_partkey")).alias("answer"))


@query(f"""
WITH n AS (SELECT p_partkey, 100 + p_size AS a, 1000 + p_size AS b, 2000 + p_size AS c FROM part)
SELECT p_partkey, 'step = ' || CASE WHEN p_partkey % 3 = 0 THEN a::VARCHAR || ' * 2' WHEN {DRAW.format("p_partkey")} % 2 = 0 THEN (CASE WHEN {DRAW.format("p_partkey::VARCHAR || 'n'")} % 2 = 0 THEN b ELSE c END)::VARCHAR || ' + 77 - 1'
  ELSE a::VARCHAR || ' + ' || (CASE WHEN {DRAW.format("p_partkey::VARCHAR || 'n'")} % 2 = 0 THEN b ELSE c END)::VARCHAR || ' - 1' END AS trace, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'logic' END AS kind FROM n
""")
def logic_lies(t) -> DataFrame:
    """One number of a trace exchanged for one that only the context has; a trace whose context has no other stays."""
    n = lambda k: (F.col("p_size") + k).cast("string")
    alone = F.col("p_partkey") % 3 == 0
    trace = F.when(alone, F.concat(F.lit("step = "), n(100), F.lit(" * 2"))).otherwise(F.concat(F.lit("step = "), n(100), F.lit(" + 77 - 1")))
    context = F.when(alone, F.concat(F.lit("only "), n(100))).otherwise(F.concat(F.lit("from "), n(1000), F.lit(" and "), n(2000), F.lit(", item"), n(5)))
    hit = P.cascade([("logic", P.logic_lie(trace, context, F.col("p_partkey")))])
    return t("part").select("p_partkey", F.coalesce(hit["text"], trace).alias("trace"), F.coalesce(hit["kind"], F.lit("none")).alias("kind"))


@query("""
WITH g AS (SELECT n_name, year(o_orderdate) AS y, count(*)::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
x AS (SELECT *, lead(n) OVER (PARTITION BY y ORDER BY n_name) AS d, lag(n) OVER (PARTITION BY y ORDER BY n_name) AS u, lead(n) OVER (PARTITION BY n_name ORDER BY y) AS r FROM g),
p AS (SELECT n_name, y, n, CASE WHEN d <> n THEN d WHEN u <> n THEN u WHEN r <> n THEN r END AS other FROM x)
SELECT n_name, y, CASE WHEN other IS NULL THEN NULL ELSE 'a total of ' || other || '.' END AS answer FROM p
""")
def neighbour_trap(t) -> DataFrame:
    """An answer's cell replaced by the first neighbour that differs and has a digit."""
    from factledger.operators.factory import neighbours

    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grid = joined.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("string").alias("n"))
    cells = neighbours(grid, "n_name", "y", "n")
    around = F.array(F.struct(F.col("n").alias("cell"), F.array("below", "above", "right").alias("neighbours")), F.struct(F.lit("zzz").alias("cell"), F.array("below").alias("neighbours")))
    return cells.select("n_name", "y", P.neighbour_trap(F.concat(F.lit("a total of "), "n", F.lit(".")), around).alias("answer"))


@query(f"""
WITH o AS (SELECT c_custkey, c_name, c_mktsegment AS s FROM customer),
l AS (SELECT *, list_filter(['Acme', 'Bolt', 'Corvid'], lambda x: x <> CASE WHEN c_custkey % 2 = 0 THEN 'Acme' ELSE 'Delta' END) AS others FROM o)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'sold by ' || others[({DRAW.format("c_custkey")} % len(others) + 1)::INT] || ' in ' || lower(s) END AS answer FROM l
""")
def entity_swap(t) -> DataFrame:
    """The first name of an answer exchanged for another."""
    name = F.when(F.col("c_custkey") % 5 == 0, "nobody").when(F.col("c_custkey") % 2 == 0, "Acme").otherwise("Delta")
    answer = F.concat(F.lit("sold by "), name, F.lit(" in "), F.lower("c_mktsegment"))
    return t("customer").select("c_custkey", P.entity_swap(answer, F.array(F.lit("Acme"), F.lit("Bolt"), F.lit("Corvid")), F.col("c_custkey")).alias("answer"))


BALANCED = "CASE WHEN lang = 'en' THEN 'Supported' WHEN doc_id % 3 = 0 THEN 'General' ELSE 'Unfounded' END"


@query(f"""
WITH r AS (SELECT doc_id AS id, {BALANCED} AS label, doc_id % 7 = 0 AS mutated FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY label, mutated ORDER BY md5(id::VARCHAR), id) AS rank FROM r),
s AS (SELECT label, count(*) FILTER (mutated) AS have, count(*) FILTER (NOT mutated) AS nat, CASE label WHEN 'General' THEN 20 ELSE 40 END AS quota FROM r GROUP BY label),
m AS (SELECT *, CASE WHEN label = 'Unfounded' THEN least(have, greatest(quota // 2, quota - nat)) ELSE least(have, quota) END AS take FROM s)
SELECT id, label, mutated FROM k JOIN m USING (label) WHERE rank <= CASE WHEN mutated THEN take ELSE least(nat, quota - take) END
""")
def balanced_set(t) -> DataFrame:
    """A hundred records by label, 40/40/20; of the unfounded half are mutated if there are so many."""
    label = F.when(F.col("lang") == "en", "Supported").when(F.col("doc_id") % 3 == 0, "General").otherwise("Unfounded")
    rows = t("documents").select(F.col("doc_id").alias("id"), label.alias("label"), (F.col("doc_id") % 7 == 0).alias("mutated"))
    return P.balance(rows, 100, {"Unfounded": 0.4, "Supported": 0.4, "General": 0.2})


@query("""
WITH m AS (SELECT doc_id AS id, source, substr(md5(doc_id::VARCHAR), 1, 3) AS b, md5(doc_id::VARCHAR) AS h FROM documents),
g AS (SELECT b, source, arg_min(id, (h, id)) AS d FROM m GROUP BY b, source),
n AS (SELECT b, source, coalesce(lead(source) OVER w, first_value(source) OVER w) AS other, coalesce(lead(d) OVER w, first_value(d) OVER w) AS d FROM g WINDOW w AS (PARTITION BY b ORDER BY source)),
a AS (SELECT source, min(d) AS d, row_number() OVER (ORDER BY source) AS k FROM g GROUP BY source)
SELECT id, coalesce(CASE WHEN n.other <> m.source THEN n.d END, CASE WHEN m.source <> (SELECT source FROM a WHERE k = 1) THEN (SELECT d FROM a WHERE k = 1) ELSE (SELECT d FROM a WHERE k = 2) END) AS distractor
FROM m JOIN n ON m.b = n.b AND m.source = n.source
""")
def distractor_for_all(t) -> DataFrame:
    """A record of another source for every record."""
    return P.other_source(t("documents").select(F.col("doc_id").alias("id"), "source"))


@query("""
WITH m AS (
  SELECT conv_id AS family, CASE WHEN role = 'user' THEN 'parent' ELSE 'child' END AS role, min(turn) AS id FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL
), p AS (SELECT *, (['pairs_short', 'pairs_long', 'natural_fake', 'natural_true', 'axiom'])[(family % 5 + 1)::INT] AS pool, family % 5 AS k FROM m)
SELECT row_number() OVER (ORDER BY k, md5(family::VARCHAR), family, role DESC) - 1 AS row_id, family, pool, role, id FROM p
""")
def manifest_rows(t) -> DataFrame:
    """Dense row numbers over all pools, a parent before its child."""
    turns = t("conversations").where(F.col("role").isin("user", "assistant"))
    pool = F.element_at(F.array(*map(F.lit, P.POOLS)), (F.col("conv_id") % 5 + 1).cast("int"))
    return P.manifest(turns.select(F.col("conv_id").alias("family"), pool.alias("pool"), F.when(F.col("role") == "user", "parent").otherwise("child").alias("role"), F.col("turn").alias("id")))


@query("""
WITH q AS (SELECT 'q' || (doc_id % 5)::VARCHAR AS q, doc_id FROM documents WHERE doc_id % 3 = 0), k AS (SELECT 'q' || (doc_id % 5)::VARCHAR AS q, doc_id FROM labels WHERE quality = 1),
u AS (SELECT q, doc_id, 0 AS leg FROM q UNION ALL SELECT q, doc_id, 1 FROM k)
SELECT q, doc_id AS id, min(leg)::INT AS leg FROM u GROUP BY ALL
""")
def union_of_legs(t) -> DataFrame:
    """Chunks of two retrieval legs by key; the first leg's stays."""
    leg = lambda name, where: t(name).where(where).select(F.concat(F.lit("q"), (F.col("doc_id") % 5).cast("string")).alias("q"), F.col("doc_id").alias("id"))
    return R.union_of_legs([leg("documents", "doc_id % 3 = 0"), leg("labels", "quality = 1")], "q", "id")


@query("""
WITH a AS (SELECT DISTINCT l_returnflag AS q, p_brand AS related FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48)
SELECT q, related, p_partkey AS id FROM a JOIN part ON p_brand = related QUALIFY row_number() OVER (PARTITION BY q, related ORDER BY p_partkey) <= 2
""")
def related_chunks(t) -> DataFrame:
    """The first two chunks of every entity that a query's facts are related to."""
    hits = t("lineitem").where("l_quantity > 48").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("q"), F.col("p_brand").alias("related"))
    chunks = t("part").select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("id"))
    return R.related_chunks(hits, chunks, "q").select("q", "related", "id")


@query("""
WITH o AS (SELECT o_custkey AS id, bool_or(o_orderpriority LIKE '1%') AS own FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(NOT own, false) AS bleed FROM customer LEFT JOIN o ON id = c_custkey
""")
def origin_bleed(t) -> DataFrame:
    """Chunks whose records all come from another corpus; unknown origins pass."""
    origins = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("record"))
    return R.without_bleed(t("customer").select(F.col("c_custkey").alias("id")), origins, F.lit("1")).select("id", "bleed")


@query("""
WITH p AS (SELECT p_brand AS record, CASE WHEN p_size % 7 = 0 THEN 'Q' || p_size::VARCHAR WHEN p_brand LIKE '%1' THEN 'n/a' ELSE (1990 + p_size)::VARCHAR END AS period FROM part)
SELECT record, coalesce(max(period) FILTER (regexp_full_match(period, '[0-9]{4}')), '2025') AS anchor, (coalesce(max(period) FILTER (regexp_full_match(period, '[0-9]{4}')), '2025')::INT - 1)::VARCHAR AS last_year FROM p GROUP BY record
""")
def temporal_anchors(t) -> DataFrame:
    """Each record's latest year, and the one before it."""
    n = F.col("p_size")
    period = F.when(n % 7 == 0, F.concat(F.lit("Q"), n.cast("string"))).when(F.endswith("p_brand", F.lit("1")), "n/a").otherwise((n + 1990).cast("string"))
    return R.context_of(t("part").select(F.col("p_brand").alias("record"), period.alias("period")), "record")


@query("SELECT doc_id, 'the of' AS query FROM documents UNION ALL SELECT doc_id, 'the qqqq' FROM documents WHERE contains(lower(text), 'qqqq')")
def gate_of_empty_queries(t) -> DataFrame:
    """A query of stop words alone lets every candidate pass; one with a token only those that have it."""
    pairs = t("documents").select("doc_id", "text", F.explode(F.array(F.lit("the of"), F.lit("the qqqq"))).alias("query"))
    return R.gated(pairs).select("doc_id", "query")


QUERIES, ORACLES = registry.queries, registry.oracles
