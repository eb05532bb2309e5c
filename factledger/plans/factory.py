"""Evaluation sets: routing, verdicts, families, balance, mutations and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators import factory as M
from factledger.plans.common import Registry, digest, sql_digest
from factledger.sources.tables import unprocessed

registry = Registry()
query = registry.query


@query("""
SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'toxicity' WHEN quality = 0 THEN 'quality' WHEN lang <> 'en' THEN 'language' ELSE 'skip' END AS target
FROM documents LEFT JOIN labels USING (doc_id)
""")
def audit_router(t) -> DataFrame:
    """The first audit target whose rule holds."""
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    rules = [("toxicity", (F.col("toxic") == 1) & (F.col("quality") == 1)), ("quality", F.col("quality") == 0), ("language", F.col("lang") != "en")]
    return rows.select("doc_id", M.route(rules).alias("target"))


@query("""
WITH c AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'Supported' ELSE 'Unfounded' END AS label, CASE WHEN source = 'src3' THEN 'Axiom_set' ELSE source END AS source FROM documents),
t AS (
  SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'discarded' WHEN toxic = 1 THEN 'review' ELSE 'verified' END AS status,
    CASE doc_id % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Unfounded' WHEN 2 THEN 'General' END AS label, toxic = 1 AND doc_id % 2 = 0 AS valid FROM labels
), j AS (
  SELECT c.id, c.label, c.source, t.status, t.label AS tl, t.valid, CASE WHEN c.id % 7 = 0 THEN 'Supported' END AS h, CASE WHEN c.id % 5 = 0 THEN 'Unfounded' END AS a FROM c LEFT JOIN t USING (id)
), v AS (
  SELECT *, NOT coalesce(status = 'discarded' OR (contains(lower(source), 'axiom') AND coalesce(tl, '') <> 'General') OR (label = 'Supported' AND tl = 'Unfounded'), false)
    AND coalesce(status = 'verified' OR valid, false) AS ok FROM j
)
SELECT id, coalesce(h, a, CASE WHEN ok THEN coalesce(tl, label) END) AS verdict, CASE WHEN h IS NOT NULL THEN 'human' WHEN a IS NOT NULL THEN 'ai' ELSE 'teacher' END AS audit_source
FROM v WHERE h IS NOT NULL OR a IS NOT NULL OR ok
""")
def waterfall_verdict(t) -> DataFrame:
    """People's decisions before the proxy's before the teacher's."""
    docs = t("documents")
    candidates = docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "Supported").otherwise("Unfounded").alias("label"), F.when(F.col("source") == "src3", "Axiom_set").otherwise(F.col("source")).alias("source")
    )
    human = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"), F.lit("Supported").alias("label"))
    ai = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("Unfounded").alias("label"))
    kind = F.col("doc_id") % 4
    teacher = t("labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 0, "discarded").when(F.col("toxic") == 1, "review").otherwise("verified").alias("status"),
        F.when(kind == 0, "Supported").when(kind == 1, "Unfounded").when(kind == 2, "General").alias("label"),
        ((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0)).alias("valid_sabotage"),
    )
    return M.waterfall(candidates, human, ai, teacher)


FAMILIES = """
  SELECT conv_id AS family, CASE WHEN bool_or(role = 'system') THEN 'axiom' WHEN bool_or(length(text) < 200 AND role <> 'system') AND bool_or(length(text) >= 200 AND role <> 'system') THEN 'sabotage_pair'
    WHEN bool_or(length(text) < 200) THEN 'natural_fail' ELSE 'natural_supp' END AS bucket FROM conversations GROUP BY conv_id
"""


def families(t) -> DataFrame:
    label = F.when(F.col("role") == "system", "General").when(F.length("text") < 200, "Unfounded").otherwise("Supported")
    return M.family_buckets(t("conversations").select(F.col("conv_id").alias("family"), label.alias("label"), (F.col("role") == "system").alias("axiom")))


@query(f"""
WITH f AS ({FAMILIES}), r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(family::VARCHAR), family) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM f
), p AS (SELECT *, CASE WHEN floor(n * 0.1) = 0 AND n >= 3 THEN 1 ELSE floor(n * 0.1) END AS part FROM r)
SELECT family, bucket, CASE WHEN k <= part THEN 'test' WHEN k <= 2 * part THEN 'val' ELSE 'train' END AS split FROM p
""")
def family_split(t) -> DataFrame:
    """Families to test, val and train within their buckets, so no family is divided."""
    return M.split_families(families(t))


@query(f"""
WITH f AS ({FAMILIES}), m AS (
  SELECT c.conv_id, c.turn, bucket, CASE WHEN length(text) < 200 THEN 'child' ELSE 'parent' END AS role, length(text) AS n FROM conversations c JOIN f ON c.conv_id = f.family WHERE c.role <> 'system'
), p AS (SELECT conv_id, bool_or(n >= 512) AS long FROM m GROUP BY conv_id)
SELECT conv_id, CASE bucket WHEN 'sabotage_pair' THEN CASE WHEN long THEN 'pairs_long' ELSE 'pairs_short' END WHEN 'natural_fail' THEN 'natural_fake' WHEN 'axiom' THEN 'axiom' ELSE 'natural_true' END AS pool,
  count(*) AS members FROM m JOIN p USING (conv_id) GROUP BY conv_id, bucket, long
""")
def family_routing(t) -> DataFrame:
    """Each family's pool; pairs by the parent's length."""
    turns = t("conversations").where("role <> 'system'").select("conv_id", F.length("text").alias("n"))
    sized = turns.groupBy("conv_id").agg(F.bool_or(F.col("n") >= 512).alias("long"), F.count("*").alias("members"))
    joined = sized.join(families(t), F.col("conv_id") == F.col("family"))
    pair = F.when(F.col("long"), "pairs_long").otherwise("pairs_short")
    pool = F.when(F.col("bucket") == "sabotage_pair", pair).when(F.col("bucket") == "natural_fail", "natural_fake").when(F.col("bucket") == "axiom", "axiom").otherwise("natural_true")
    return joined.select("conv_id", pool.alias("pool"), "members")


@query("""
WITH g AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM labels WHERE toxic = 1),
q AS (SELECT (SELECT count(*) FROM labels) AS quota)
SELECT id, unnest(range(0, (quota // n + CASE WHEN k <= quota % n THEN 1 ELSE 0 END)::BIGINT))::INT AS copy FROM g, q
""")
def quota_balance(t) -> DataFrame:
    """A small pool repeated to the size of the whole, earlier ids once more."""
    return M.replicate(t("labels").where("toxic = 1").select(F.col("doc_id").alias("id")), t("labels").count())


@query("""
SELECT user_id % 10 AS segment, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1
""")
def status_pivot(t) -> DataFrame:
    """Segments by status, zero where there is none."""
    kinds = ["click", "view", "purchase", "error"]
    return t("events").groupBy((F.col("user_id") % 10).alias("segment")).pivot("event_type", kinds).count().fillna(0, kinds)


@query("""
SELECT rule, count(*) FILTER (bad) AS n, count(*) AS checked FROM (
  SELECT unnest(['empty_text', 'missing_source', 'short', 'length_mismatch']) AS rule, unnest([text IS NULL OR text = '', source IS NULL, length(text) < 20, length(text) <> n_chars]) AS bad FROM documents
) GROUP BY rule
""")
def validation_rules(t) -> DataFrame:
    """How many documents break each rule, in one pass."""
    bad = {
        "empty_text": F.coalesce(F.col("text"), F.lit("")) == "", "missing_source": F.col("source").isNull(), "short": F.length("text") < 20, "length_mismatch": F.length("text") != F.col("n_chars"),
    }
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("bad")) for k, v in bad.items()))).alias("r")
    return t("documents").select(rules).groupBy("r.rule").agg(F.count_if("r.bad").alias("n"), F.count("*").alias("checked"))


@query("""
WITH s AS (SELECT 'sabotaged_' || doc_id::VARCHAR || '_' || substr(md5(doc_id::VARCHAR), 1, 8) AS vid FROM labels WHERE quality = 0)
SELECT doc_id FROM documents WHERE doc_id::VARCHAR IN (SELECT regexp_extract(vid, '^sabotaged_(.*)_[^_]*$', 1) FROM s)
""")
def mutation_parents(t) -> DataFrame:
    """Documents that a mutated record's id names as its original: an equi-join on the derived id."""
    name = F.concat_ws("_", F.lit("sabotaged"), F.col("doc_id").cast("string"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    mutated = t("labels").where("quality = 0").select(M.family_id(name).alias("parent"))
    return t("documents").select("doc_id").join(mutated, F.col("doc_id").cast("string") == F.col("parent"), "left_semi")


@query(f"""
SELECT o_orderkey, 'total for ' || (year(o_orderdate) + CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::VARCHAR || ' and 1999' AS query FROM orders
""")
def time_warp(t) -> DataFrame:
    """The first year of a question moved by one."""
    asked = F.concat(F.lit("total for "), F.year("o_orderdate"), F.lit(" and 1999"))
    return t("orders").select("o_orderkey", M.time_warp(asked, F.col("o_orderkey")).alias("query"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR || ' billion in sales' WHEN 1 THEN p_size::VARCHAR || ' basis points' ELSE p_size::VARCHAR || ' units million' END AS answer FROM part
""")
def scale_drift(t) -> DataFrame:
    """The scale word of an answer exchanged, or added."""
    kind = F.col("p_size") % 3
    tail = F.when(kind == 0, " million in sales").when(kind == 1, " Percent").otherwise(" units")
    return t("part").select("p_partkey", M.scale_drift(F.concat(F.col("p_size").cast("string"), tail)).alias("answer"))


@query("""
WITH h AS (SELECT doc_id AS id, source, md5(doc_id::VARCHAR) AS h FROM documents),
l AS (SELECT id, source, lead(id) OVER w AS distractor, lead(source) OVER w AS other FROM h WINDOW w AS (PARTITION BY substr(h, 1, 2) ORDER BY h, id))
SELECT id, distractor FROM l WHERE distractor IS NOT NULL AND other <> source
""")
def distractor_pick(t) -> DataFrame:
    """A record of another source for each record, fixed by hashes."""
    return M.distractors(t("documents").select(F.col("doc_id").alias("id"), "source"))


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'click' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.value > 60 AND d.user_id = events.user_id)")
def resume_antijoin(t) -> DataFrame:
    """Work that isn't in the log of finished keys."""
    done = t("events").where("event_type = 'error' AND value > 60").select("user_id").distinct()
    return unprocessed(t("events").where("event_type <> 'click'").select("event_id", "user_id"), done, "user_id")


@query(f"""
WITH m AS (SELECT doc_id, {sql_digest("s", "doc_id")} % 4 AS kind FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM m)
SELECT doc_id, kind FROM r WHERE k <= 12 + (kind < 2)::INT
""")
def stratified_subsample(t) -> DataFrame:
    """Fifty rows over four types: 13, 13, 12 and 12, in hash order."""
    from factledger.operators.ledger import top_of

    kind: Column = digest("s", F.col("doc_id")) % 4
    rows = t("labels").select("doc_id", kind.alias("kind"))
    first = top_of(rows, ["kind"], 13, F.md5(F.col("doc_id").cast("string")), "doc_id").withColumn("h", F.md5(F.col("doc_id").cast("string")))
    second = top_of(first.where("kind >= 2"), ["kind"], 12, "h", "doc_id")
    return first.where("kind < 2").unionByName(second).select("doc_id", "kind")


QUERIES, ORACLES = registry.queries, registry.oracles
