"""Scores, failure classes and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.operators import evaluation as S
from factledger.plans.common import Registry, digest, sql_digest
from factledger.streaming import events as stream

registry = Registry()
query = registry.query

KINDS = ("logic", "numeric", "irrelevancy", "semantic")
PAIRS = f"""
  SELECT conv_id AS family, max(CASE WHEN role = 'user' THEN {sql_digest("p", "conv_id * 1000 + turn")} % 3 END) AS parent_pred, max(CASE WHEN role = 'assistant' THEN {sql_digest("p", "conv_id * 1000 + turn")} % 3 END) AS child_pred,
    max(CASE WHEN role = 'assistant' THEN (['logic', 'numeric', 'irrelevancy', 'semantic'])[(conv_id % 4 + 1)::INT] END) AS kind, max(CASE WHEN role = 'user' THEN CASE WHEN length(text) >= 128 THEN 'long' ELSE 'short' END END) AS pool
  FROM conversations GROUP BY conv_id HAVING parent_pred IS NOT NULL AND child_pred IS NOT NULL
"""


def judged_pairs(t) -> DataFrame:
    role = F.when(F.col("role") == "user", "parent").when(F.col("role") == "assistant", "child")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("conv_id") % 4 + 1).cast("int"))
    pool = F.when(F.length("text") >= 128, "long").otherwise("short")
    pred = digest("p", F.col("conv_id") * 1000 + F.col("turn")) % 3
    return S.pairs(t("conversations").select(F.col("conv_id").alias("family"), role.alias("role"), kind.alias("kind"), pool.alias("pool"), pred.alias("pred")))


@query(f"SELECT pool, count(*) AS n, round(avg((parent_pred = 0 AND child_pred = 1)::INT), 6) AS flip_rate FROM ({PAIRS}) GROUP BY pool")
def flip_rate(t) -> DataFrame:
    """Pairs of which both members are judged right, by the parent's length."""
    return judged_pairs(t).groupBy("pool").agg(F.count("*").alias("n"), F.round(F.avg(S.flipped()), 6).alias("flip_rate"))


@query(f"""
SELECT k.kind, count(p.family) AS n, round(coalesce(avg((parent_pred = 0 AND child_pred = 1)::INT), 0), 6) AS flip_rate
FROM (SELECT unnest(['logic', 'numeric', 'irrelevancy', 'semantic', 'unit']) AS kind) k LEFT JOIN ({PAIRS}) p USING (kind) GROUP BY k.kind
""")
def flip_by_type(t) -> DataFrame:
    """The same by mutation type; types without a pair count 0."""
    pairs = judged_pairs(t)
    kinds = pairs.sparkSession.createDataFrame([(k,) for k in (*KINDS, "unit")], "kind string")
    return kinds.join(pairs, "kind", "left").groupBy("kind").agg(F.count("family").alias("n"), F.round(F.coalesce(F.avg(S.flipped()), F.lit(0.0)), 6).alias("flip_rate"))


@query(f"""
WITH r AS (SELECT quality, toxic, {sql_digest("c", "doc_id")} % 3 AS pred FROM labels),
a AS (
  SELECT count(*) FILTER (quality = 0)::DOUBLE AS n_fake, count(*) FILTER (quality = 0 AND pred = 1)::DOUBLE AS fake, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS n_true,
    count(*) FILTER (quality = 1 AND toxic = 0 AND pred = 0)::DOUBLE AS true_ok, count(*) FILTER (toxic = 1)::DOUBLE AS n_ax, count(*) FILTER (toxic = 1 AND pred = 2)::DOUBLE AS ax FROM r
)
SELECT round(fake / n_fake, 6) AS recall, round(true_ok / n_true, 6) AS tpr, round(ax / n_ax, 6) AS axiom_accuracy,
  round(sqrt((1e-6 + fake) / (1e-6 + 1 + n_fake)) * sqrt((1e-6 + true_ok) / (1e-6 + 1 + n_true)) * sqrt((1e-6 + ax) / (1e-6 + 1 + n_ax)), 6) AS composite FROM a
""")
def composite_score(t) -> DataFrame:
    """Rates by pool and the product of the roots of their posterior means."""
    rows = t("labels").withColumn("pred", digest("c", F.col("doc_id")) % 3)
    count = lambda c: F.count_if(c).cast("double")
    fake, true, axiom = F.col("quality") == 0, (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1
    sums = rows.agg(
        count(fake).alias("n_fake"), count(fake & (F.col("pred") == 1)).alias("fake"), count(true).alias("n_true"), count(true & (F.col("pred") == 0)).alias("true_ok"),
        count(axiom).alias("n_ax"), count(axiom & (F.col("pred") == 2)).alias("ax"),
    )
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    score = S.composite([(F.col("fake"), F.col("n_fake")), (F.col("true_ok"), F.col("n_true")), (F.col("ax"), F.col("n_ax"))])
    return sums.select(rate("fake", "n_fake").alias("recall"), rate("true_ok", "n_true").alias("tpr"), rate("ax", "n_ax").alias("axiom_accuracy"), F.round(score, 6).alias("composite"))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1, count(*) FILTER (toxic = 2) AS pred_2 FROM labels GROUP BY quality")
def confusion_matrix(t) -> DataFrame:
    """Truth by prediction, with classes that never occur."""
    counted = t("labels").groupBy("quality").pivot("toxic", [0, 1, 2]).count().fillna(0)
    return counted.select("quality", *(F.col(str(k)).alias(f"pred_{k}") for k in range(3)))


@query(f"SELECT toxic AS stratum, count(*) AS n, round(avg(abs({sql_digest('e', 'doc_id')} / 65535.0::DOUBLE - quality)), 6) AS error FROM labels GROUP BY toxic")
def calibration_error(t) -> DataFrame:
    """Mean distance of confidence and correctness."""
    confidence = digest("e", F.col("doc_id")) / F.lit(65535.0)
    return t("labels").groupBy(F.col("toxic").alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(confidence - F.col("quality"))), 6).alias("error"))


@query("""
SELECT lang, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95, min(n_chars) AS min, max(n_chars) AS max, count(n_chars) AS n
FROM documents GROUP BY lang
""")
def token_percentiles(t) -> DataFrame:
    return S.percentiles(t("documents"), "lang", "n_chars").withColumn("p95", F.round("p95", 6))


def failures(t) -> DataFrame:
    bit = lambda k: (digest(f"f{k}", F.col("event_id")) % 4 == 0)
    names = ("correct", "failed", "ambiguous", "gap", "code_ok", "refusal", "gold_in_context", "bleed")
    flags = {n: bit(n) for n in names} | {"retrieved": ~bit("retrieved"), "numeric": F.col("event_id") % 2 == 0}
    return t("events").select("event_id", F.concat(F.lit("run_"), F.col("user_id") % 4 + 1).alias("run"), S.taxonomy(flags).alias("failure"))


def _bit(k: str) -> str:
    return f"{sql_digest('f' + k, 'event_id')} % 4 = 0"


FAILURES = f"""
  SELECT event_id, 'run_' || (user_id % 4 + 1)::VARCHAR AS run, CASE WHEN {_bit("correct")} THEN 'NONE' WHEN {_bit("failed")} THEN 'TYPE_7_GENERATION_FAILURE' WHEN {_bit("ambiguous")} THEN 'TYPE_6_GOLD_AMBIGUITY'
    WHEN {_bit("gap")} THEN 'TYPE_5_COVERAGE_GAP' WHEN {_bit("retrieved")} THEN 'TYPE_1_RETRIEVAL_BLINDNESS' WHEN event_id % 2 <> 0 AND {_bit("code_ok")} THEN 'TYPE_4_MODALITY_MISMATCH'
    WHEN {_bit("refusal")} THEN 'TYPE_1_RETRIEVAL_BLINDNESS' WHEN event_id % 2 = 0 AND {_bit("gold_in_context")} THEN 'TYPE_3_ARITHMETIC_HALLUCINATION'
    WHEN event_id % 2 = 0 AND {_bit("bleed")} AND NOT {_bit("code_ok")} THEN 'TYPE_0_UFL_BLEED' ELSE 'TYPE_2_GENERATIVE_CONFLATION' END AS failure FROM events
"""


@query(FAILURES)
def failure_taxonomy(t) -> DataFrame:
    """Each answer's failure class."""
    return failures(t)


@query(f"SELECT run, failure, count(*) AS n FROM ({FAILURES}) GROUP BY ALL")
def failure_by_run(t) -> DataFrame:
    return failures(t).groupBy("run", "failure").agg(F.count("*").alias("n"))


@query("""
WITH r AS (
  SELECT user_id, bool_or(value > 20) FILTER (event_type = 'click') AS r1, bool_or(value > 20) FILTER (event_type = 'view') AS r2, bool_or(value > 40) FILTER (event_type = 'purchase') AS r3, bool_or(value > 40) FILTER (event_type = 'error') AS r4
  FROM events GROUP BY user_id
)
SELECT CASE WHEN r1 AND r2 AND r3 AND r4 THEN 'ALL_WIN' WHEN NOT (r1 OR r2 OR r3 OR r4) THEN 'ALL_FAIL' WHEN r4 AND NOT (r1 OR r2 OR r3) THEN 'ONLY_4_WINS' WHEN NOT r1 AND (r2 OR r3 OR r4) THEN 'BASELINE_FAILS' ELSE 'OTHER' END AS survivors,
  count(*) AS n, count(DISTINCT user_id) AS users FROM r WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL GROUP BY 1
""")
def survivor_groups(t) -> DataFrame:
    """Questions by which of four runs solve them; those with a missing run are left out."""
    won = lambda kind, limit: F.bool_or(F.when(F.col("event_type") == kind, F.col("value") > limit))
    runs = t("events").groupBy("user_id").agg(won("click", 20).alias("r1"), won("view", 20).alias("r2"), won("purchase", 40).alias("r3"), won("error", 40).alias("r4"))
    full = runs.where("r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL")
    return full.groupBy(S.survivor_class([F.col(f"r{k}") for k in range(1, 5)]).alias("survivors")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
WITH r AS (
  SELECT user_id, bool_or(value > 20) FILTER (event_type = 'click') AS r1, bool_or(value > 20) FILTER (event_type = 'view') AS r2, bool_or(value > 40) FILTER (event_type = 'purchase') AS r3, bool_or(value > 40) FILTER (event_type = 'error') AS r4
  FROM events GROUP BY user_id
), c AS (
  SELECT user_id, CASE WHEN r1 AND r2 AND r3 AND r4 THEN 'ALL_WIN' WHEN NOT (r1 OR r2 OR r3 OR r4) THEN 'ALL_FAIL' WHEN r4 AND NOT (r1 OR r2 OR r3) THEN 'ONLY_4_WINS' WHEN NOT r1 AND (r2 OR r3 OR r4) THEN 'BASELINE_FAILS' ELSE 'OTHER' END AS survivors
  FROM r WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL
)
SELECT survivors, count(*) AS n, array_to_string((list(user_id ORDER BY user_id))[1:20], ',') AS ids FROM c GROUP BY survivors
""")
def survivor_ids(t) -> DataFrame:
    """The first twenty questions of each survivor group."""
    won = lambda kind, limit: F.bool_or(F.when(F.col("event_type") == kind, F.col("value") > limit))
    runs = t("events").groupBy("user_id").agg(won("click", 20).alias("r1"), won("view", 20).alias("r2"), won("purchase", 40).alias("r3"), won("error", 40).alias("r4"))
    full = runs.where("r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL AND r4 IS NOT NULL")
    classed = full.select("user_id", S.survivor_class([F.col(f"r{k}") for k in range(1, 5)]).alias("survivors"))
    return S.first_ids(classed, "survivors", "user_id").select("survivors", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""
WITH r AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'pair_short' WHEN event_type = 'view' THEN 'pair_long' ELSE 'axiom' END AS pool, CASE WHEN value < 30 THEN value > 10 END AS subsample, value > 15 AS hit FROM events)
SELECT pool, count(*) AS n, count(*) FILTER (hit) AS hits FROM r WHERE coalesce(subsample, false) AND pool IN ('pair_short', 'pair_long') GROUP BY pool
""")
def subsampled_pairs(t) -> DataFrame:
    """Hits among the rows of pair pools that were drawn for a subsample."""
    pool = F.when(F.col("event_type") == "click", "pair_short").when(F.col("event_type") == "view", "pair_long").otherwise("axiom")
    rows = t("events").select(pool.alias("pool"), F.when(F.col("value") < 30, F.col("value") > 10).alias("subsample"), (F.col("value") > 15).alias("hit"))
    return S.pairs_only(rows, ("pair_short", "pair_long")).groupBy("pool").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT count(*) AS n, round(avg((toxic = 1)::INT), 6) AS rescue_rate FROM labels WHERE (quality = 1) <> (toxic = 1)")
def rescue_rate(t) -> DataFrame:
    """Of the rows on which two systems differ, the share that the second has right."""
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return t("labels").where(a != b).agg(F.count("*").alias("n"), F.round(F.avg(b.cast("double")), 6).alias("rescue_rate"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN abs(total) <= 0.015 ELSE abs(o_totalprice - total) <= 0.005 * abs(o_totalprice) END AS is_match FROM orders JOIN s ON o_orderkey = l_orderkey
""")
def exact_match_numeric(t) -> DataFrame:
    """Answers within half a percent of the gold value."""
    sums = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return t("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", numeric.close(F.col("o_totalprice"), F.col("total")).alias("is_match"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(q, lambda x: len(list_filter(q, lambda y: len(list_filter(q, lambda z: x + y = z)) > 0)) > 0)) > 0 AS derivable FROM l
""")
def derivable(t) -> DataFrame:
    """Whether one of an order's numbers is the sum of two."""
    q = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    some = F.exists("q", lambda x: F.exists("q", lambda y: F.array_contains(F.col("q"), x + y)))
    return q.select("l_orderkey", some.alias("derivable"))


@query("""
SELECT p_brand, bool_and(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)) AS covered, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)) AS gaps FROM part GROUP BY p_brand
""")
def golden_subset(t) -> DataFrame:
    """Whether all golden ids were retrieved, and how many were not."""
    got = t("lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("got")).distinct()
    found = t("part").join(got, "p_partkey", "left").withColumn("got", F.coalesce("got", F.lit(False)))
    return found.groupBy("p_brand").agg(F.bool_and("got").alias("covered"), F.count_if(~F.col("got")).alias("gaps"))


@query(r"""
SELECT source, count(*) FILTER (regexp_matches(text, '(?i)\blicense\b') AND NOT regexp_matches(text, '(?i)\bcopyright\b')) AS bleeding, count(*) FILTER (regexp_matches(text, '(?i)\blicense\b')) AS checked FROM documents GROUP BY source
""")
def bleed_terms(t) -> DataFrame:
    """Texts that have a term without the one that should go with it."""
    has, pair = text.has_word(F.col("text"), "license"), text.has_word(F.col("text"), "copyright")
    return t("documents").groupBy("source").agg(F.count_if(has & ~pair).alias("bleeding"), F.count_if(has).alias("checked"))


@query("""
WITH RECURSIVE d AS (SELECT event_type, ts::DATE::VARCHAR AS day, sum(value::DECIMAL(18,2))::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS k FROM events GROUP BY event_type, ts::DATE),
e AS (SELECT event_type, day, k, v AS ema FROM d WHERE k = 1 UNION ALL SELECT d.event_type, d.day, d.k, d.v * (2.0::DOUBLE / 13) + e.ema * (1 - 2.0::DOUBLE / 13) FROM e JOIN d ON d.event_type = e.event_type AND d.k = e.k + 1)
SELECT event_type, day, round(ema, 6) AS ema FROM e
""")
def ema_events(t) -> DataFrame:
    """Exponential moving average of daily values, span 12."""
    days = t("events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    return S.ema(days, "event_type", "day", "v", 12).withColumn("ema", F.round("ema", 6))


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY event_type")
def best_checkpoint(t) -> DataFrame:
    """The row with the best score of each series."""
    return t("events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL")
def events_tumbling(t) -> DataFrame:
    """Extension: hourly windows."""
    return stream.tumbling(t("events"))


@query("""
WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def events_session(t) -> DataFrame:
    """Extension: sessions with a gap of half an hour."""
    return stream.sessions(t("events"))


@query("""
WITH x AS (SELECT vec_id, unnest(range(1, 4)) AS i, embedding[1:3]::DOUBLE[] AS v FROM embeddings),
p AS (SELECT vec_id, i, exp(v[i] - list_max(v)) / (exp(v[1] - list_max(v)) + exp(v[2] - list_max(v)) + exp(v[3] - list_max(v))) AS p FROM x)
SELECT vec_id, arg_max(i, (round(p, 9), -i))::INT - 1 AS verdict, round(max(p), 6) AS confidence FROM p GROUP BY vec_id
""")
def logit_verdict(t) -> DataFrame:
    """Class and confidence from three logits."""
    p = numeric.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    rows = t("embeddings").select("vec_id", F.transform(p, lambda x: F.round(x, 9)).alias("p"), p.alias("q"))
    return rows.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("verdict"), F.round(F.array_max("q"), 6).alias("confidence"))


@query("""
SELECT l_returnflag, count(*) AS proposed, count(*) FILTER (l_linestatus = 'O') AS accepted, round((count(*) - count(*) FILTER (l_linestatus = 'O'))::DOUBLE / count(*), 4) AS rejection_rate FROM lineitem GROUP BY 1
""")
def purity(t) -> DataFrame:
    """Share of proposals that were rejected."""
    accepted = F.count_if(F.col("l_linestatus") == "O")
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("proposed"), accepted.alias("accepted"), F.round(F.try_divide(F.count("*") - accepted, F.count("*")), 4).alias("rejection_rate")
    )


@query("SELECT role, count(*) AS n, count(*) FILTER (contains(lower(text), 'not found') OR contains(lower(text), 'insufficient') OR contains(lower(text), 'no information')) AS refused FROM conversations GROUP BY role")
def refusal_counts(t) -> DataFrame:
    """Answers that decline, by role."""
    refused = text.contains_any(F.col("text"), ("not found", "insufficient", "no information"))
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(refused).alias("refused"))


QUERIES, ORACLES = registry.queries, registry.oracles
