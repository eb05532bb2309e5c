"""Traces, tables in markdown, and what reviewers see, over rows that Spark builds from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import traces
from factledger.operators import review as V
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


def pick(key, *choices):
    """The choice by ``key`` modulo their number."""
    out = F.lit(None).cast("string")
    for k, choice in enumerate(choices):
        out = F.when(F.pmod(key, F.lit(len(choices))) == k, choice).otherwise(out)
    return out


@query(r"""
SELECT p_partkey, replace(CASE p_partkey % 5
  WHEN 0 THEN 'step_0 = ' || p_size::VARCHAR || ' - 0.1|step_1 = step_0 / 100|print(step_1)'
  WHEN 1 THEN 'step_0 = mean([table_value(' || p_name || '), table_value(none)])|print(step_0)'
  WHEN 2 THEN 'step_0 = 2 ** -' || p_size::VARCHAR || '|step_1 = size(7, 0)|print(step_1)'
  ELSE '# NO_TRACE_AVAILABLE' END, '|', chr(10)) AS trace FROM part
""")
def program_traces(t) -> DataFrame:
    """Programs of calls written as traces."""
    n = F.col("p_size").cast("string")
    program = pick(
        F.col("p_partkey"), F.concat(F.lit("subtract("), n, F.lit(", 10%), divide(#0, const_1000)")), F.concat(F.lit("table_average("), "p_name", F.lit(", none)")),
        F.concat(F.lit("exp(const_2, ("), n, F.lit("))|size($7)")), F.lit("no calls here"), F.lit(None),
    )
    return t("part").select("p_partkey", traces.program_trace(program).alias("trace"))


@query(r"""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '# NO_DERIVATION' ELSE 'result = ( ' || (p_size * 1000 + 204)::VARCHAR || '.5 - ' || (p_retailprice / 100)::DOUBLE::VARCHAR || ' ) / ' || p_partkey::VARCHAR || ' * ' || lower(p_name) || chr(10) || 'print(result)' END AS trace FROM part
""")
def derivation_traces(t) -> DataFrame:
    """Derivations written as traces: separators and signs of currency go, percents are shares, words stay."""
    shown = F.concat(F.lit(" ( "), F.col("p_size").cast("string"), F.lit(",204.5-"), F.col("p_retailprice").cast("string"), F.lit("%)/ $"), F.col("p_partkey").cast("string"), F.lit("*"), F.lower("p_name"), F.lit(" "))
    return t("part").select("p_partkey", traces.derivation_trace(F.when(F.col("p_type") != "PROMO", shown).otherwise("")).alias("trace"))


@query(r"""
SELECT l_orderkey, '| line | flags |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || l_linenumber::VARCHAR || ' | ' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || ' ' || l_linestatus END || ' |' || chr(10), '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS md
FROM lineitem GROUP BY l_orderkey
""")
def markdown_tables(t) -> DataFrame:
    """The lines of an order (a few) as a table in markdown: short rows are filled up, long ones cut, line ends in cells go."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus")))
    rows = t("lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    number = lambda r: r["l_linenumber"].cast("string")
    cells = F.transform("lines", lambda r: F.when(r["l_returnflag"] == "N", F.array(number(r))).otherwise(F.array(number(r), F.concat_ws("\n", r["l_returnflag"], r["l_linestatus"]), F.lit("cut"))))
    return rows.select("l_orderkey", traces.markdown(F.concat(F.array(F.array(F.lit(" line"), F.lit("flags"))), cells)).alias("md"))


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'Swapped ' ELSE '' END || replace(replace(left(text, 80), 'e ', ' with '), 'n ', ' -> ') AS diff FROM documents),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(diff, '(?s)^(?:.*with)?(.*)$', 1), '^\s+|\s+$', '', 'g'), '\.+$', '') AS w, regexp_replace(regexp_replace(regexp_extract(diff, '(?s)^(?:.*->)?(.*)$', 1), '^\s+|\s+$', '', 'g'), '\.+$', '') AS a,
  regexp_extract(diff, '->\s*([^ ]+)', 1) AS f FROM d)
SELECT doc_id, CASE WHEN contains(diff, 'Swapped') AND contains(diff, 'with') THEN w WHEN f <> '' THEN regexp_replace(regexp_replace(f, '^\s+|\s+$', '', 'g'), '\.+$', '') ELSE a END AS injected,
  CASE WHEN coalesce(diff, '') = '' THEN 'N/A' WHEN contains(diff, 'with') THEN w WHEN contains(diff, '->') THEN a ELSE diff END AS lie FROM p
""")
def injected_values(t) -> DataFrame:
    """What an attack put in, as audits and as exports read it from the attack's own words (here: the first letters of texts)."""
    words = F.replace(F.replace(F.expr("left(text, 80)"), F.lit("e "), F.lit(" with ")), F.lit("n "), F.lit(" -> "))
    diff = F.concat(F.when(F.length("text") % 2 == 0, "Swapped ").otherwise(""), words)
    return t("documents").select("doc_id", V.injected_value(diff).alias("injected"), V.intended_lie(diff).alias("lie"))


@query(r"""
WITH p AS (SELECT conv_id, turn, role, text, contains(text, ', ') AS tags, contains(text, 'en') AS system FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, role, CASE WHEN tags AND system THEN regexp_replace(role || ' of ' || left(text, 30), '^\s+|\s+$', '', 'g') ELSE 'You are a rigorous financial auditor.' END AS system, CASE WHEN tags THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE text END || chr(10) || 'Label:' AS "user" FROM p
""")
def prompt_turns(t) -> DataFrame:
    """Prompts in turn tags taken apart, with or without a system turn, or without tags; the texts are those of conversations."""
    system = F.when(F.contains("text", F.lit("en")), F.concat(F.lit("<|im_start|>system\n "), "role", F.lit(" of "), F.expr("left(text, 30)"), F.lit(" <|im_end|>\n"))).otherwise("")
    tagged = F.concat(system, F.lit("<|im_start|>user\n"), "text", F.lit("\n<|im_end|>\n<|im_start|>assistant\n"))
    prompt = F.when(F.contains("text", F.lit(", ")), tagged).otherwise(F.col("text"))
    return t("conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", V.prompt_parts(prompt).alias("p")).select("conv_id", "turn", "role", "p.system", "p.user")


@query(r"""
WITH r AS (SELECT conv_id, turn, replace(replace(replace(replace(text, '. ', '** Label: '), ' la ', ' <think>'), ' the ', ' </think>'), 'ou', 'Fake') AS raw FROM conversations),
c AS (SELECT *, regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g') AS clean FROM r),
q AS (SELECT *, contains(clean, '<think>') AND NOT contains(clean, '</think>') AS cut_off, replace(clean, '*', '') AS plain FROM c),
u AS (SELECT *, regexp_extract(plain, '(?s)^(.*?)(?i:found|supported|fake|unfounded|general)', 0) AS upto FROM q),
n AS (SELECT *, len(regexp_extract_all(upto, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n_upto, len(regexp_extract_all(plain, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n_plain, len(regexp_extract_all(raw, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n_raw FROM u)
SELECT conv_id, turn, CASE WHEN coalesce(raw, '') = '' OR cut_off THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(plain, '^\s+|\s+$', '', 'g'), '(?i)^label\s*:?\s*', ''), '^\s+|\s+$', '', 'g') END AS text,
  CASE WHEN coalesce(raw, '') = '' THEN 0 WHEN cut_off THEN n_raw WHEN upto <> '' THEN n_upto - 1 ELSE n_plain END::INT AS extra FROM n
""")
def verdict_preambles(t) -> DataFrame:
    """Answers down to their verdicts, and the tokens before them; words of the texts stand for tags, labels and verdicts."""
    raw = F.col("text")
    for old, new in ((". ", "** Label: "), (" la ", " <think>"), (" the ", " </think>"), ("ou", "Fake")):
        raw = F.replace(raw, F.lit(old), F.lit(new))
    return t("conversations").select("conv_id", "turn", V.before_verdict(raw).alias("v")).select("conv_id", "turn", "v.text", "v.extra")


@query(rf"""
WITH s AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN string_split(text, chr(10)) END AS steps FROM documents),
p AS (SELECT doc_id, CASE WHEN len(steps) > 1 THEN array_to_string(steps[1:len(steps) - 1], ' ') WHEN len(steps) = 1 THEN '{V.COMPARE}' ELSE '{V.ANALYSE}' END AS thinking, coalesce(steps[len(steps)], '') AS analysis FROM s)
SELECT doc_id, md5(thinking || CASE WHEN ends_with(thinking, '.') THEN '' ELSE '.' END) AS thinking, md5(analysis || CASE WHEN ends_with(analysis, '.') THEN '' ELSE '.' END) AS analysis FROM p
""")
def reasoning_steps(t) -> DataFrame:
    """Steps of reasoning (here: lines of texts) split into thinking and analysis."""
    steps = F.when(F.col("lang") != "es", F.split("text", "\n"))
    return t("documents").select("doc_id", V.reasoning_parts(steps).alias("r")).select("doc_id", F.md5("r.thinking").alias("thinking"), F.md5("r.analysis").alias("analysis"))


def candidates(t) -> DataFrame:
    k = F.col("doc_id") % 6
    rows = t("documents").select(
        F.col("doc_id").alias("id"), F.when(k == 5, "truthfulqa_axioms").otherwise(F.col("source")).alias("dataset_source"), F.when(k < 3, "Unfounded").when(k < 5, "Supported").otherwise("General").alias("label"),
        F.col("lang").alias("target_sentence"), F.lit(None).cast("string").alias("query"), F.array("lang").alias("context_chunks"), F.when(k == 0, "print(1)").alias("trace_code"),
        F.when(k < 2, "scale").alias("attack"), F.when(k < 2, F.concat(F.lit("1 -> "), F.col("doc_id").cast("string"))).alias("diff"),
    )
    return V.nested(rows)


def audits(t) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return t("labels").select(
        F.col("doc_id").alias("id"), F.when(bad, "review").when(F.col("doc_id") % 7 == 1, "discarded").otherwise("verified").alias("status"), (F.col("quality") == 1).alias("valid"),
        F.when(F.col("toxic") == 1, "toxic").alias("audit_target_group"), F.when(F.col("quality") == 1, "Supported").alias("teacher_label"),
    )


SQL_RECORDS = """
c AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 5 THEN 'truthfulqa_axioms' ELSE coalesce(source, 'unknown') END AS dataset_source, CASE WHEN doc_id % 6 < 3 THEN 'Unfounded' WHEN doc_id % 6 < 5 THEN 'Supported' ELSE 'General' END AS label,
  lang AS target_sentence, CASE WHEN doc_id % 6 = 0 THEN 'print(1)' ELSE '' END AS trace_code, doc_id % 6 < 2 AS attacked FROM documents),
a AS (SELECT doc_id AS id, CASE WHEN quality = 0 OR toxic = 1 THEN 'review' WHEN doc_id % 7 = 1 THEN 'discarded' ELSE 'verified' END AS status, quality = 1 AS valid,
  CASE WHEN toxic = 1 THEN 'toxic' ELSE 'N/A' END AS grp, CASE WHEN quality = 1 THEN 'Supported' ELSE 'N/A' END AS verdict FROM labels)
"""


@query(f"""
WITH {SQL_RECORDS} SELECT id, dataset_source AS source_dataset, status AS audit_status, grp AS audit_target, CASE WHEN attacked THEN 'scale' ELSE 'none' END AS attack_type,
  CASE WHEN attacked THEN id::VARCHAR ELSE 'N/A' END AS intended_lie, verdict AS teacher_verdict, coalesce(target_sentence, '') AS target_sentence, trace_code AS logic_trace FROM a JOIN c USING (id) WHERE status = 'review'
""")
def review_exports(t) -> DataFrame:
    """Audited records under review, flat."""
    return V.review_export(candidates(t), audits(t))


@query(f"""
WITH {SQL_RECORDS} SELECT id, '' AS user_query, target_sentence, trace_code, CASE WHEN attacked THEN 'scale' END AS "sabotage_info.type", CASE WHEN attacked THEN '1 -> ' || id::VARCHAR END AS "sabotage_info.diff",
  label AS original_label, coalesce(grp, 'N/A') AS audit_target_group, coalesce(verdict, 'N/A') AS teacher_label FROM c JOIN a USING (id) WHERE status = 'review'
""")
def audit_payload_rows(t) -> DataFrame:
    """What an auditor gets for all records under review, flat."""
    return V.flat(V.audit_payloads(audits(t).where(F.col("status") == "review"), candidates(t), audits(t)))


@query(f"""
WITH {SQL_RECORDS}, s AS (
  SELECT dataset_source, CASE WHEN dataset_source = 'truthfulqa_axioms' THEN 'Skipped' WHEN id % 7 = 0 THEN 'Human Ver' WHEN id % 11 = 0 THEN 'AI Ver' WHEN status = 'verified' THEN 'Auto Ver' WHEN status = 'discarded' THEN 'Discard' ELSE 'Pending' END AS final_status,
    CASE WHEN label = 'General' THEN 'General Axioms' WHEN label = 'Supported' THEN 'Supported' WHEN NOT attacked THEN 'Natural Unfounded' WHEN valid THEN 'Validated Sabotage' WHEN a.id IS NOT NULL THEN 'Rejected Sabotage' ELSE 'Pending Sabotage' END AS "class"
  FROM c LEFT JOIN a USING (id)
) SELECT dataset_source, final_status, "class", count(*) AS n FROM s GROUP BY ALL
""")
def audit_progress(t) -> DataFrame:
    """Records counted by source, final status and class."""
    ids = lambda n: t("documents").where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"))
    return V.progress(candidates(t), audits(t), ids(7), ids(11)).groupBy("dataset_source", "final_status", "class").agg(F.count("*").alias("n"))


@query("""
SELECT avg(len(role)) AS role_tokens, avg(turn) AS tokens_before FROM conversations
""")
def average_tokens(t) -> DataFrame:
    """The means of all columns that count tokens."""
    return V.token_averages(t("conversations").select("conv_id", F.length("role").alias("role_tokens"), F.col("turn").alias("tokens_before")))


QUERIES, ORACLES = registry.queries, registry.oracles
