"""Five question-answering corpora by their own rules, in one schema.

Every mapper gives id, dataset_source, label, query, context_chunks, trace_code, target_sentence and metadata (map of texts). Corpora without ids of their own get one from a
digest of the record, so a second run gives the same. Rows that lack what a corpus requires are left out, as each mapper says; texts that are empty count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import text, traces
from factledger.operators.lookups import first_category
from factledger.operators.review import prompt_sections

# fixed values: traces of answers that are not worked out
LOOKUP = "# VERIFICATION_TYPE: LOOKUP\n# The answer is explicitly stated in the text/table."
COUNTING = "# VERIFICATION_TYPE: COUNTING\n# result = len(matches)"
ANALYSIS = "# VERIFICATION_TYPE: TEXT_ANALYSIS"
# fixed values: companies in the order in which they are looked for, and what two of them are called
COMPANIES = (
    "3M", "CVS Health", "Oracle", "MGM Resorts", "Apple", "Johnson & Johnson",
    "Activision Blizzard", "NIKE", "American Water Works", "Pfizer", "Wal-Mart",
    "Corning", "Best Buy", "Verizon", "Home Depot", "Costco", "Target", "Intel",
    "Microsoft", "Amazon", "Alphabet", "Google", "Facebook", "Meta", "Tesla",
    "JPMorgan", "Bank of America", "Wells Fargo", "Citigroup", "Goldman Sachs",
    "Morgan Stanley", "Visa", "Mastercard", "PayPal", "Disney", "Netflix",
    "Comcast", "AT&T", "T-Mobile", "Sprint", "Verizon", "Chevron", "ExxonMobil",
    "ConocoPhillips", "Boeing", "Lockheed Martin", "General Dynamics", "Northrop Grumman",
    "Raytheon", "Caterpillar", "Deere", "General Electric", "Honeywell", "3M",
    "Procter & Gamble", "Unilever", "Colgate-Palmolive", "Kimberly-Clark",
    "Coca-Cola", "PepsiCo", "McDonald's", "Starbucks", "Yum! Brands", "Dominos",
    "Chipotle", "Nike", "Adidas", "Under Armour", "Lululemon", "VF Corporation",
    "Gap", "Levi Strauss", "Macy's", "Kohl's", "Nordstrom", "JCPenney", "Sears",
    "Kmart", "Walmart", "Target", "Costco", "Sam's Club", "BJ's Wholesale",
    "Walgreens", "Rite Aid", "CVS", "PGE", "PG&E",
)
CALLED = {"CVS": "CVS Health", "PGE": "PG&E"}
NOBODY = "Global_Entity"


def company_in(content: Column) -> Column:
    """The first known company that a text contains, in any case; nobody in particular for none."""
    names = F.array(*map(F.lit, dict.fromkeys(COMPANIES)))
    low = F.lower(F.coalesce(content, F.lit("")))
    found = F.get(F.filter(names, lambda n: F.contains(low, F.lower(n))), F.lit(0))
    called = F.coalesce(*(F.when(found == old, new) for old, new in CALLED.items()), found)
    return F.coalesce(called, F.lit(NOBODY))


def _record(rows: DataFrame, source: str, record: Column, label: Column, query: Column, chunks: Column, trace: Column, target: Column, **metadata: Column) -> DataFrame:
    known = F.create_map(*(x for name, value in metadata.items() for x in (F.lit(name), value.cast("string"))))
    return rows.select(
        record.alias("id"), F.lit(source).alias("dataset_source"), label.alias("label"), query.alias("query"), F.coalesce(chunks, F.array().cast("array<string>")).alias("context_chunks"), trace.alias("trace_code"),
        target.alias("target_sentence"), known.alias("metadata"),
    )


def digest(*fields: Column | str) -> Column:
    return F.substring(F.md5(F.to_json(F.struct(*fields))), 1, 8)


def programs(rows: DataFrame) -> DataFrame:
    """Questions with programs: id, pre_text, table, post_text, question, program, exe_ans. All rows stay; the table stands as markdown between the texts."""
    none = F.array().cast("array<string>")
    table = F.nullif(traces.markdown(F.coalesce("table", F.array().cast("array<array<string>>"))), F.lit(""))
    chunks = F.concat(F.coalesce("pre_text", none), F.array_compact(F.array(table)), F.coalesce("post_text", none))
    trace = traces.program_trace(F.coalesce("program", F.lit("")))
    answer = F.coalesce("exe_ans", F.lit(""))
    traced = ~F.contains(trace, F.lit("# TRACE_GENERATION_ERROR")) & ~F.contains(trace, F.lit(traces.NO_PROGRAM))
    values = F.to_json(F.regexp_extract_all(answer, F.lit(r"-?\d*\.?\d+"), F.lit(0)))
    name = F.concat(F.lit("finqa_"), F.coalesce("id", digest("question", "program")))
    return _record(rows, "finqa", name, F.lit("Supported"), F.coalesce("question", F.lit("")), chunks, trace, answer, original_values=values, sabotage_ready=F.lit(True), has_logic_trace=traced, raw_program=F.col("program"))


def tables_and_texts(pages: DataFrame) -> DataFrame:
    """Pages with questions: table, paragraphs (texts in order), questions (uid, question, answer (array), answer_type, derivation, scale); a row for each question that has an answer."""
    table = F.nullif(traces.markdown(F.coalesce("table", F.array().cast("array<array<string>>"))), F.lit(""))
    chunks = F.concat(F.array_compact(F.array(table)), F.coalesce("paragraphs", F.array().cast("array<string>")))
    rows = pages.select(chunks.alias("chunks"), F.to_json("table").alias("raw"), F.explode("questions").alias("q")).where("size(q.answer) > 0").select("chunks", "raw", "q.*")
    kind = F.coalesce("answer_type", F.lit("span"))
    worked_out = (kind == "arithmetic") & (F.coalesce("derivation", F.lit("")) != "")
    trace = F.when(worked_out, traces.derivation_trace(F.col("derivation"))).when(kind.isin("span", "multi-span"), LOOKUP).when(kind == "count", COUNTING).otherwise(ANALYSIS)
    name = F.concat(F.lit("tatqa_"), F.coalesce("uid", digest("question", "answer")))
    return _record(rows, "tatqa", name, F.lit("Supported"), F.col("question"), F.col("chunks"), trace, F.array_join("answer", ", "), scale=F.coalesce("scale", F.lit("")), raw_table=F.col("raw"), answer_type=kind, sabotage_ready=F.lit(True))


def gold_filings(rows: DataFrame) -> DataFrame:
    """Questions on filings: financebench_id, question, answer, evidence (array of texts), doc_name, doc_period, company, doc_link; a row needs some evidence."""
    kept = rows.withColumn("_chunks", F.array_compact("evidence")).where("size(_chunks) > 0")
    name = F.concat(F.lit("finbench_gold_"), F.coalesce("financebench_id", digest("question", "answer")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return _record(
        kept, "financebench_gold", name, F.lit("Supported"), empty("question"), F.col("_chunks"), F.lit(ANALYSIS), empty("answer"), sabotage_ready=F.lit(True), original_split=F.lit("gold"), doc_name=empty("doc_name"),
        doc_period=F.coalesce(F.col("doc_period").cast("string"), F.lit("None")), company=empty("company"), doc_link=empty("doc_link"),
    )


def judged_filings(rows: DataFrame) -> DataFrame:
    """Judged prompts: id, label, messages (array of contents). FAIL is unfounded and not to be attacked, PASS supported; other labels, and prompts without question, document or answer, go.

    The company is looked for in the question, then in the first 500 characters of the document. The judge's reasoning is kept as it is written.
    """
    mark = F.upper(F.coalesce("label", F.lit("")))
    label = F.when(F.contains(mark, F.lit("FAIL")), "Unfounded").when(F.contains(mark, F.lit("PASS")), "Supported")
    parts = rows.withColumns({"_label": label, "_mark": mark, "_p": prompt_sections(F.get("messages", F.lit(0)))})
    parts = parts.where("_label IS NOT NULL AND _p.question <> '' AND _p.context <> '' AND _p.answer <> ''")
    early = company_in(F.col("_p.question"))
    company = F.when(early != NOBODY, early).otherwise(company_in(F.substring("_p.context", 1, 500)))
    reasoning = F.nullif(F.regexp_extract(F.get("messages", F.lit(1)), r'(?s)"REASONING":\s*(\[.*?\]),\s*"SCORE":', 1), F.lit(""))
    name = F.concat(F.lit("finbench_test_"), F.coalesce("id", digest("messages")))
    split = F.when(F.col("_label") == "Unfounded", "test_failure").otherwise("test_success")
    return _record(
        parts, "financebench_test", name, F.col("_label"), F.col("_p.question"), F.array("_p.context"), F.lit(ANALYSIS), F.col("_p.answer"), sabotage_ready=F.col("_label") == "Supported", original_split=split, original_label=F.col("_mark"),
        original_reasoning=reasoning, company=company,
    )


def hallucinations(rows: DataFrame) -> DataFrame:
    """Labelled answers: query, context, answer, label, doc_type; all four have to be there. "not hallucination" is supported, other hallucinations unfounded, any other label goes."""
    mark = F.lower(F.trim("label"))
    label = F.when(F.contains(mark, F.lit("not hallucination")), "Supported").when(F.contains(mark, F.lit("hallucination")), "Unfounded")
    kept = rows.withColumns({"_label": label, "_mark": mark}).where("_label IS NOT NULL AND query <> '' AND context <> '' AND answer <> ''")
    name = F.concat(F.lit("phantom_"), "doc_type", F.lit("_"), digest("query", "context", "answer"))
    size = F.greatest(F.lit(1), text.estimates(F.col("context"))["by_words"].cast("int"))
    return _record(
        kept, "phantom_hallucination", name, F.col("_label"), traces.stripped(F.col("query")), F.array(traces.stripped(F.col("context"))), F.lit(ANALYSIS), traces.stripped(F.col("answer")), sabotage_ready=F.col("_label") == "Supported",
        doc_type=F.col("doc_type"), original_label=F.col("_mark"), token_estimate=size,
    )


def axioms(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """General questions: category, question, best_answer, source; those of the given categories (contained, in any case) with both texts, never to be attacked and without context."""
    kept = rows.withColumn("_category", F.trim(F.coalesce("category", F.lit("")))).where(first_category(F.col("_category"), categories).isNotNull() & F.col("question").isNotNull() & F.col("best_answer").isNotNull())
    name = F.concat(F.lit("truthfulqa_"), digest("question", "best_answer"))
    return _record(
        kept, "truthfulqa_axioms", name, F.lit("General"), traces.stripped(F.col("question")), F.array().cast("array<string>"), F.lit(ANALYSIS), traces.stripped(F.col("best_answer")), sabotage_ready=F.lit(False), original_category=F.col("_category"),
        source_ref=F.coalesce("source", F.lit("Unknown")),
    )
