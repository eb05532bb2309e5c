"""Why answers fail, from what they say and what was retrieved; dataset validation; groundedness; bleed of opposite terms."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from factledger.functions import numeric, text
from factledger.operators.evaluation import exact_match, taxonomy

# fixed values: answers of runs that broke off, signs of a cut answer, topics on which gold labels are doubtful, phrases of a declined answer, and the heading of the text chunks in a context
SENTINELS = ("GENERATION_FAILURE", "TIMEOUT_FAILURE")
TRUNCATED = ("MAX_TOKENS", "length", "max_tokens")
DOUBTFUL_SOURCE, DOUBTFUL = "tatqa", ("goodwill", "plant and equipment", "intangibles", "carrying value")
DECLINED = ("not available", "no information", "cannot answer", "not found", "insufficient", "does not mention", "does not state", "not in context")
CHUNKS = "# SOURCE TEXT CHUNKS"
# fixed values: terms, and the opposite that bleeds into a context
OPPOSITES = (
    ("gross profit", "net profit"), ("gross margin", "net margin"), ("net income", "net loss"), ("operating income", "operating loss"), ("revenue", "cost of revenue"),
    ("revenue", "cost of goods sold"), ("total assets", "total liabilities"), ("cash flow from operations", "cash flow from investing"), ("diluted eps", "basic eps"), ("accounts receivable", "accounts payable"),
)


def failure(rows: DataFrame, coded_runs: tuple[str, ...]) -> Column:
    """The failure class of each row: answer, gold, label, lookup, context, run, code_ok, finish_reason, source, golden, retrieved, indexed (arrays of chunk ids), warned, bleed.

    Every predicate is worked out here. A run of ``coded_runs`` without a code result broke off; for other runs there is none to expect. Gold evidence is a coverage gap
    where any of it isn't indexed, and was retrieved where all of it was (no evidence: both hold). A bleed counts where the answer has a number of the context's ledger part. Null flags are false.
    """
    c = {n: F.col(n) for n in rows.columns}
    sure = lambda x: F.coalesce(x, F.lit(False))
    answer, coded = F.coalesce("answer", F.lit("")), c["run"].isin(*coded_runs)
    golden, none = F.coalesce("golden", F.array().cast(rows.schema["golden"].dataType)), F.array().cast(rows.schema["golden"].dataType)
    lacks = lambda name: F.size(F.array_except(golden, F.coalesce(name, none))) > 0
    gold = numeric.number_set(F.coalesce("gold", F.lit("")))
    context = F.coalesce("context", F.lit(""))
    ledger_part = numeric.number_set(F.substring_index(context, CHUNKS, 1))
    cut = F.exists(F.array(*map(F.lit, TRUNCATED)), lambda s: F.contains(F.coalesce("finish_reason", F.lit("")), s))
    return taxonomy({
        "correct": sure(exact_match(answer, c["gold"], c["label"], c["lookup"])), "failed": answer.isin(*SENTINELS) | sure(coded & c["code_ok"].isNull()) | cut,
        "ambiguous": sure(F.contains(F.lower("source"), F.lit(DOUBTFUL_SOURCE))) & text.contains_any(answer, DOUBTFUL), "gap": lacks("indexed"), "retrieved": ~lacks("retrieved"),
        "numeric": F.size(gold) > 0, "code_ok": sure(coded & c["code_ok"]), "refusal": text.contains_any(answer, DECLINED) | sure(c["warned"]),
        "gold_in_context": F.size(F.array_except(gold, numeric.number_set(context))) == 0,
        "bleed": sure(c["bleed"]) & ~sure(c["code_ok"]) & F.arrays_overlap(ledger_part, numeric.number_set(answer)),
    })


def opposite_terms(query: Column, context: Column, pairs: tuple[tuple[str, str], ...] = OPPOSITES) -> Column:
    """struct<checked, triggered, ratio>: pairs whose term the query has, those whose opposite the context has too, and their share (0 for none), by whole words in any case."""
    asked, found = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    checked = sum((text.has_word(asked, a).cast("int") for a, _ in pairs), F.lit(0))
    triggered = sum(((text.has_word(asked, a) & text.has_word(found, b)).cast("int") for a, b in pairs), F.lit(0))
    return F.struct(checked.alias("checked"), triggered.alias("triggered"), F.coalesce(F.try_divide(triggered, checked), F.lit(0.0)).alias("ratio"))


def _parses(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.pandas_udf(BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether a text is Python by its syntax; nothing is run."""
    return code.map(_parses).astype(bool)


def validation_stats(records: DataFrame) -> DataFrame:
    """check, n over ``records`` (id, label, has_inputs, query, context_chunks, trace, sabotage): total_rows, each broken rule, traces by what they are, and ``label_<label>``, in one pass.

    Records without inputs break the schema and are checked no further. Empty contexts are right for general questions. Checks that no record meets are not listed.
    """
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    inputs = F.coalesce("has_inputs", F.lit(False))
    label, trace = F.coalesce("label", F.lit("None")), F.col("trace")
    broken, absent = F.contains(trace, F.lit("# TRACE_GENERATION_ERROR")), F.contains(trace, F.lit("# NO_TRACE_AVAILABLE"))
    no_context = F.coalesce(F.size("context_chunks"), F.lit(0)) <= 0
    kind = F.when(~filled(trace), None).when(broken, "trace_errors").when(absent, "no_trace").when(parses(F.coalesce("trace", F.lit(""))), "valid_traces").otherwise("trace_syntax_errors")
    unmarked = (label == "Unfounded") & F.contains(F.coalesce("id", F.lit("")), F.lit("sabotaged")) & F.col("sabotage").isNull()
    checks = [
        F.lit("total_rows"), F.when(~inputs, "schema_errors"), F.when(inputs & ~filled(F.col("query")), "empty_query"), F.when(inputs & no_context & (label != "General"), "empty_context"),
        F.when(inputs, kind), F.when(inputs, F.concat(F.lit("label_"), label)), F.when(inputs & unmarked, "missing_sabotage_info"),
    ]
    return records.select(F.explode(F.array_compact(F.array(*checks))).alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def groundedness(sentences: DataFrame, judged: DataFrame, answer: str, key: str) -> DataFrame:
    """Each answer's sentences and the share that is GROUNDED, 0 without any; ``sentences`` (answer, key) may hold a null key for an answer without sentences.

    ``judged`` (key, prediction, error): a sentence without a verdict, or with an error, counts as made up.
    """
    rows = sentences.join(judged.select(key, "prediction", "error"), key, "left")
    grounded = F.col("error").isNull() & F.coalesce(F.col("prediction") == "GROUNDED", F.lit(False))
    return rows.groupBy(answer).agg(F.count(key).alias("sentences"), F.coalesce(F.round(F.try_divide(F.count_if(grounded & F.col(key).isNotNull()), F.count(key)), 6), F.lit(0.0)).alias("groundedness"))


NUMBERS = r"-?\d[\d,.]*(?:\s+-?\d[\d,.]*){2,}"


def looks_tabular(content: Column) -> Column:
    """Whether a block is a table: pipes and a rule; or, of three lines or more, three commas or three tabs on most, three rows of three numbers, or the same two pipes or more on most lines that have any."""
    lines = F.filter(F.split(content, r"\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    marks = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
    many = lambda mark: F.size(F.filter(lines, lambda x: marks(x, mark) >= 3)) >= n * 0.6
    pipes = F.filter(F.transform(lines, lambda x: marks(x, "|")), lambda k: k > 0)
    common = F.exists(F.array_distinct(pipes), lambda k: (k >= 2) & (F.size(F.filter(pipes, lambda p: p == k)) >= F.size(pipes) * 0.7))
    rows = F.size(F.filter(lines, lambda x: x.rlike(NUMBERS))) >= 3
    table = (F.contains(content, F.lit("|")) & F.contains(content, F.lit("---"))) | ((n >= 3) & (many(",") | many("\t") | rows | ((F.size(pipes) >= 3) & common)))
    return F.coalesce((F.length(F.trim(content)) >= 10) & table, F.lit(False))


def made_up_rates(rows: DataFrame, run: str, rate: str) -> DataFrame:
    """Each run's mean of ``rate`` as a percentage with two decimals; N/A where it has none."""
    means = rows.groupBy(run).agg((F.avg(F.col(rate).cast("double")) * 100).alias("mean"))
    return means.withColumn("mean", F.when(F.col("mean").isNull(), "N/A").otherwise(F.format_string("%.2f%%", "mean")))
