"""What reviewers and auditors see: injected values, prompts and verdicts taken apart, exports, payloads and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factledger.functions.traces import stripped

# fixed values: what stands in for a missing part, and the words that count as a verdict
SYSTEM = "You are a rigorous financial auditor."
COMPARE = "I will compare the target sentence against the provided documentary evidence to verify its accuracy."
ANALYSE = "Analyzing the evidence grounded in the context provided."
VERDICT = "(?i)(found|supported|fake|unfounded|general)"
TOKEN = r"(?U)\w+|[^\w\s]"


def _value_after(text: Column, mark: str) -> Column:
    """What follows the last ``mark``, without white space around it and full stops behind it."""
    return F.regexp_replace(stripped(F.substring_index(text, mark, -1)), r"\.+$", "")


def injected_value(diff: Column) -> Column:
    """The value an attack put in: of ``Swapped x with y`` y, of ``x -> y z`` y, else the whole text."""
    arrow = F.regexp_extract(diff, r"->\s*([^ ]+)", 1)
    return F.when(F.contains(diff, F.lit("Swapped")) & F.contains(diff, F.lit("with")), _value_after(diff, "with")).when(
        arrow != "", F.regexp_replace(stripped(arrow), r"\.+$", "")).otherwise(_value_after(diff, "->"))


def intended_lie(diff: Column) -> Column:
    """The same for exports, which take all that follows and leave other texts as they are."""
    return F.when(F.coalesce(diff, F.lit("")) == "", "N/A").when(F.contains(diff, F.lit("with")), _value_after(diff, "with")).when(
        F.contains(diff, F.lit("->")), _value_after(diff, "->")).otherwise(diff)


def prompt_parts(prompt: Column) -> Column:
    """struct<system, user> of a prompt in turn tags; the user part ends in ``Label:``. The tags are a format, so these patterns are fixed."""
    system = r"(?s)<\|im_start\|>system\n(.*?)<\|im_end\|>"
    user = r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>\s*<\|im_start\|>assistant"
    part = lambda pattern, missing: F.when(F.regexp_like(prompt, F.lit(pattern)), stripped(F.regexp_extract(prompt, pattern, 1))).otherwise(missing)
    return F.struct(part(system, F.lit(SYSTEM)).alias("system"), F.concat(part(user, prompt), F.lit("\nLabel:")).alias("user"))


def before_verdict(raw: Column) -> Column:
    """struct<text, extra>: an answer without reasoning, emphasis and ``Label:``, and how many tokens came before its verdict.

    An answer cut off while reasoning is empty; one without a verdict has all its tokens as extra.
    """
    count = lambda s: F.regexp_count(s, F.lit(TOKEN))
    clean = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    cut_off = F.contains(clean, F.lit("<think>")) & ~F.contains(clean, F.lit("</think>"))
    plain = F.regexp_replace(clean, r"\*", "")
    upto = F.regexp_extract(plain, f"(?s)^(.*?){VERDICT}", 0)
    body = stripped(F.regexp_replace(stripped(plain), r"(?i)^label\s*:?\s*", ""))
    text = F.when(F.coalesce(raw, F.lit("")) == "", "").when(cut_off, "").otherwise(body)
    extra = F.when(F.coalesce(raw, F.lit("")) == "", 0).when(cut_off, count(raw)).when(upto != "", count(upto) - 1).otherwise(count(plain))
    return F.struct(text.alias("text"), extra.alias("extra"))


def reasoning_parts(steps: Column) -> Column:
    """struct<thinking, analysis>: all steps but the last, and the last; each ends in a full stop."""
    stop = lambda s: F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))
    n = F.coalesce(F.size(steps), F.lit(0))
    before = F.array_join(F.slice(steps, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    thinking = F.when(n > 1, before).when(n == 1, COMPARE).otherwise(ANALYSE)
    return F.struct(stop(thinking).alias("thinking"), stop(F.coalesce(F.try_element_at(steps, F.lit(-1)), F.lit(""))).alias("analysis"))


def nested(rows: DataFrame) -> DataFrame:
    """Candidates as they are kept: what goes into a model in ``inputs``, an attack only where there was one."""
    return rows.select(
        "id", F.coalesce("dataset_source", F.lit("unknown")).alias("dataset_source"), "label", "target_sentence",
        F.struct(F.coalesce("query", F.lit("")).alias("query"), F.coalesce("context_chunks", F.array().cast("array<string>")).alias("context_chunks"), F.coalesce("trace_code", F.lit("")).alias("trace_code")).alias("inputs"),
        F.when(F.col("attack").isNotNull(), F.struct(F.col("attack").alias("type"), F.col("diff"))).alias("sabotage_info"),
    )


def review_export(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """Audited candidates under review, flat, with defaults; an audit without its candidate is left out."""
    else_ = lambda name, missing: F.coalesce(name, F.lit(missing))
    return audits.where(F.col("status") == "review").join(candidates, "id").select(
        "id", else_("dataset_source", "unknown").alias("source_dataset"), F.col("status").alias("audit_status"), else_("audit_target_group", "N/A").alias("audit_target"),
        else_("sabotage_info.type", "none").alias("attack_type"), intended_lie(F.col("sabotage_info.diff")).alias("intended_lie"), else_("teacher_label", "N/A").alias("teacher_verdict"),
        else_("target_sentence", "").alias("target_sentence"), F.col("inputs.trace_code").alias("logic_trace"),
    )


def audit_payloads(wanted: DataFrame, candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """For each wanted id that is a candidate what an auditor gets: its inputs, its attack, and what the teacher said, if anything."""
    seen = audits.select("id", "audit_target_group", "teacher_label")
    return wanted.select("id").join(candidates, "id").join(seen, "id", "left").select(
        "id", F.col("inputs.query").alias("user_query"), "target_sentence", F.col("inputs.trace_code").alias("trace_code"), "sabotage_info",
        F.coalesce("label", F.lit("Unknown")).alias("original_label"), F.coalesce("audit_target_group", F.lit("N/A")).alias("audit_target_group"), F.coalesce("teacher_label", F.lit("N/A")).alias("teacher_label"),
    )


def progress(candidates: DataFrame, audits: DataFrame, human: DataFrame, ai: DataFrame, unaudited: str = "truthfulqa_axioms") -> DataFrame:
    """``candidates`` with ``final_status`` (people before models before the teacher) and ``class``.

    Each table has a row for an id; ``audits`` has status and valid.
    """
    by = lambda frame, name: frame.select("id", F.lit(True).alias(name))
    rows = candidates.join(audits.select("id", "status", "valid", F.lit(True).alias("_audited")), "id", "left").join(by(human, "_human"), "id", "left").join(by(ai, "_ai"), "id", "left")
    status = (
        F.when(F.col("dataset_source") == unaudited, "Skipped").when(F.col("_human"), "Human Ver").when(F.col("_ai"), "AI Ver")
        .when(F.col("status") == "verified", "Auto Ver").when(F.col("status") == "discarded", "Discard").otherwise("Pending")
    )
    attacked = F.col("sabotage_info").isNotNull()
    kind = (
        F.when(F.col("label") == "General", "General Axioms").when(F.col("label") != "Unfounded", F.when(F.col("label") == "Supported", "Supported"))
        .when(~attacked, "Natural Unfounded").when(F.col("valid"), "Validated Sabotage").when(F.col("_audited"), "Rejected Sabotage").otherwise("Pending Sabotage")
    )
    return rows.withColumns({"final_status": status, "class": kind}).drop("_audited", "_human", "_ai")


def flat(frame: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [leaf for f in kind.fields for leaf in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)])]

    return frame.select(*(F.col(".".join(f"`{p}`" for p in leaf)).alias(".".join(leaf)) for leaf in leaves(frame.schema, ())))


def shown(frame: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Those of the wanted columns that there are, in the wanted order."""
    return frame.select(*(c for c in wanted if c in frame.columns))


def token_averages(frame: DataFrame) -> DataFrame:
    """The mean of each column with ``tokens`` in its name."""
    return frame.agg(*(F.avg(f"`{c}`").alias(c) for c in frame.columns if "tokens" in c))


# fixed values: the headings of a prompt's sections; a section ends at the next line that begins with two dashes
SECTIONS = (("question", r"QUESTION \(THIS DOES NOT COUNT AS BACKGROUND INFORMATION\):"), ("context", "DOCUMENT:"), ("answer", "ANSWER:"))


def prompt_sections(prompt: Column) -> Column:
    """struct<question, context, answer> of a prompt: what stands under the first heading of each, in any order, without white space at its ends; empty where it is missing or never ends.

    Headings of others inside a section are part of it.
    """
    found = lambda heading: F.regexp_extract(prompt, rf"(?s){heading}\s*\n(.*?)\n\s*--", 1)
    return F.struct(*(F.coalesce(F.regexp_replace(found(h), r"^\s+|\s+$", ""), F.lit("")).alias(name) for name, h in SECTIONS))
