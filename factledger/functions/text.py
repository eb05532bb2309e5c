"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger.functions.once import once

# fixed values: words that carry no signal for the lexical gate
STOP_WORDS = (
    "the", "a", "an", "of", "in", "and", "or", "for", "to", "by", "on", "at", "from", "with", "as", "is", "are", "was", "were",
    "its", "our", "net", "total", "per",
)
GATE_THRESHOLD = 0.20
# fixed values: what a token of the gate is, and where a sentence ends (not after abbreviations)
TOKEN = r"\b[a-zA-Z0-9&%/]+\b"
ABBREVIATION_SAFE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more that aren't stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def strip_context(text: Column) -> Column:
    """``text`` without a leading ``[Previous Context: ...]``."""
    return F.regexp_replace(text, r"^\[Previous Context:[^\]]*\]\s*", "")


def lexical_recall(query: Column, text: Column) -> Column:
    """Share of the query's token multiset that the text has; 1 for an empty query."""
    have = tokens(strip_context(text))
    both = F.aggregate(
        F.array_distinct(query),
        F.lit(0),
        lambda n, t: n + F.least(F.size(F.filter(query, lambda x: x == t)), F.size(F.filter(have, lambda x: x == t))),
    )
    return F.when(F.size(query) == 0, 1.0).otherwise(both / F.size(query))


def passes_gate(query: Column, text: Column, threshold: float = GATE_THRESHOLD) -> Column:
    return lexical_recall(query, text) >= threshold


def entity_id(name: Column) -> Column:
    """``ID_UPPER_SNAKE``; the global entity where the name is empty."""
    clean = F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", "EXP_GLOBAL").otherwise(F.concat(F.lit("ID_"), F.upper(F.regexp_replace(clean, r"\s+", "_"))))


def chunk_id(record: Column, text: Column) -> Column:
    """md5 of the record and the lower-cased text with its white space collapsed."""
    return F.md5(F.concat_ws("::", record, F.regexp_replace(F.trim(F.lower(text)), r"[ \t\n\r\f\x0b]+", " ")))


def sentences(text: Column) -> Column:
    """Sentences, not split after abbreviations such as ``e.g.`` or ``Mr.``."""
    return F.filter(F.split(text, ABBREVIATION_SAFE_END), lambda s: F.trim(s) != "")


def strip_reasoning(text: Column) -> Column:
    """``text`` without ``<think>`` parts and code fences."""
    return F.regexp_replace(F.regexp_replace(text, "(?is)<think>.*?</think>", ""), "```[a-zA-Z]*", "")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return once(F.lower(text), lambda lowered: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(lowered, p)))


def has_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands in the text between word boundaries, in any case."""
    return text.rlike(rf"(?i)\b\Q{word}\E\b")


def replace_first_word(text: Column, old: Column, new: Column) -> Column:
    """The first whole-word occurrence (any case) replaced; null where there is none."""
    at = F.regexp_instr(text, F.concat(F.lit(r"(?i)\b\Q"), old, F.lit(r"\E\b")))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def collapsed(quote: Column) -> Column:
    """A quote with each white space as one space and none at its ends."""
    return F.trim(F.regexp_replace(quote, r"\s+", " "))


def exact_position(source: Column, quote: Column) -> Column:
    """Offset (from 0) of the quote, in the text or in the text with its white space collapsed; -1 if absent."""
    loose = lambda at: F.when(at >= 0, at).otherwise(F.instr(F.regexp_replace(source, r"\s+", " "), collapsed(quote)) - 1)
    return once(F.instr(source, quote) - 1, loose)


def word_count_estimate(text: Column) -> Column:
    """Tokens, at four characters each."""
    return F.floor(F.length(text) / 4)


# fixed values: words that don't count when answers are compared, and answers that decline
SMALL_WORDS = ("and", "the", "of", "for", "in", "with", "on", "at", "by", "from", "to", "is", "a", "an")
REFUSALS = ("not available", "no information", "cannot answer", "not found", "insufficient data", "no data", "does not state")
# fixed values: words that carry nothing of a metric's meaning
METRIC_STOP_WORDS = (
    "net", "total", "of", "and", "the", "a", "in", "by", "per", "at", "for", "is", "was", "were", "to", "from", "on", "with", "as", "ratio", "value", "metric",
    "amount", "fact", "item", "percentage", "percent", "increase", "decrease", "growth", "change", "period", "year", "quarter", "fiscal", "ended", "current",
    "prior", "last",
)


def words(text: Column) -> Column:
    """Runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))


def overlap(asked: Column, have: Column) -> Column:
    """Share of the distinct words of ``asked`` that ``have`` has; null without any."""
    distinct = F.array_distinct(asked)
    return F.try_divide(F.size(F.array_intersect(distinct, have)), F.size(distinct))


def without_citations(text: Column) -> Column:
    """An answer without ``(Source: ...)`` parts, final full stops and capitals."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)\(source:.*?\)", "")), r"\.+$", ""))


def longest_number(quote: Column) -> Column:
    """The longest number of a quote (first of the longest, two characters or more); empty if there is none."""
    numbers = F.regexp_extract_all(quote, F.lit(r"\d[\d,.]+"), F.lit(0))
    return F.aggregate(numbers, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def partial_position(source: Column, quote: Column) -> Column:
    """Offset of the longest number of a quote in the source; -1 if absent."""
    return once(longest_number(quote), lambda n: F.when(n == "", -1).otherwise(F.instr(source, n) - 1))


def core_tokens(metric: Column) -> Column:
    """Words of a metric that carry meaning: no stop words, no numbers."""
    return F.filter(words(metric), lambda w: ~w.isin(*METRIC_STOP_WORDS) & ~w.rlike(r"^\d+$"))


def semantic_support(metric: Column, context: Column) -> Column:
    """Share of a metric's core tokens in the context, give or take a final s; initials such as I.R.S. are joined. Null without core tokens."""
    have, core = words(F.regexp_replace(context, r"\.(?<=[a-zA-Z]\.)(?=[a-zA-Z])", "")), core_tokens(metric)
    said = lambda have, w: F.array_contains(have, w) | (F.endswith(w, F.lit("s")) & F.array_contains(have, F.regexp_replace(w, "s$", ""))) | F.array_contains(have, F.concat(w, F.lit("s")))
    share = lambda x: F.try_divide(F.size(F.filter(x["core"], lambda w: said(x["have"], w))), F.size(x["core"]))
    return once(F.struct(have.alias("have"), core.alias("core")), share)


def alignment_confidence(status: Column, support: Column) -> Column:
    """Confidence of a fact by how its quote was found and how far its metric is supported; null where it is rejected.

    The base is 0.70, less for partial (0.90) and fuzzy (0.75) quotes; a supported fact never falls under 0.61.
    """
    base = F.when(status == "EXACT", 0.70).when(status == "PARTIAL", 0.70 * 0.90).when(status == "FUZZY", 0.70 * 0.75)
    supported = F.greatest(base * (0.5 + support * 0.5), F.lit(0.61))
    return F.when(support.isNull(), base * 0.1).when(support >= 0.30, supported)


def split_previous(text: Column) -> Column:
    """struct<context, source> of a text that may begin with ``[Previous Context: ...]`` and an empty line."""
    at = F.when(F.startswith(text, F.lit("[Previous Context: ")), F.instr(text, "]\n\n")).otherwise(0)
    head = F.when(at > 0, F.substring(text, F.lit(20), at - 20)).otherwise("")
    return F.struct(head.alias("context"), F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text).alias("source"))


def shortened(quote: Column, most: int = 120) -> Column:
    """A long quote cut at its last space, if that is past the middle."""
    head = F.substring(quote, 1, most)
    at = most - F.instr(F.reverse(head), " ") + 1  # place of the last space, from 1
    cut = F.when((F.instr(head, " ") > 0) & (at - 1 > most // 2), F.substring(head, F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(quote) > most, cut).otherwise(quote)


def table_kind(text: Column) -> Column:
    """pipe, csv, tsv, numeric or null: what sort of table a text looks like."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    share = lambda test: F.try_divide(F.size(F.filter(lines, test)), F.size(lines))
    many = lambda mark: lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))) >= 2
    numeric_rows = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\d[\d,.]*")) >= 2))
    return (
        F.when(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), "pipe").when(share(many(",")) >= 0.6, "csv").when(share(many("\t")) >= 0.6, "tsv")
        .when(numeric_rows >= 3, "numeric").when(share(lambda x: F.contains(x, F.lit("|"))) >= 0.7, "pipe")
    )


def first_contained(text: Column, names: tuple[str, ...]) -> Column:
    """The first of ``names`` that a text contains, in any case."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.contains(F.lower(text), F.lit(name.lower())), name).otherwise(out)
    return out


def first_verdict(text: Column) -> Column:
    """0, 1 or 2 by an answer's first word (supported or found, unfounded or fake, general); -1 for any other."""
    word = F.lower(F.regexp_extract(F.trim(text), "^[A-Za-z]+", 0))
    return F.when(word.isin("supported", "found"), 0).when(word.isin("unfounded", "fake"), 1).when(word == "general", 2).otherwise(-1)


def last_verdict(text: Column) -> Column:
    """The same by the last of these words anywhere in the answer."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(supported|found|unfounded|fake|general)\b"), F.lit(1))
    return F.when(F.size(found) > 0, first_verdict(F.try_element_at(found, F.lit(-1)))).otherwise(-1)


def capitalised(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Distinct capitalised words of three letters or more that aren't ``known``, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*known)) if known else found)


def estimates(text: Column) -> Column:
    """struct<quarter, by_words, words>: token counts at four characters each, at three quarters of a word each, and words."""
    n = F.regexp_count(text, F.lit(r"\S+"))
    return F.struct(F.floor(F.length(text) / 4).alias("quarter"), F.floor(n / 0.75).alias("by_words"), n.cast("long").alias("words"))
