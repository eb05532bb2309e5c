"""From proposed facts to ledger rows: grounding of quotes, semantic support, merging of passes; and whole tables melted."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factledger.functions import numeric, text
from factledger.functions.similarity import common_length, letter_bits
from factledger.operators.ledger import first_of

WINDOW, LEAST_OVERLAP, LEAST_RECALL, ACCEPTED = 20, 0.55, 0.85, 0.60
# fixed values: signs that a quote is a piece of the extraction schema, and of tables whose first column names companies
SCHEMA_SIGNS = ("metric_name", "num_value", "unit_normalized", "grounding_quote", "text_nuance")
ENTITY_SIGNS = ("corp", "inc", "index", "company", "group", "peer", "industry")
TOKEN = re.compile(r"\w+|\S")
RULE_LINE = r"^\|?\s*:?-+:?\s*\|"


@lru_cache(1024)
def _asked(quote: str) -> tuple[Counter, list[tuple[str, int]]]:
    """A quote's tokens and characters with their counts, the most frequent characters first."""
    return Counter(w.lower() for w in TOKEN.findall(quote)), Counter(quote).most_common()


def _lacks(window: str, letters: list[tuple[str, int]], most: int) -> bool:
    """Whether a window lacks more than ``most`` of these characters."""
    for letter, n in letters:
        if (less := n - window.count(letter)) > 0:
            most -= less
            if most < 0:
                return True
    return False


def _common(quote: str, window: str) -> int:
    return common_length(letter_bits(quote), len(quote), window)


def _matching(quote: str, window: str) -> int:
    return sum(b.size for b in difflib.SequenceMatcher(None, quote, window, autojunk=False).get_matching_blocks())


_common_again, _matching_again = lru_cache(1024)(_common), lru_cache(1024)(_matching)  # texts repeat their phrases


def fuzzy_interval(quote: str, source: str) -> tuple[int, int] | None:
    """Where the window of a source that recalls most of a quote's characters stands, if that is ``LEAST_RECALL`` or more; the first of the best.

    Windows without enough of the quote's tokens go by counting, as tokens enter and leave. What a window recalls is the size of its
    matching blocks. A common subsequence is never shorter, and shared characters are never fewer, so blocks are looked for only where these could
    beat the best so far; windows with most tokens come first.
    """
    asked, letters = _asked(quote)
    tokens = TOKEN.findall(source)
    total = asked.total()
    width = min(max(total, WINDOW), len(tokens))
    if not total or not width:
        return None
    words = [w.lower() for w in tokens]
    left, shared, likely = dict(asked), 0, []
    for i, word in enumerate(words):
        if word in left:
            shared += left[word] > 0
            left[word] -= 1
        if i >= width and (gone := words[i - width]) in left:
            left[gone] += 1
            shared -= left[gone] > 0
        if i >= width - 1 and shared / total >= LEAST_OVERLAP:
            likely.append((-shared, i - width + 1))
    best, where, spare = 0, len(tokens), int(len(quote) * (1 - LEAST_RECALL)) + 1
    beaten = lambda most, i: most / len(quote) < LEAST_RECALL or most < best or (most == best and i > where)
    for _, i in sorted(likely):
        window = " ".join(tokens[i : i + width])
        common, matching = (_common_again, _matching_again) if len(window) < 1000 else (_common, _matching)
        if _lacks(window, letters, min(spare, len(quote) - best - (i > where))) or beaten(common(quote, window), i):
            continue
        found = matching(quote, window)
        if not beaten(found, i):
            best, where = found, i
    if not best:
        return None
    places = list(islice(TOKEN.finditer(source), where, where + width))
    return places[0].start(), places[-1].end()


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def _fuzzy(quotes: pd.Series, sources: pd.Series) -> pd.DataFrame:
    found = [fuzzy_interval(q, s) or (None, None) if q and s else (None, None) for q, s in zip(quotes, sources, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


_fuzzy = _fuzzy.asNondeterministic()  # it isn't, but a filter on what it finds would be pushed below it, and so run it twice


def sanitise(facts: DataFrame) -> DataFrame:
    """``facts`` with a scale (1 if null) and a quote that is short and no piece of the schema."""
    quote = F.coalesce("grounding_quote", F.lit(""))
    clean = F.when(text.contains_any(quote, SCHEMA_SIGNS), "").otherwise(text.shortened(quote))
    return facts.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "grounding_quote": clean})


def ground(facts: DataFrame) -> DataFrame:
    """``facts`` (grounding_quote, source, section, metric_name, text_nuance) with alignment_status, start, end and confidence.

    A quote is looked for word for word, then with white space collapsed, then by its longest number, then as a window of
    like words; the last runs for those that the others leave only. Its metric must be supported by the source or its section.
    Null sources hold nothing, so their facts are UNALIGNED, as are facts without a quote; null metrics have no support.
    """
    given, facts = facts.columns, facts.withColumns({"_given": F.col("source"), "source": F.coalesce("source", F.lit("")), "_quote": F.trim(F.coalesce("grounding_quote", F.lit("")))})
    metric = F.concat_ws(" ", "metric_name", F.nullif("text_nuance", F.lit("")))
    support = text.semantic_support(metric, F.concat_ws(" ", "source", "section"))
    placed = facts.withColumns({"_exact": text.exact_position(F.col("source"), F.col("_quote")), "_support": support})
    placed = placed.withColumn("_number", F.when(F.col("_exact") < 0, text.longest_number(F.col("_quote"))))
    placed = placed.withColumn("_partial", F.when(F.col("_number") != "", F.instr("source", F.col("_number")) - 1).otherwise(-1))
    placed = placed.withColumn("_kind", F.when(F.col("_quote") == "", "UNALIGNED").when(F.col("_exact") >= 0, "EXACT").when(F.col("_partial") >= 0, "PARTIAL"))
    left = F.col("_kind").isNull()
    placed = placed.withColumn("_at", _fuzzy(F.when(left, F.col("_quote")), F.when(left, F.col("source"))))
    kind = F.coalesce("_kind", F.when(F.col("_at.start").isNull(), "UNALIGNED").otherwise("FUZZY"))
    sure = F.when(kind != "UNALIGNED", text.alignment_confidence(kind, F.col("_support")))
    placed = placed.withColumns({"_sure": sure, "_kind": kind})
    start = F.when(F.col("_kind") == "EXACT", F.col("_exact")).when(F.col("_kind") == "PARTIAL", F.col("_partial")).otherwise(F.col("_at.start"))
    end = (
        F.when(F.col("_kind") == "EXACT", F.least(F.col("_exact") + F.length("_quote"), F.length("source"))).when(F.col("_kind") == "PARTIAL", F.col("_partial") + F.length("_number"))
        .otherwise(F.col("_at.end"))
    )
    held = F.col("_sure").isNotNull()
    out = {
        "alignment_status": F.when(held, F.col("_kind")).otherwise("UNALIGNED"), "start": F.when(held, start).cast("int"), "end": F.when(held, end).cast("int"),
        "confidence": F.coalesce("_sure", F.lit(0.0)),
    }
    return placed.withColumns(out).withColumn("source", F.col("_given")).select(*given, *out)


def merge_passes(facts: DataFrame, per: list[str]) -> DataFrame:
    """Facts of several extraction passes: of equal metric, period and related entity (in any case) the earliest pass stays."""
    keyed = facts.withColumns({"_m": F.lower("metric_name"), "_r": F.lower("related_entity")})
    return first_of(keyed, [*per, "_m", "period_start", "period_end", "_r"], "pass", "metric_name", "num_value").drop("_m", "_r")


def ledger_rows(facts: DataFrame, least: float = ACCEPTED) -> DataFrame:
    """Ledger rows of grounded facts with enough confidence; an unresolved related entity goes to the nuance."""
    value = F.coalesce(F.col("num_value").cast("string"), F.lit("None"))
    row_id = F.md5(F.concat_ws("_", "entity_id", "metric_name", F.coalesce("period_end", F.lit("None")), "block_id", value))
    related = F.concat(F.lit("Related entity (unresolved): "), F.nullif("related_entity", F.lit("")))
    nuance = F.nullif(F.concat_ws("; ", F.nullif("text_nuance", F.lit("")), related), F.lit(""))
    return facts.where(F.col("confidence") >= least).select(
        row_id.alias("row_id"), "entity_id", "metric_name", "num_value", "scale", "period_end", F.array_join("section_path", " > ").alias("doc_section"),
        F.col("block_id").alias("source_chunk_id"), nuance.alias("text_nuance"), "alignment_status", "confidence",
    )


def patch_entity(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` under the entity that ``owners`` (key, entity_id, record) gives; the label follows, and rows without an owner stay."""
    first = first_of(owners.select(key, F.col("entity_id").alias("_entity"), F.col("record").alias("source_record_id")), [key], "source_record_id")
    joined = rows.join(first, key, "left").withColumn("entity_id", F.coalesce("_entity", "entity_id"))
    return joined.withColumn("company_label", F.col("_entity")).drop("_entity")


def link_back(rows: DataFrame, chunk: str, row: str) -> DataFrame:
    """Each chunk with the sorted ids of its ledger rows."""
    return rows.groupBy(chunk).agg(F.array_sort(F.collect_set(row)).alias("row_ids"))


def split_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def hierarchy(rows: Column) -> Column:
    """Full names of array<struct<depth, name, parent>>: names under the parents that stand above with less indent.

    A fold over one table's lines; a table is a block of a page.
    """
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("names"))

    def step(s: Column, r: Column) -> Column:
        kept = F.slice(s["stack"], F.lit(1), r["depth"])
        path = F.concat(kept, F.array(r["name"]))
        return F.struct(F.when(r["parent"], path).otherwise(kept).alias("stack"), F.array_append(s["names"], F.array_join(path, " > ")).alias("names"))

    return F.aggregate(rows, start, step, lambda s: s["names"])


def melt_table(tables: DataFrame, head: int = 5) -> DataFrame:
    """Facts of pipe tables (id, content, context): one for each row label and period column.

    Up to ``head`` lines above the rule are the header, joined by column. Indented labels get their parents' names. Where one of
    the first ten labels looks like a company, the labels are entities and the columns name the metrics.
    """
    lines = F.filter(F.transform(F.split(F.trim("content"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: F.lit(True))
    rule = lambda x: F.trim(x["line"]).rlike(RULE_LINE)
    parsed = tables.withColumn("_lines", lines)
    parsed = parsed.withColumn("_rule", F.array_min(F.transform(F.filter("_lines", lambda x: rule(x) & (x["i"] < head)), lambda x: x["i"])))
    header = F.transform(F.filter("_lines", lambda x: x["i"] < F.coalesce("_rule", F.lit(head))), lambda x: split_cells(x["line"]))
    body = F.filter("_lines", lambda x: (x["i"] > F.coalesce("_rule", F.lit(-1))) & (F.trim(x["line"]) != "") & ~rule(x))
    indent = lambda line: F.regexp_extract(line, r"^\|?\s*((?:&nbsp;|\s)*)", 1)
    label = lambda line: F.trim(F.regexp_extract(line, r"^\|?\s*(?:&nbsp;|\s)*([^|]+)", 1))
    parsed = parsed.withColumn("_head", header)
    parsed = parsed.withColumn("_columns", F.transform(
        F.sequence(F.lit(0), F.array_max(F.transform("_head", F.size)) - 1),
        lambda c: F.array_join(F.filter(F.transform("_head", lambda h: F.coalesce(F.get(h, c), F.lit(""))), lambda v: v != ""), " "),
    ))
    parsed = parsed.withColumn("_rows", F.filter(
        F.transform(body, lambda x: F.struct(
            F.floor(F.length(F.replace(indent(x["line"]), F.lit("&nbsp;"), F.lit("  "))) / 2).cast("int").alias("depth"), label(x["line"]).alias("name"),
            F.forall(F.slice(split_cells(x["line"]), 2, 1_000_000), lambda c: c == "").alias("parent"), split_cells(x["line"]).alias("cells"),
        )),
        lambda r: (r["name"] != "") & ~F.lower(r["name"]).isin("item", "value", "metric"),
    ))
    parsed = parsed.withColumn("_names", hierarchy(F.transform("_rows", lambda r: F.struct(r["depth"].alias("depth"), r["name"].alias("name"), r["parent"].alias("parent")))))
    parsed = parsed.withColumn("_entities", F.exists(F.slice("_names", 1, 10), lambda n: text.contains_any(n, ENTITY_SIGNS)))
    rows = parsed.select("id", "context", "_columns", "_entities", F.posexplode(F.arrays_zip(F.col("_names").alias("name"), F.col("_rows.cells").alias("cells"))).alias("row", "r"))
    cells = rows.select("id", "context", "_entities", "row", F.trim(F.regexp_replace("r.name", r"\s*\(\w+\)", "")).alias("label"), F.col("r.cells").alias("cells"), F.posexplode("_columns").alias("column", "period"))
    cells = cells.where("column > 0 AND label <> '' AND lower(label) NOT IN ('nan', 'null', 'none')").withColumn("cell", F.coalesce(F.get("cells", F.col("column")), F.lit("")))
    read = cells.withColumns({"_p": numeric.parse_cell(F.col("cell")), "unit": numeric.unit_of(F.col("label")), "_year": F.col("period").rlike(r"20\d{2}")})
    kept = read.where(F.col("_p.value").isNotNull() | F.lower("cell").isin("n/a", "—", "-", "nan", "") | F.col("_year"))
    scale = F.when(F.col("unit") == "USD", numeric.scale_of(F.col("context"))).otherwise(1.0)
    low = F.lower("period")
    about = F.contains(low, F.lit("$")) | F.contains(low, F.lit("return")) | F.contains(low, F.lit("value"))
    named = F.when(about, F.concat("period", F.lit(" of "), "label")).when(~F.col("_year"), F.concat("label", F.lit(": "), "period")).otherwise(F.col("label"))
    restated = F.contains(low, F.lit("restated"))
    nuance = F.when(restated & F.col("_p.nuance").isNotNull(), F.concat("_p.nuance", F.lit(" (Restated)"))).when(restated, "Restated").otherwise(F.col("_p.nuance"))
    return kept.select(
        "id", "row", "column", F.when(F.col("_entities"), named).otherwise(F.col("label")).alias("metric_name"), (F.col("_p.value") * scale).alias("num_value"), "unit", scale.alias("scale"),
        F.when(F.col("_year"), F.col("period")).alias("period_end"), nuance.alias("nuance"), F.when(F.col("_entities"), F.col("label")).alias("related_entity"),
    )


def pieces(content: Column, most: int) -> Column:
    """Sentences of a text put together while they fit ``most`` characters; a longer sentence is a piece of its own."""
    join = lambda a, s: F.when(a == "", s).otherwise(F.concat(a, F.lit(" "), s))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))
    step = lambda d, s: F.when(F.length(join(d["open"], s)) <= most, F.struct(join(d["open"], s).alias("open"), d["done"].alias("done"))).otherwise(
        F.struct(s.alias("open"), F.when(d["open"] == "", d["done"]).otherwise(F.array_append(d["done"], d["open"])).alias("done"))
    )
    return F.aggregate(text.sentences(content), start, step, lambda d: F.when(d["open"] == "", d["done"]).otherwise(F.array_append(d["done"], d["open"])))


def useful(facts: DataFrame) -> DataFrame:
    """Facts with a value, a period, a nuance, a digit in the quote, or a metric with a unit."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return facts.where(F.col("num_value").isNotNull() | some("period_end") | some("text_nuance") | F.col("grounding_quote").rlike(r"\d") | (some("metric_name") & some("unit")))


def substantial(blocks: DataFrame, least: int = 10) -> DataFrame:
    """Blocks of ``least`` characters or more with a money sign or more than four digits."""
    digits = F.length(F.regexp_replace("content", "[^0-9]", ""))
    return blocks.where((F.length(F.trim("content")) >= least) & (F.contains("content", F.lit("$")) | (digits > 4)))


def distinct_metrics(rows: DataFrame) -> DataFrame:
    """Each entity's metrics with the place where they were first seen."""
    first = Window.partitionBy("entity_id", "metric_name").orderBy("at")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
