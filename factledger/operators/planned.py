"""Many retrieval plans at once: each plan's facts by its scope, years, metrics and nuance, its chunks ranked, and the prompt's context put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import text, traces

# fixed values: companies that facts of nobody in particular carry, the points of a chunk that a fact came from, and what stands in an empty part
EVERYBODY = ("EXP_GLOBAL", "Global_Entity")
LINKED = 5
NO_FACTS, NO_CHUNKS = "No structured facts found.", "No source text available."


def facts_of(plans: DataFrame, ledger: DataFrame, limit: int = 10, most_open: int | None = None, most_sent: int = 10_000) -> DataFrame:
    """query_id, rank and the ledger's columns: the first ``limit`` facts of each plan in ledger order (``ord``, then row_id).

    Plans: query_id, entity_ids, record, company, years, metrics, nuance; null or empty parts don't filter. With entities and a record either may fit. A fact has to
    belong to the plan's company or to nobody in particular, and to be aligned. Metrics are meant exactly if any fact of the whole ledger has one of the names; else names that contain
    one and pass the lexical gate count. Nuance and metrics are compared in any case, years as parts of the period.

    Plans that ask for the same are answered once. They meet facts by entity and by record; those with neither are compared with the whole ledger, which is sent ``most_sent`` of
    them, or else joined in parts. With ``most_open``, more such plans are an error.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    plans = plans.withColumns({"_by_entity": some("entity_ids"), "_by_record": F.coalesce(F.length("record") > 0, F.lit(False))})
    if most_open is not None and plans.where("NOT _by_entity AND NOT _by_record").limit(most_open + 1).count() > most_open:
        raise ValueError(f"more than {most_open} plans have neither an entity nor a record")
    named = plans.select("query_id", F.explode(F.array_distinct("metrics")).alias("metric_name")).join(ledger.select("metric_name").distinct(), "metric_name", "left_semi")
    plans = plans.join(named.select("query_id").distinct().withColumn("_exact", F.lit(True)), "query_id", "left")
    parts = ["entity_ids", "record", "company", "years", "metrics", "nuance", "_exact"]
    plans = plans.withColumn("_asked", F.sha2(F.to_json(F.struct(*parts)), 256))
    asked = plans.select("_asked", "_by_entity", "_by_record", *parts).dropDuplicates(["_asked"])
    facts = ledger.where(~F.col("alignment_status").eqNullSafe(F.lit("UNALIGNED")))
    by_entity = asked.where("_by_entity").withColumn("entity_id", F.explode(F.array_distinct("entity_ids"))).join(facts, "entity_id")
    by_record = asked.where("_by_record").join(facts, F.col("record") == F.col("source_record_id"))
    # a fact that comes by its entity doesn't come by its record again
    by_record = by_record.where(~(F.col("_by_entity") & F.coalesce(F.array_contains("entity_ids", F.col("entity_id")), F.lit(False))))
    open_ = asked.where("NOT _by_entity AND NOT _by_record")
    few = open_.limit(most_sent + 1).count() <= most_sent
    every = (F.broadcast(open_) if few else open_).join(facts, F.lit(True))
    columns = ["_asked", "company", "years", "metrics", "nuance", "_exact", *facts.columns]
    met = reduce(DataFrame.unionByName, [x.select(columns) for x in (by_entity, by_record, every)])
    company = F.coalesce(F.length("company") == 0, F.lit(True)) | F.coalesce(F.col("company_label").isin(*EVERYBODY) | (F.col("company_label") == F.col("company")), F.lit(False))
    year = ~some("years") | F.exists("years", lambda y: F.coalesce(F.contains("period_end", y), F.lit(False)))
    like = F.exists("metrics", lambda m: F.contains(F.lower("metric_name"), F.lower(m))) & text.passes_gate(F.flatten(F.transform("metrics", text.tokens)), F.col("metric_name"))
    metric = ~some("metrics") | F.when(F.col("_exact"), F.array_contains("metrics", F.col("metric_name"))).otherwise(like)
    nuance = F.coalesce(F.length("nuance") == 0, F.lit(True)) | F.coalesce(F.contains(F.lower("text_nuance"), F.lower("nuance")), F.lit(False))
    kept = met.where(company & year & metric & nuance).select("_asked", *facts.columns)
    first = lambda rows, per: rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy("ord", "row_id"))).where(F.col("rank") <= limit)
    answers = first(kept, "_asked").drop("rank")
    return first(plans.select("query_id", "_asked").join(answers, "_asked").select("query_id", *facts.columns), "query_id")


def chunks_of(chunks: DataFrame, facts: DataFrame, keywords: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` best chunks of each query with ``rank`` and ``score``: ``chunks`` (query_id, id, ord, content, ...), facts (query_id, source_chunk_id), keywords (query_id, keywords).

    A chunk counts once. Up to ``limit`` chunks stay as they are, in their order; of more, those that a fact came from get five points, each keyword contained one (in any case), and ties keep their order.
    """
    once = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("ord"))).where("_n = 1").drop("_n")
    linked = facts.select("query_id", F.col("source_chunk_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_link", F.lit(LINKED))
    joined = once.join(linked, ["query_id", "id"], "left").join(keywords, "query_id", "left")
    said = F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(F.lower("content"), F.lower(k))))
    counted = joined.withColumns({"score": F.coalesce("_link", F.lit(0)) + said, "_all": F.count("*").over(Window.partitionBy("query_id"))})
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_all") > limit, -F.col("score")), "ord", "id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_link", "_all", "keywords")


def contexts(queries: DataFrame, facts: DataFrame, chunks: DataFrame, columns: list[str], instructions: str) -> DataFrame:
    """query_id, context: the facts as a table in markdown (equal entity, metric, period and value once), the chunks with their sections, and the instructions.

    ``facts`` and ``chunks`` are those of ``facts_of`` and ``chunks_of``, a few for each query; ``columns`` that the facts lack are left out.
    """
    first = Window.partitionBy("query_id", "entity_id", "metric_name", "period_end", "num_value").orderBy("rank")
    shown = [c for c in columns if c in facts.columns]
    once = facts.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown))
    ordered = lambda frame, value: frame.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]).alias("all"))
    tables = ordered(once, cells).select("query_id", traces.markdown(F.concat(F.array(F.array(*map(F.lit, shown))), F.col("all"))).alias("table"))
    section = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("Unknown"))
    block = F.concat(F.lit("--- CHUNK_ID: "), F.col("id").cast("string"), F.lit(" ---\nSECTION: "), section, F.lit("\nCONTENT:\n"), "content", F.lit("\n"))
    texts = ordered(chunks, block).select("query_id", F.array_join("all", "\n").alias("texts"))
    joined = queries.select("query_id").join(tables, "query_id", "left").join(texts, "query_id", "left")
    parts = ["\n# VERIFIABLE FACT LEDGER (UFL) ROWS\n", F.coalesce("table", F.lit(NO_FACTS)), "\n\n# SOURCE TEXT CHUNKS\n", F.coalesce("texts", F.lit(NO_CHUNKS)), f"\n\n# INSTRUCTIONS FOR REASONING:\n{instructions}\n"]
    return joined.select("query_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("context"))
