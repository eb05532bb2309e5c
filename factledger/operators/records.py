"""Records of evaluation sets: one schema from several corpora, attacks, quotas, verdict rules and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import text
from factledger.functions.once import once
from factledger.functions.similarity import token_set
from factledger.operators import factory
from factledger.operators.ledger import first_of

# what scale and unit words become here, one of the alternatives by the record's hash; ``attacks.SCALES`` has the values that are fixed
DRIFT = (("million", ("billion", "thousand")), ("billion", ("million", "trillion")), ("percent", ("basis points", "dollars")), ("usd", ("eur",)))
SPAN_RATIO = 60  # fixed value: how like an error span has to be
POOLS = ("pairs_short", "pairs_long", "natural_fake", "natural_true", "axiom")


def filled(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def corpus(parts: list[DataFrame]) -> DataFrame:
    """Mapped corpora in one table; rows without a query or any context are left out."""
    return reduce(DataFrame.unionByName, parts).where((F.coalesce("query", F.lit("")) != "") & (F.size("context_chunks") > 0))


def mapped(rows: DataFrame, source: str, record: Column, query: Column, chunks: Column, answer: Column, label: Column) -> DataFrame:
    """A corpus in the common schema: id, dataset_source, label, query, context_chunks, target_sentence."""
    return rows.select(
        record.cast("string").alias("id"), F.lit(source).alias("dataset_source"), label.alias("label"), query.alias("query"),
        F.filter(chunks, lambda c: F.coalesce(F.trim(c), F.lit("")) != "").alias("context_chunks"), answer.alias("target_sentence"),
    )


def label_of(raw: Column) -> Column:
    """Supported or Unfounded by a corpus' own words; null for any other, which are dropped."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("not hallucination", "pass", "supported"), "Supported").when(low.isin("hallucination", "fail", "unfounded"), "Unfounded")


def company_of(metadata: Column, doc_name: Column, record: Column) -> Column:
    """A record's company: its metadata, the first part of its document's name, the ticker in its id, or nobody in particular."""
    ticker = F.regexp_extract(F.coalesce(record, F.lit("")), r"^[a-z]+_([A-Z]{1,5})/", 1)
    return F.coalesce(filled(metadata), filled(F.substring_index(doc_name, "_", 1)), filled(ticker), F.lit("Global_Entity"))


def canonical(candidates: DataFrame) -> DataFrame:
    """Label in title case and source in small letters, each from the first field that has one."""
    return candidates.withColumns({
        "label": F.initcap(filled(F.col("final_label"), F.col("teacher_label"), F.col("label"), F.lit("General"))),
        "dataset_source": F.lower(filled(F.col("dataset_source"), F.col("source"), F.lit("unknown"))),
        "family_id": family_of(F.col("parent_id"), F.col("original_id"), F.col("id")),
    })


def family_of(parent: Column, original: Column, record: Column) -> Column:
    return F.coalesce(filled(parent), filled(original), factory.family_id(record))


def validity(mode: Column, injected: Column, span: Column, label: Column, teacher: Column, kind: Column | None = None, reasoning: Column | None = None) -> Column:
    """Whether a teacher's verdict confirms a record, by its target's mode; false for any other mode and for nulls.

    strict_injection_match: unfounded, and the error span is like the injected value (a token-set ratio over 60) or the reasoning names it; attacks of an
    irrelevancy ``kind`` need no span. label_consistency: the same label. trust_teacher: unfounded. generate_only: always.
    """
    unfounded, value = F.initcap(teacher) == "Unfounded", F.lower(injected)
    like = F.coalesce(token_set(value, F.lower(span)) > SPAN_RATIO, F.lit(False))
    named = F.lit(False) if reasoning is None else F.coalesce(F.contains(F.lower(reasoning), value), F.lit(False))
    free = F.lit(False) if kind is None else F.coalesce(F.contains(kind, F.lit("irrelevancy")), F.lit(False))
    rules = F.when(mode == "strict_injection_match", unfounded & (free | like | named)).when(mode == "label_consistency", F.initcap(teacher) == F.initcap(label))
    return F.coalesce(rules.when(mode == "trust_teacher", unfounded).when(mode == "generate_only", F.lit(True)), F.lit(False))


def action(valid: Column, otherwise: Column) -> Column:
    """verified if valid; else review or verified where the target says so (review, keep), or discarded."""
    return F.when(valid, "verified").when(otherwise == "review", "review").when(otherwise == "keep", "verified").otherwise("discarded")


def review_queue(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows to look at: under review, or unjudged with an invalid attack; decided ones are left out."""
    open_ = (F.col("status") == "review") | (F.col("status").isNull() & (F.col("valid_sabotage") == False))  # noqa: E712
    return rows.where(F.coalesce(open_, F.lit(False))).join(decided.select("id"), "id", "left_anti")


def draw(key: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1 by a record's hash."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n).cast("int")


def drift(answer: Column, key: Column) -> Column:
    """The first known scale or unit word of an answer exchanged for one of its alternatives; a million is added where there is none."""
    out = F.concat(answer, F.lit(" million"))
    for word, choices in reversed(DRIFT):
        new = F.element_at(F.array(*map(F.lit, choices)), draw(key, len(choices)) + 1)
        out = F.when(text.has_word(answer, word), text.replace_first_word(answer, F.lit(word), new)).otherwise(out)
    return out


def neighbour_trap(answer: Column, cells: Column) -> Column:
    """An answer with its longest table cell (first of the longest) replaced, wherever it stands, by a neighbour that has a digit; null if none fits.

    ``cells`` is array<struct<cell, neighbours>>, neighbours in the order below, above, right.
    """
    usable = lambda c: F.filter(c["neighbours"], lambda n: n.isNotNull() & n.rlike(r"\d") & (n != c["cell"]))
    fits = F.filter(cells, lambda c: (F.length(c["cell"]) > 0) & F.contains(answer, c["cell"]) & (F.size(usable(c)) > 0))
    best = F.aggregate(fits, F.lit(None).cast("struct<cell: string, other: string>"), lambda b, c: F.when(b.isNull() | (F.length(c["cell"]) > F.length(b["cell"])), F.struct(c["cell"].alias("cell"), F.get(usable(c), F.lit(0)).alias("other"))).otherwise(b))
    return once(best, lambda b: F.when(b.isNotNull(), F.replace(answer, b["cell"], b["other"])))


def logic_lie(trace: Column, context: Column, key: Column) -> Column:
    """A trace with one of its numbers (not 0, 1 or 2) exchanged for one of the context that it doesn't have; null if there is none."""
    number = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"), F.lit(0))))
    old = F.filter(number(trace), lambda n: ~n.isin("0", "1", "2"))
    new = F.array_except(number(context), number(trace))
    a, b = F.get(old, draw(key, F.greatest(F.size(old), F.lit(1)))), F.get(new, draw(F.concat(key.cast("string"), F.lit("n")), F.greatest(F.size(new), F.lit(1))))
    at = F.regexp_instr(trace, F.concat(F.lit(r"(?<![\w.])\Q"), a, F.lit(r"\E(?![\w.])")))
    return F.when((F.size(old) > 0) & (F.size(new) > 0), F.concat(F.substring(trace, F.lit(1), at - 1), b, F.substring(trace, at + F.length(a), F.length(trace))))


def entity_swap(answer: Column, others: Column, key: Column) -> Column:
    """An answer with its first capitalised name exchanged for another of ``others``; null if there is none."""
    name = F.get(text.capitalised(answer), F.lit(0))
    new = F.filter(others, lambda o: o != name)
    return F.when(name.isNotNull() & (F.size(new) > 0), text.replace_first_word(answer, name, F.get(new, draw(key, F.greatest(F.size(new), F.lit(1))))))


def cascade(attacks: list[tuple[str, Column]]) -> Column:
    """struct<kind, text> of the first attack that succeeds; null if none does."""
    return F.coalesce(*(F.when(out.isNotNull(), F.struct(F.lit(kind).alias("kind"), out.alias("text"))) for kind, out in attacks))


def ranked(rows: DataFrame, per: str, *order: Column | str, prefix: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 within a group, in order of ``prefix`` and ``order``.

    Counts of prefixes are summed first and rows are numbered within their prefix, so no group is sorted by one task.
    """
    marked = rows.withColumn("_p", prefix)
    before = Window.partitionBy(per).orderBy("_p")
    counts = marked.groupBy(per, "_p").agg(F.count("*").alias("_c")).withColumn("_start", F.sum("_c").over(before) - F.col("_c")).drop("_c")
    inside = Window.partitionBy(per, "_p").orderBy(*order)
    return marked.withColumn("_i", F.row_number().over(inside)).join(counts, [per, "_p"]).withColumn("rank", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def balance(rows: DataFrame, total: int, shares: dict[str, float], mutated: float = 0.5) -> DataFrame:
    """``rows`` (id, label, mutated) cut to quotas: ``shares`` of ``total`` by label, in hash order.

    Of the unfounded ones ``mutated`` at least are mutated where there are so many, and natural ones fill up. A label with fewer rows gives what it
    has, and nothing is said of parents: ``attacks.contrast_set`` puts these first and repeats what is missing.
    """
    h = F.md5(F.col("id").cast("string"))
    first = ranked(rows.withColumn("_side", F.concat_ws("/", "label", F.col("mutated").cast("string"))), "_side", h, "id", prefix=F.substring(h, 1, 3))
    sizes = {(r["label"], r["mutated"]): r["count"] for r in rows.groupBy("label", "mutated").count().collect()}  # two for each label
    take = {}
    for label, share in shares.items():
        quota = int(total * share)
        have, natural = sizes.get((label, True), 0), sizes.get((label, False), 0)
        m = min(have, max(int(quota * mutated), quota - natural)) if label == "Unfounded" else min(have, quota)
        take[label, True], take[label, False] = m, min(natural, quota - m)
    keep = reduce(lambda a, b: a | b, ((F.col("label") == label) & (F.col("mutated") == flag) & (F.col("rank") <= n) for (label, flag), n in take.items()))
    return first.where(keep).drop("_side", "rank")


def other_source(records: DataFrame) -> DataFrame:
    """id, distractor: for each record one of another source, by hashes; only a table of one source gives none.

    Every source names the record with its smallest hash in each of 4,096 hash buckets. A record takes that of the next source
    in its bucket (in order of name, from the first after the last), or else the first one of any other source.
    """
    h = F.md5(F.col("id").cast("string"))
    marked = records.select("id", "source", F.substring(h, 1, 3).alias("bucket"), h.alias("h"))
    heads = marked.groupBy("bucket", "source").agg(F.min(F.struct("h", "id")).alias("m")).select("bucket", F.col("source").alias("other"), F.col("m.id").alias("distractor"))
    order = Window.partitionBy("bucket").orderBy("other")
    first = heads.withColumn("_f", F.first("other").over(order)).withColumn("_fd", F.first("distractor").over(order))
    nexts = first.select("bucket", F.col("other").alias("source"), F.coalesce(F.lead("other").over(order), "_f").alias("other"), F.coalesce(F.lead("distractor").over(order), "_fd").alias("distractor"))
    paired = marked.join(nexts, ["bucket", "source"]).withColumn("distractor", F.when(F.col("other") != F.col("source"), F.col("distractor")))
    by_source = heads.groupBy("other").agg(F.min("distractor").alias("any"))
    two = by_source.orderBy("other").limit(2)  # the first source's for all others, the second's for the first
    fallback = two.agg(F.min(F.struct("other", "any")).alias("a"), F.max(F.struct("other", "any")).alias("b"))
    joined = paired.join(F.broadcast(fallback), F.lit(True), "left")  # one row
    spare = F.when(F.col("a.other") != F.col("source"), F.col("a.any")).when(F.col("b.other") != F.col("source"), F.col("b.any"))
    return joined.select("id", F.coalesce("distractor", spare).alias("distractor")).where("distractor IS NOT NULL")


def manifest(members: DataFrame) -> DataFrame:
    """members (family, pool, role, id) with dense row numbers from 0: pools in their fixed order, then families, a parent before
    its child; of several parents or children of a family the first stays.

    Numbers are prefix sums over (pool, family hash): no task numbers all rows.
    """
    first = first_of(members, ["family", "role"], "id")
    order = F.create_map(*(F.lit(x) for k, p in enumerate(POOLS) for x in (p, k)))
    h = F.md5(F.col("family").cast("string"))
    keyed = first.withColumn("_pool", F.try_element_at(order, F.col("pool"))).where("_pool IS NOT NULL")
    keyed = keyed.withColumns({"_k": F.format_string("%d/%s", "_pool", F.substring(h, 1, 3)), "_h": h, "_role": F.when(F.col("role") == "parent", 0).otherwise(1)})
    counts = keyed.groupBy("_k").agg(F.count("*").alias("_c"))  # 4,096 for each pool
    starts = counts.withColumn("_start", F.sum("_c").over(Window.orderBy("_k")) - F.col("_c")).drop("_c")
    inside = Window.partitionBy("_k").orderBy("_h", "family", "_role")
    placed = keyed.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(starts), "_k")
    return placed.select((F.col("_start") + F.col("_i") - 1).alias("row_id"), "family", "pool", "role", "id")
