"""All attacks on a record in their order, and evaluation sets in which each attacked record stands beside the one it came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import text
from factledger.operators.records import cascade, draw, logic_lie, neighbour_trap, ranked

# fixed values: what scale words become, and capitalised words that name nobody
SCALES = {"million": ("billion", "thousand"), "billion": ("million", "trillion"), "percent": ("basis points",), "usd": ("EUR", "GBP", "shares")}
NO_NAMES = (
    "The", "A", "An", "In", "On", "At", "By", "For", "To", "With", "As", "But",
    "Or", "And", "If", "When", "How", "Why", "What", "Which", "Who", "Where",
    "This", "That", "It", "They", "We", "He", "She", "These", "Those", "Some",
    "Any", "All", "Most", "Many", "January", "February", "March", "April",
    "May", "June", "July", "August", "September", "October", "November", "December",
    "Table", "Note", "Figure",
)
KINDS = ("logic", "numeric_neighbor_trap", "irrelevancy", "semantic_drift")


def names(content: Column) -> Column:
    """Distinct capitalised words (ASCII letters, three or more) that may name somebody, in code-point order."""
    found = F.regexp_extract_all(content, F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*NO_NAMES))))


def chosen(of: Column, key: Column, seed: str) -> Column:
    """One of an array's values by a record's hash; null for an empty array."""
    return F.get(of, draw(F.concat(key.cast("string"), F.lit(seed)), F.greatest(F.size(of), F.lit(1))))


def semantic(answer: Column, scale: Column, company: Column, context: Column, key: Column) -> Column:
    """An answer in another scale, where the record names one (appended if the answer doesn't say it; an unknown scale can't be attacked); or else with its
    company, or one of its names, exchanged for one that the context has. Null if there is none."""
    low = F.lower(F.nullif(scale, F.lit("")))
    other = F.coalesce(*(F.when(low == word, chosen(F.array(*map(F.lit, new)), key, "s")) for word, new in SCALES.items()))
    scaled = F.when(other.isNotNull(), F.coalesce(text.replace_first_word(answer, low, other), F.concat(answer, F.lit(" "), other)))
    known = F.coalesce(F.length(company) > 0, F.lit(False)) & F.coalesce(F.contains(answer, company), F.lit(False))
    target = F.when(known, company).otherwise(chosen(names(answer), key, "t"))
    new = chosen(F.filter(names(context), lambda w: w != target), key, "n")
    return F.when(low.isNotNull(), scaled).otherwise(F.when(target.isNotNull() & new.isNotNull(), text.replace_first_word(answer, target, new)))


def time_warp(query: Column, key: Column) -> Column:
    """A query with its first year (1900 to 2099) moved by one, up or down; null without a year."""
    year = F.regexp_extract(query, r"\b((?:19|20)\d{2})\b", 1)
    moved = F.nullif(year, F.lit("")).cast("int") + F.when(draw(key, 2) == 0, 1).otherwise(-1)
    return F.when(year != "", text.replace_first_word(query, year, moved.cast("string")))


def attack(records: DataFrame) -> DataFrame:
    """``records`` with ``attack``: struct<kind, field, text>, the first attack that succeeds and what it makes of one field; null if none does.

    Columns: id, query, answer, trace, context, scale, company, cells (see ``neighbour_trap``), distractor (a context of another source). A trace that is executable
    (it calls something and is no mere check) is attacked first, then a table cell; then irrelevancy (another year in the query, or else another context) and
    semantic drift, in either order by the record's hash. Nulls in any field rule out the attacks that need it.
    """
    r, key = {c: F.col(c) for c in records.columns}, F.col("id")
    field = lambda name, out: F.when(out.isNotNull(), F.struct(F.lit(name).alias("field"), out.alias("text")))
    executable = F.contains(r["trace"], F.lit("(")) & ~F.contains(r["trace"], F.lit("# VERIFICATION"))
    logic = field("trace", F.when(executable, logic_lie(r["trace"], r["context"], key)))
    numeric = field("answer", neighbour_trap(r["answer"], r["cells"]))
    off = F.coalesce(field("query", time_warp(r["query"], key)), field("context", r["distractor"]))
    drift = field("answer", semantic(r["answer"], r["scale"], r["company"], r["context"], key))
    first, second = cascade([(KINDS[2], off), (KINDS[3], drift)]), cascade([(KINDS[3], drift), (KINDS[2], off)])
    swapped = draw(F.concat(key.cast("string"), F.lit("order")), 2) == 1
    hit = F.coalesce(cascade([(KINDS[0], logic), (KINDS[1], numeric)]), F.when(swapped, second).otherwise(first))
    return records.withColumn("_hit", hit).withColumn("attack", F.when(F.col("_hit").isNotNull(), F.struct(F.col("_hit.kind").alias("kind"), F.col("_hit.text.field").alias("field"), F.col("_hit.text.text").alias("text")))).drop("_hit")


def contrast_set(rows: DataFrame, total: int, shares: tuple[float, float, float] = (0.4, 0.4, 0.2), mutated: float = 0.5, priority: Column | None = None) -> DataFrame:
    """An evaluation set of about ``total`` records from ``rows`` (id, label, parent; parent is null but for attacked records), with ``copy``.

    Unfounded: attacked records up to ``mutated`` of the quota, then natural ones, and attacked ones again where these run out. Supported: first the parents of the attacked
    records taken, then ``priority`` rows, both without a limit, and others up to the quota. General: as many as the quota, repeated in turn if there are fewer.
    All in order of the ids' hashes, numbered by prefix, so no task sorts a whole label; the driver sees five counts.
    """
    quota = dict(zip(("unfounded", "supported", "general"), (int(total * s) for s in shares), strict=True))
    h = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    label = F.lower(F.trim("label"))
    kind = F.when((label == "unfounded") & F.col("parent").isNotNull(), "attacked").otherwise(label)
    marked = rows.withColumn("_kind", kind).where(F.col("_kind").isin("attacked", "unfounded", "supported", "general"))
    numbered = ranked(marked.where("_kind <> 'supported'"), "_kind", h, "id", prefix=F.substring(h, 1, 3))
    n = {r["_kind"]: r["count"] for r in marked.groupBy("_kind").count().collect()}  # four at most
    have, natural, general = (n.get(k, 0) for k in ("attacked", "unfounded", "general"))
    taken = min(have, int(quota["unfounded"] * mutated))
    natural = min(natural, quota["unfounded"] - taken)
    taken = min(have, quota["unfounded"] - natural)
    attacked = numbered.where((F.col("_kind") == "attacked") & (F.col("rank") <= taken))
    parents = attacked.select(F.col("parent").alias("id")).distinct().withColumn("_parent", F.lit(True))
    first = F.coalesce("_parent", F.lit(False)) | (F.coalesce(priority, F.lit(False)) if priority is not None else F.lit(False))
    supported = marked.where("_kind = 'supported'").join(parents, "id", "left").withColumn("_first", first).drop("_parent")
    rest = max(0, quota["supported"] - supported.where("_first").count())
    filled = ranked(supported, "_first", h, "id", prefix=F.substring(h, 1, 3)).where(F.col("_first") | (F.col("rank") <= rest)).drop("_first")
    times, more = divmod(quota["general"], general) if general else (0, 0)
    copies = F.lit(times) + (F.col("rank") <= more).cast("int")
    copied = numbered.where("_kind = 'general'").withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    once = [attacked, numbered.where((F.col("_kind") == "unfounded") & (F.col("rank") <= natural)), filled.select(*numbered.columns)]
    return reduce(DataFrame.unionByName, [f.withColumn("copy", F.lit(0)) for f in once]).unionByName(copied).drop("_kind", "rank")
