"""From documents to blocks and facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import numeric, text

# fixed values: signs of cover pages and forms, and of financial substance
SECTION_SIGNALS = (
    "indicate by check mark", "check mark whether", "large accelerated filer", "accelerated filer", "emerging growth company", "smaller reporting company",
    "shell company", "registrant's telephone", "exchange act", "incorporated by reference",
)
ONLY_URLS = r"(?i)^(https?://\S+\s*)+$"
ONLY_TIME = r"(?i)^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*,\s*\d{1,2}:\d{2}\s*(AM|PM)(\s+\S+)?\s*$"
SUBSTANCE = (
    r"(?i)\$[\d,]|\brevenue\b|\bsales\b|net income|gross profit|\bloss\b|operating expense|capital expenditure|\basset\b|liabilit|stockholder|shareholder"
    r"|\bequity\b|long.term debt|short.term debt|\bcash\b|\bdividend\b|earnings per share|\bmargin\b|goodwill|amortiz|depreciat|impairment|\bprincipal\b"
)


def is_boilerplate(content: Column, section: Column) -> Column:
    """Whether a block can hold no fact; any financial sign saves it."""
    stripped = F.trim(content)
    boxes = F.length(F.regexp_replace(content, "[^☒☐✓✗]", ""))
    signal = F.exists(F.array(*map(F.lit, SECTION_SIGNALS)), lambda s: F.contains(F.lower(section), s))
    return ~content.rlike(SUBSTANCE) & (signal | stripped.rlike(ONLY_URLS) | stripped.rlike(ONLY_TIME) | (boxes >= 2) | (F.length(stripped) < 10))


def lines(docs: DataFrame) -> DataFrame:
    """id, seq, line for each line of (id, text)."""
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


def segment(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive lines of one type, table or text; blank lines belong to the block before."""
    order = Window.partitionBy("id").orderBy("seq")
    kind = F.when(F.contains("line", F.lit("|")), "TABLE").when(F.trim("line") != "", "TEXT")
    typed = rows.withColumn("kind", F.coalesce(F.last(kind, ignorenulls=True).over(order), F.lit("TEXT")))
    turned = typed.withColumn("_new", (~F.col("kind").eqNullSafe(F.lag("kind").over(order))).cast("int"))
    numbered = turned.withColumn("block", F.sum("_new").over(order))
    return numbered.groupBy("id", "block", "kind").agg(
        F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("content")
    )


def with_previous(rows: DataFrame, per: str, order: str, size: int = 300) -> DataFrame:
    """``rows`` with the last ``size`` characters of the text before as a prefix."""
    before = F.lag(F.right("text", F.lit(size))).over(Window.partitionBy(per).orderBy(order))
    return rows.withColumn("content", F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.lit("[Previous Context: "), before, F.lit("]\n\n"), F.col("text"))))


def header_path(headers: Column) -> Column:
    """Path after each header of array<struct<level, title>>: the stack is cut above the level and the title pushed.

    A level that skips some stays on the stack of its parent, and later cuts count entries, not levels.
    """
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))
    return F.aggregate(
        headers,
        start,
        lambda s, h: F.struct(
            F.concat(F.slice(s["stack"], 1, h["level"] - 1), F.array(h["title"])).alias("stack"),
            F.array_append(s["paths"], F.array_join(F.concat(F.slice(s["stack"], 1, h["level"] - 1), F.array(h["title"])), " > ")).alias("paths"),
        ),
        lambda s: s["paths"],
    )


def cells(tables: DataFrame) -> DataFrame:
    """id, row, column, cell for each cell of pipe tables (id, content); rule lines are skipped."""
    rows = tables.select("id", F.posexplode(F.split("content", "\n")).alias("row", "line")).where(F.contains("line", F.lit("|")) & ~F.contains("line", F.lit("---")))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return rows.select("id", "row", F.posexplode(F.split(inner, r"\|")).alias("column", "raw")).select("id", "row", "column", F.trim("raw").alias("cell"))


def melt(grid: DataFrame, context: Column) -> DataFrame:
    """Facts of tables: header row 0 names the periods, column 0 the metrics; values are parsed and scaled."""
    header = grid.where("row = 0 AND column > 0").select("id", "column", F.col("cell").alias("period"))
    label = grid.where("row > 0 AND column = 0").select("id", "row", F.trim(F.regexp_replace("cell", r"\s*\(\w+\)", "")).alias("metric_name"))
    body = grid.where("row > 0 AND column > 0").join(header, ["id", "column"]).join(label, ["id", "row"]).where("metric_name <> ''")
    parsed = body.withColumn("p", numeric.parse_cell(F.col("cell"))).withColumn("unit", numeric.unit_of(F.col("metric_name")))
    placeholder = F.lower("cell").isin("n/a", "—", "-", "nan", "")
    kept = parsed.where(F.col("p.value").isNotNull() | placeholder | F.col("period").rlike("20[0-9]{2}"))
    scale = F.when(F.col("unit") == "USD", numeric.scale_of(context)).otherwise(1.0)
    restated = F.contains(F.lower("period"), F.lit("restated"))
    nuance = F.when(restated & F.col("p.nuance").isNotNull(), F.concat("p.nuance", F.lit(" (Restated)"))).when(restated, "Restated").otherwise(F.col("p.nuance"))
    return kept.select(
        "id", "metric_name", (F.col("p.value") * scale).alias("num_value"), "unit", scale.alias("scale"),
        F.nullif(F.regexp_extract("period", "((?:19|20)[0-9]{2})", 1), F.lit("")).alias("period_end"), nuance.alias("nuance"),
    )


SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def quote_key(quote: str) -> tuple[int, int, str]:
    """(words, characters, key) that every text with the quote has, whatever stands around it: the quote's inner words (up to six), since its first and last
    may be parts of words; of a quote of one or two words, the first four characters at most of the longer one; nothing of a quote without words."""
    words = SPACES.split(quote.strip(" \t\n\x0b\f\r"))
    if len(words) > 2:
        inner = words[1:-1][:6]
        return len(inner), 0, " ".join(inner)
    piece = max(words, key=len)[:4]
    return 0, len(piece), piece


def text_keys(text: str, kinds: list[tuple[int, int]], wanted: set[str] | None) -> list[str]:
    """The keys of these kinds (words, characters) that a text has, each once; only the ``wanted`` ones if there are any given."""
    out, words = set(), SPACES.split(text)
    for n, chars in kinds:
        if n:
            starts = range(len(words) - n + 1)
            out.update(" ".join(words[i : i + n]) for i in starts)
        else:
            out.update(text[i : i + chars] for i in range(len(text) - chars + 1))
        if wanted is not None:
            out &= wanted
    return list(out)


def align(items: DataFrame, docs: DataFrame, collapsed: bool = False, most_sent: int = 50_000) -> DataFrame:
    """item_id, doc_id, position for each row of items (item_id, text) that stands word for word in a row of docs (doc_id, text).

    With ``collapsed``, items that are not found so are looked for with white space collapsed (see ``exact_position``).
    Both sides meet on ``quote_key``, however short an item is, so a document meets only items that it may hold. The keys of up to ``most_sent`` items are sent to
    the tasks and looked up where a text is read; more are joined by their keys. Only an item without any word meets every document: an empty one is in all of them.
    """
    spark = docs.sparkSession
    quotes = items.where("text IS NOT NULL").groupBy("item_id", F.col("text").alias("quote")).agg(F.count("*").alias("_copies"))
    keyed = F.pandas_udf(lambda q: pd.DataFrame(q.map(quote_key).tolist(), columns=["n", "c", "key"]), "n int, c int, key string")
    quotes = quotes.withColumn("_k", keyed("quote")).select("item_id", "quote", "_copies", "_k.*")
    kinds = [(r["n"], r["c"]) for r in quotes.select("n", "c").distinct().collect()]  # eleven at most
    sent = [r["key"] for r in quotes.select("key").distinct().limit(most_sent + 1).collect()]
    few = len(sent) <= most_sent
    wanted = spark.sparkContext.broadcast(set(sent)) if few else None
    keys_of = F.pandas_udf(lambda t: t.map(lambda x: text_keys(x, kinds, wanted.value if few else None)), "array<string>")
    texts = docs.where("text IS NOT NULL").withColumn("_text", F.unhex(F.md5("text")))
    met = texts.select("_text", F.explode(keys_of("text")).alias("key"))
    where = text.exact_position(F.col("text"), F.col("quote")) if collapsed else F.instr("text", F.col("quote")) - 1
    pairs = met.join(quotes.select("key", "item_id", "quote", "_copies"), "key").select("_text", "item_id", "quote", "_copies").distinct().join(texts, "_text")
    placed = pairs.withColumn("position", where.cast("long")).where("position >= 0")
    return placed.select("item_id", "doc_id", "position", F.explode(F.array_repeat("position", F.col("_copies").cast("int"))).alias("_")).drop("_")


def pack(docs: DataFrame, per: str, budget: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Documents (id, size) taken in ``order`` while they fit the group's budget; one that doesn't fit is skipped and later ones may.

    Documents larger than the budget never fit and aren't walked. Skipping makes this a fold, so a group is walked by one task; it holds a running sum and no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, left = (), 0
        for rows in batches:
            taken = []
            for name, size in zip(rows[per], rows["size"], strict=True):
                name = (None if pd.isna(name) else name,)
                if name != group:
                    group, left = name, budget
                fits = size <= left
                left -= size if fits else 0
                taken.append(fits)
            yield rows.assign(taken=taken)

    walked = docs.select(*dict.fromkeys([per, "id", "size", *order]))
    kinds = ", ".join(f"{n} {t}" for n, t in walked.dtypes)
    large = walked.where(F.col("size") > budget).withColumn("taken", F.lit(False))
    fit = walked.where(~F.coalesce(F.col("size") > budget, F.lit(False)))
    return fit.repartition(per).sortWithinPartitions(per, *order).mapInPandas(run, f"{kinds}, taken boolean").unionByName(large)


def pack_done_first(docs: DataFrame, per: str, budget: int) -> DataFrame:
    """``docs`` (id, size, done) packed in two passes: what is done already costs nothing more and goes first, in order of id; then the others in order of their hash."""
    turn = {"_last": (~F.coalesce("done", F.lit(False))).cast("int"), "_draw": F.when(F.coalesce("done", F.lit(False)), "").otherwise(F.md5(F.col("id").cast("string")))}
    return pack(docs.withColumns(turn), per, budget, ("_last", "_draw", "id")).select(per, "id", "size", "taken")
