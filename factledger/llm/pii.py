r"""Personal data by patterns, and information-theoretic sanitisation of what gives it away; SQL expressions only.

Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping for each
kind. Their values are the protected entities.

Terms: the whole words within ``WINDOW`` code points of an entity are its context. Everything is counted in distinct texts,
so copies of a document prove nothing. Over the corpus, a term t discloses an entity e as far as pointwise mutual information
PMI(e; t) = log2(p(e | t) / p(e)) comes near to the entity's own information IC(e) = -log2 p(e). p(e | t) is smoothed: as if
``prior`` more texts with the term had been seen in which the entity is as frequent as anywhere. So rare entities count too,
and the fewer texts speak for a term, the less it proves. A term with PMI >= ``share`` * IC is marked beside the entity, with
the kind ``term``, unless it overlaps a base span.

Defined results: null texts are empty; null doc_ids and repeated rows are handled row by row; a very long text is searched whole,
in time linear in its length and spans; spans that start together go by their end, then by kind; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds the same leftmost matches as its plain form. A possessive repeat never backtracks, and a match can only
# start where no character of its first run stands before, or where the last match ended (\G): so long runs cost linear time.
LOCAL, LABEL = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter sequences are no cards, and longer ones are tried whole
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
WORD = r"\p{L}{3,}"
WINDOW, PIECE, CHUNK = 64, 128, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often a function of array elements asks for it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> in code points, end exclusive.

    Places are running sums. An array that is appended to is copied each time, so the sums go by pieces of ``PIECE`` matches:
    first the length of each piece, then the places inside, which is linear in the matches.
    """
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    size = lambda x: F.length(x["g"]) + F.length(x["m"])

    def inside(piece: Column, begin: Column) -> Column:
        span = lambda at, x: F.struct((at + F.length(x["g"])).alias("start"), (at + size(x)).alias("end"), x["m"].alias("value"))
        step = lambda done, x: F.struct((done["at"] + size(x)).alias("at"), F.array_append(done["spans"], span(done["at"], x)).alias("spans"))
        return F.aggregate(piece, F.struct(begin.alias("at"), empty.alias("spans")), step, lambda done: done["spans"])

    def places(zipped: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / PIECE).cast("int")), lambda i: F.slice(zipped, i * PIECE + 1, F.lit(PIECE)))
        sums = lambda ps: F.transform(ps, lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + size(x)))
        begins = lambda ps: F.aggregate(sums(ps), F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
        return F.when(F.size(zipped) == 0, empty).otherwise(let(pieces, lambda ps: let(begins(ps), lambda bs: F.flatten(F.zip_with(ps, F.slice(bs, F.lit(1), F.size(ps)), inside)))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: let(F.arrays_zip(m.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("g")), places))


def luhn(digits: Column) -> Column:
    """Whether the digits' weighted sum is a multiple of ten."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, k: s
        + F.when(
            (F.length(digits) - k) % 2 == 1,
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, k, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substring(digits, k, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(F.substring(digits, 1, 19))
    return F.length(digits).between(9, 15)


def _with_context(kind: str, chunks: Column) -> Column:
    """Valid spans, with the words around them; a character more on each side shows which words are cut."""
    after = lambda s: _part(chunks, s["end"], F.lit(WINDOW + 2))
    before = lambda s: _part(chunks, F.greatest(s["start"] - WINDOW, F.lit(1)), F.least(s["start"], F.lit(WINDOW + 1)) + 1)
    first = lambda s: F.greatest(s["start"] - WINDOW - 1, F.lit(0))
    return F.transform(
        F.filter(f"_{kind}", lambda s: valid(kind, s["value"])),
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.concat(
                _words(before(s), first(s), F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"]),
                _words(after(s), s["end"] - 1, s["end"], s["end"] + WINDOW),
            ).alias("words"),
        ),
    )


def _part(chunks: Column, start: Column, length: Column) -> Column:
    """A short part of the text from a place (from 1), by way of its chunks: places in a long text are slow to walk to."""
    chunk = F.floor((start - 1) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, chunk + 1, F.lit(2)), ""), start - chunk * CHUNK, length)


def _words(part: Column, offset: Column, low: Column, high: Column) -> Column:
    """array<struct<term, start, end>>: words of a part of the text from ``offset`` that lie between ``low`` and ``high``."""
    placed = F.transform(matches(part, WORD), lambda m: F.struct(F.lower(m["value"]).alias("term"), (m["start"] + offset).alias("start"), (m["end"] + offset).alias("end")))
    return F.filter(placed, lambda w: (w["start"] >= low) & (w["end"] <= high))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _t, the text, and _key, which equal texts share."""
    rows = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    return rows.withColumn("_key", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)))


def base_spans(docs: DataFrame) -> DataFrame:
    """_key, _t and base (array of kind, start, end, value, words) for each distinct text that has spans, written."""
    gates = {"email": F.contains("_t", F.lit("@")), "ip": F.contains("_t", F.lit(".")), "card": F.lit(True), "phone": F.contains("_t", F.lit("+"))}
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")
    rows = keyed(docs.select("text")).select("_t", "_key")
    rows = rows.withColumns({f"_{k}": F.when(gates[k], matches(F.col("_t"), PATTERNS[k])).otherwise(none) for k in KINDS})
    found = rows.where(" OR ".join(f"size(_{k}) > 0" for k in KINDS))
    chunks = F.regexp_extract_all("_t", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    spans = let(chunks, lambda c: F.concat(*(_with_context(kind, c) for kind in KINDS)))
    return cut(found.select("_key", "_t", spans.alias("base")).where("size(base) > 0").dropDuplicates(["_key"]), "pii")


def disclosing(docs: DataFrame, occurrences: DataFrame, share: float, prior: float) -> DataFrame:
    """entity, term: what exceeds the disclosure threshold. ``occurrences`` has _key, entity and words."""
    sizes = occurrences.select("_key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = (
        occurrences.select("_key", "entity", F.explode("words.term").alias("term")).distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    )
    pairs = cut(pairs.join(sizes, "entity"), "pii-pairs")
    if pairs.isEmpty():  # no entity has a word beside it: the corpus need not be counted
        return pairs.select("entity", "term")
    texts = keyed(docs.select("text")).select("_key", "_t").dropDuplicates(["_key"])
    each = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), F.lower))).alias("term"))
    # counted first and joined then: a semi-join would be pushed below the count and see every occurrence of common terms
    frequency = each.groupBy("term").agg(F.count("*").alias("n_t")).join(pairs.select("term").distinct(), "term")
    total = float(keyed(docs.select("text")).select("_key").distinct().count())
    p_e = F.col("n_e") / total
    p_e_t = (F.col("n_et") + prior * p_e) / (F.col("n_t") + prior)
    enough = F.log2(p_e_t / p_e) >= share * -F.log2(p_e)
    return cut(pairs.join(frequency, "term").where(F.col("n_e") < total).where(enough).select("entity", "term"), "pii-terms")


def find(docs: DataFrame, share: float = 0.8, prior: float = 1.0) -> DataFrame:
    """doc_id, base and terms (arrays of kind, start, end), and the sanitised text, its length and digest for each row of ``docs`` (doc_id, text).

    Length and digest are worked out before rows meet their spans, so without ``sanitised`` no text is moved for them.
    """
    found = base_spans(docs)
    occurrences = found.select("_key", F.explode("base").alias("s")).select("_key", F.concat_ws(":", "s.kind", F.lower("s.value")).alias("entity"), "s.words")
    risky = disclosing(docs, occurrences, share, prior)
    near = (
        occurrences.select("_key", "entity", F.explode("words").alias("w"))
        .select("_key", "entity", "w.term", "w.start", "w.end")
        .join(risky, ["entity", "term"], "left_semi")
        .select("_key", "start", "end")
        .distinct()
    )
    terms = near.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    # written, so that the last join may deal a text with many copies to several tasks; only texts with spans are cut up, each once
    spans = found.select("_key", "_t", base.alias("base")).join(terms, "_key", "left").select("_key", "_t", "base", F.coalesce(apart, none).alias("terms"))
    spans = cut(spans.select("_key", "base", "terms", sanitised(F.col("_t"), F.concat("base", "terms")).alias("_s")), "pii-spans")
    spans = spans.withColumns({"_n": F.length("_s"), "_h": F.sha2("_s", 256)})
    rows = keyed(docs.select("doc_id", "text")).withColumns({"_len": F.length("_t"), "_own": F.lower(F.hex("_key"))}).join(spans, "_key", "left")
    return rows.select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"), F.coalesce("_s", "_t").alias("sanitised"),
        F.coalesce("_n", "_len").alias("sanitised_chars"), F.coalesce("_h", "_own").alias("sanitised_sha256"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans go whole, under the kind of the first.

    The text is cut by its sorted spans once: what is kept between them is taken from its chunks, so the work grows with the text and the spans.
    """
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(c: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        held = F.array_join(F.slice(c, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * CHUNK + 1, end - start)).otherwise("")

    def whole(c: Column, zipped: Column) -> Column:
        # a span that starts behind all before it begins a gap's end; ``b`` is where the spans before it end
        opening = F.filter(zipped, lambda z: z["s"]["start"] >= z["b"])
        out = F.transform(opening, lambda z: F.concat(between(c, z["b"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]")))
        last = F.array_max(F.transform(zipped, lambda z: z["s"]["end"]))
        return F.concat(F.array_join(out, ""), between(c, last, F.length(text)))

    cut_up = let(in_order, lambda s: let(F.arrays_zip(s.alias("s"), _ends_before(s).alias("b")), lambda z: let(chunks, lambda c: whole(c, z))))
    return F.when(F.size(spans) == 0, text).otherwise(cut_up)


def _ends_before(spans: Column) -> Column:
    """For each span the largest end of those before it, 0 for the first; running maxima by pieces, as the places in ``matches``."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / PIECE).cast("int")), lambda i: F.slice(spans, i * PIECE + 1, F.lit(PIECE)))
    tops = lambda ps: F.transform(ps, lambda p: F.array_max(F.transform(p, lambda x: x["end"])))
    begins = lambda ps: F.aggregate(tops(ps), F.array(F.lit(0)), lambda done, n: F.array_append(done, F.greatest(F.element_at(done, -1), n)))

    def inside(piece: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(piece, start, lambda d, x: F.struct(F.greatest(d["at"], x["end"]).alias("at"), F.array_append(d["out"], d["at"]).alias("out")), lambda d: d["out"])

    return let(pieces, lambda ps: let(begins(ps), lambda bs: F.flatten(F.zip_with(ps, F.slice(bs, F.lit(1), F.size(ps)), inside))))
