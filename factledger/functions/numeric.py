"""Numbers in cells and answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger.functions.once import once

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DASHES = ("—", "-", "–")


def to_number(text: Column) -> Column:
    """A double, or null where the text is no plain number (no type suffixes, no words)."""
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).cast("double"))


def parse_cell(cell: Column) -> Column:
    """struct<value, nuance>: dashes are zero, parentheses negate, footnotes and trailing letters go."""
    s = F.trim(F.replace(F.trim(cell), F.lit("&nbsp;"), F.lit(" ")))
    dash = s.isin(*DASHES)
    negative = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    inner = F.when(negative, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    inner = F.regexp_replace(inner, r"\s*\([0-9]+\w*\)", "")
    inner = F.regexp_replace(inner, "([0-9])[a-z]$", "$1")
    inner = F.trim(F.regexp_replace(inner, "[,$]", ""))
    value = to_number(F.when(negative, F.concat(F.lit("-"), inner)).otherwise(inner))
    nuance = F.when(negative & value.isNotNull(), "Negative (parentheses)")
    return F.struct(
        F.when(dash, 0.0).otherwise(value).alias("value"), F.when(dash, "Dash treated as zero").otherwise(nuance).alias("nuance")
    )


def scale_of(context: Column) -> Column:
    lowered = F.lower(context)
    return (
        F.when(F.contains(lowered, F.lit("millions")), 1e6)
        .when(F.contains(lowered, F.lit("thousands")) | F.contains(lowered, F.lit("000s")), 1e3)
        .otherwise(1.0)
    )


def unit_of(metric: Column) -> Column:
    """Unit of a metric by its name; all but USD ignore the table's scale."""
    has = lambda *words: F.lower(metric).rlike("|".join(words))
    return F.when(has("per share", "eps"), "USD/Share").when(has("ratio", "percentage", "margin"), "Ratio").otherwise("USD")


def is_noise(metric: Column) -> Column:
    """Metric names without an ASCII letter, or that are numbers."""
    return ~metric.rlike("[a-zA-Z]") | to_number(metric).isNotNull()


def close(gold: Column, answer: Column) -> Column:
    """Equal within half a percent, or within 0.015 of zero."""
    return F.when(gold == 0, F.abs(answer) <= 0.015).otherwise(F.abs(gold - answer) <= 0.005 * F.abs(gold))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raised, lambda x: x / total)


def posterior_mean(hits: Column, n: Column, a: float = 1e-6, b: float = 1.0) -> Column:
    return (F.lit(a) + hits) / (F.lit(a) + F.lit(b) + n)


# fixed values: what a suffix multiplies by
SCALES = {"million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "t": 1e12}
SCALED_NUMBER = rf"(-?\d+\.?\d*)(?![.\d])\s*({'|'.join(sorted(SCALES, key=len, reverse=True))})?\b"


def canonical(value: Column) -> Column:
    """A number as text: whole ones without a point, others with four decimals."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.4f", value))


def number_values(text: Column) -> Column:
    """Distinct values of the numbers in a text, as they stand and multiplied by their suffix; money signs, commas and % go."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "$%,", "  ")
    found = once(plain, lambda p: F.arrays_zip(F.regexp_extract_all(p, F.lit(SCALED_NUMBER), F.lit(1)).alias("n"), F.regexp_extract_all(p, F.lit(SCALED_NUMBER), F.lit(2)).alias("s")))
    by = F.create_map(*(F.lit(x) for pair in SCALES.items() for x in pair))
    both = F.transform(found, lambda x: F.array(x["n"].cast("double"), x["n"].cast("double") * F.coalesce(F.try_element_at(by, x["s"]), F.lit(1.0))))
    return F.array_distinct(F.flatten(both))


def number_set(text: Column) -> Column:
    """The same as sorted canonical texts."""
    return F.array_sort(F.array_distinct(F.transform(number_values(text), canonical)))


def values_match(gold: Column, answer: Column) -> Column:
    """Within half a percent (0.015 where the gold value is zero), or within one percent after a factor of a hundred either way."""
    near = lambda g, p, of, share: F.abs(g - p) / F.abs(of) <= share
    scaled = near(gold, answer, gold, 0.005) | near(gold * 100, answer, gold * 100, 0.01) | near(gold, answer * 100, gold, 0.01)
    return F.when(gold == 0, F.abs(gold - answer) < 0.015).otherwise(scaled)


def clean_number(text: Column) -> Column:
    """A double from ``10%`` (0.1), ``(500)`` (-500), ``$1,200``; null where nothing numeric is left."""
    s = F.regexp_replace(F.trim(text), "[,$€£\\s]", "")
    negative, percent = s.rlike(r"^\(.*\)$"), F.endswith(F.regexp_replace(s, r"[()]", ""), F.lit("%"))
    value = to_number(F.regexp_replace(s, "[()%]", ""))
    value = F.when(percent, value / 100).otherwise(value)
    return F.when(negative, -value).otherwise(value)


def result_text(value: Column) -> Column:
    """Whole numbers as integers, others with two decimals at most."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(F.round(value, 2).cast("string"))


def derivable_from(target: Column, values: Column, share: float = 0.01) -> Column:
    """Whether a number comes from two of ``values``: sum, difference, change in percent, share in percent, or ratio."""

    def found(given: Column) -> Column:
        n, most, places = given["n"], given["most"], given["places"]
        near = lambda x: F.abs(x - n) <= most
        percent = lambda x, y: near(F.try_divide(x - y, F.abs(y)) * 100) | near(F.try_divide(x, y) * 100) | near(F.try_divide(x, y))
        ways = lambda x, y: F.coalesce(near(x + y) | near(x - y) | F.coalesce(percent(x, y), F.lit(False)), F.lit(False))
        return F.exists(places, lambda a: F.exists(places, lambda b: (a["i"] != b["i"]) & ways(a["v"], b["v"])))

    places = F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    most = F.greatest(F.abs(target) * share, F.lit(0.01))
    return F.when(F.size(values) < 2, F.lit(False)).otherwise(once(F.struct(target.alias("n"), most.alias("most"), places.alias("places")), found))
