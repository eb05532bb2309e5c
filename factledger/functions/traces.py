"""Calculations that come with answers, as text: programs and derivations made into traces, tables into markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger.functions.numeric import to_number

# fixed values: what a program's operations are called in a trace
SIGNS = (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/"), ("exp", "**"), ("greater", ">"), ("less", "<"))
TABLE_FUNCTIONS = (("table_sum", "sum"), ("table_average", "mean"), ("table_max", "max"), ("table_min", "min"))
# fixed values: constants are known by what they contain, the first that fits; so const_1000 is 100 and const_10 is 1
CONSTANTS = (("const_100", "100"), ("const_1", "1"), ("const_0", "0"))
NO_PROGRAM, NO_DERIVATION = "# NO_TRACE_AVAILABLE", "# NO_DERIVATION"
CALL = r"^([a-zA-Z0-9_]+)\((.*)\)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def number_text(text: Column) -> Column:
    """A number as written in a formula: ``10%`` is 0.1, ``(500)`` is -500, signs of currency and commas go, nothing is 0."""
    s = stripped(text)
    share = F.when(F.endswith(s, F.lit("%")), to_number(F.regexp_replace(s, "[%,]", "")) / 100).cast("string")
    signed = F.when(s.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s)
    return F.when(s == "", "0").otherwise(F.coalesce(share, F.regexp_replace(signed, "[,$€£]", "")))


def _operand(arg: Column) -> Column:
    s = F.coalesce(stripped(arg), F.lit(""))
    out = F.when(s.rlike(r"^#\d+$"), F.regexp_replace(s, "^#", "step_"))
    for part, value in CONSTANTS:
        out = out.when(F.contains(s, F.lit(part)), value)
    return out.otherwise(number_text(F.regexp_replace(s, "const_", "")))


def _step(call: Column, i: Column) -> Column:
    operation, args = F.regexp_extract(call, CALL, 1), F.split(F.regexp_extract(call, CALL, 2), ",")
    a, b = _operand(F.get(args, F.lit(0))), _operand(F.get(args, F.lit(1)))
    line = F.when(F.lit(False), "")
    for name, sign in SIGNS:
        line = line.when(operation == name, F.concat(a, F.lit(f" {sign} "), b))
    for name, function in TABLE_FUNCTIONS:
        line = line.when(operation == name, F.concat(F.lit(f"{function}([table_value("), a, F.lit("), table_value("), b, F.lit(")])")))
    return F.concat(F.lit("step_"), i.cast("string"), F.lit(" = "), line.otherwise(F.concat(operation, F.lit("("), a, F.lit(", "), b, F.lit(")"))))


def program_trace(program: Column) -> Column:
    """One assignment for each call of ``add(1, 2), divide(#0, const_100)``, then the last is printed; parts that are no calls are passed over."""
    parts = F.split(F.regexp_replace(program, r"\), ", ")|"), r"\|")
    calls = F.filter(F.transform(parts, stripped), lambda s: s.rlike(CALL))
    last = F.concat(F.lit("\nprint(step_"), (F.size(calls) - 1).cast("string"), F.lit(")"))
    return F.when(F.size(calls) > 0, F.concat(F.array_join(F.transform(calls, _step), "\n"), last)).otherwise(NO_PROGRAM)


def derivation_trace(derivation: Column) -> Column:
    """``1,204.5 - 10%`` as an assignment of its cleaned expression, and its print."""
    tokens = F.filter(F.transform(F.regexp_extract_all(derivation, F.lit(r"[-+*/()]|[^-+*/()]+"), F.lit(0)), stripped), lambda s: s != "")
    clean = F.transform(tokens, lambda s: F.when(s.rlike(r"^[-+*/()]$"), s).otherwise(number_text(s)))
    return F.when(F.coalesce(derivation, F.lit("")) != "", F.concat(F.lit("result = "), F.array_join(clean, " "), F.lit("\nprint(result)"))).otherwise(NO_DERIVATION)


def markdown(rows: Column) -> Column:
    """A table (array of rows of cells, the first is the header) in markdown; rows are filled up or cut to the header's width."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: stripped(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))
    header = F.get(clean, F.lit(0))
    width = F.size(header)
    rule = F.array_repeat(F.lit("---"), width)
    body = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)))
    return F.when(F.size(rows) > 0, F.concat(line(header), line(rule), F.array_join(body, ""))).otherwise("")
