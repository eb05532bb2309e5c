import difflib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factledger import plans
from factledger.functions import numeric, similarity, text
from factledger.operators import evaluation, grounding


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    found = value(spark, numeric.number_set(F.lit("12.0 million and $1,234.5 vs 1.2.3, 7mx 3b -4%")))
    assert found == ["-4", "12", "12000000", "1234.5000", "2.3000", "3", "3000000000"]
    assert [value(spark, numeric.clean_number(F.lit(s))) for s in ("10%", "(500)", "$1,200", "x", "(5%)")] == [0.1, -500.0, 1200.0, None, -0.05]
    assert [value(spark, numeric.result_text(F.lit(x))) for x in (5.0, 2.346)] == ["5", "2.35"]


def test_exact_match(spark):
    right = lambda said, gold, label="Supported", lookup=False: value(spark, evaluation.exact_match(F.lit(said), F.lit(gold), F.lit(label), F.lit(lookup)))
    assert right("It is 12 million.", "12") and right("0.25", "25%") and right("the big dog", "big dog") and right("about 100.4", "100") and right("0.01", "0")
    assert not right("13", "12") and not right("", "12") and not right("small cat", "big dog") and not right("0.02", "0")
    assert right("There is no data.", "5", "Unfounded") and not right("5", "5", "Unfounded") and right("Acme Corp (Source: p. 3).", "Acme Corp (2020)", lookup=True)


def test_fuzzy_interval_against_all_windows():
    source = "In 2023 the company paid its many employees a bonus of some thousand dollars each, and it said that it would do so again in the years to come."
    places = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|\S", source)]

    def slow(quote):
        asked, best, where = Counter(w.lower() for w in re.findall(r"\w+|\S", quote)), 0.0, None
        n = min(max(sum(asked.values()), 20), len(places))
        for i in range(len(places) - n + 1):
            window = Counter(w.lower() for w, _, _ in places[i : i + n])
            if sum((asked & window).values()) >= 0.55 * sum(asked.values()):
                blocks = difflib.SequenceMatcher(None, quote, " ".join(w for w, _, _ in places[i : i + n]), autojunk=False).get_matching_blocks()
                recall = sum(b.size for b in blocks) / len(quote)
                if recall > best:
                    best, where = recall, (places[i][1], places[i + n - 1][2])
        return where if best >= 0.85 else None

    quotes = ["company payed its many employees a bonus", "said that they would do so again", "nothing like it here at all", "", source, "thousand dolars each , and it said"]
    assert [grounding.fuzzy_interval(q, source) for q in quotes] == [slow(q) if q else None for q in quotes] and slow(quotes[0])


def test_text_helpers(spark):
    assert value(spark, text.partial_position(F.lit("a 1,200.5 b"), F.lit("x 12 and 1,200.5"))) == 2 and value(spark, text.partial_position(F.lit("a"), F.lit("b"))) == -1
    assert value(spark, text.semantic_support(F.lit("Net Revenues total"), F.lit("the revenue of I.R.S."))) == 1.0 and value(spark, text.semantic_support(F.lit("net total"), F.lit("x"))) is None
    assert tuple(value(spark, text.split_previous(F.lit("[Previous Context: ab]\n\ncd")))) == ("ab", "cd") and tuple(value(spark, text.split_previous(F.lit("cd")))) == ("", "cd")
    assert value(spark, text.shortened(F.lit("word " * 40))) == ("word " * 24).strip() and value(spark, text.shortened(F.lit("x" * 150))) == "x" * 120
    assert [value(spark, text.table_kind(F.lit(x))) for x in ("| a |\n|---|", "a,b,c\n1,2,3", "a\tb\tc", "1 2\n3 4\n5 6", "words")] == ["pipe", "csv", "tsv", "numeric", None]
    assert [value(spark, text.first_verdict(F.lit(x))) for x in ("Supported: x", "Fake", "General", "well")] == [0, 1, 2, -1]
    assert value(spark, text.last_verdict(F.lit("first supported, then Unfounded"))) == 1 and value(spark, text.last_verdict(F.lit("none"))) == -1
    assert value(spark, text.capitalised(F.lit("The Acme Corp and Acme"), ("the",))) == ["Acme", "Corp"] and value(spark, text.first_contained(F.lit("of ACME and b"), ("B", "Acme"))) == "B"
    assert value(spark, grounding.pieces(F.lit("One is here. Two is there. Three."), 20)) == ["One is here.", "Two is there. Three."]


def test_merge_keeps_the_first_pass(spark):
    rows = [("b", 1, "Revenue", None, "2020", None, 5.0), ("b", 2, "REVENUE", None, "2020", None, 6.0), ("b", 2, "Revenue", None, "2021", None, 7.0), ("b", 2, "Revenue", None, "2020", "X", 8.0)]
    facts = spark.createDataFrame(rows, "block string, pass int, metric_name string, period_start string, period_end string, related_entity string, num_value double")
    assert sorted(r["num_value"] for r in grounding.merge_passes(facts, ["block"]).collect()) == [5.0, 7.0, 8.0]


def test_useful_facts(spark):
    rows = [(1.0, None, None, "", None, None), (None, "2020", None, "", None, None), (None, None, "n", "", None, None), (None, None, None, "a 1", None, None), (None, None, None, "", "m", "USD"), (None, " ", "", "x", "m", None)]
    facts = spark.createDataFrame(rows, "num_value double, period_end string, text_nuance string, grounding_quote string, metric_name string, unit string")
    assert grounding.useful(facts).count() == 5


def interval_by_hand(quote, source):
    """Every window, in order, by its matching blocks."""
    want = Counter(w.lower() for w in re.findall(r"\w+|\S", quote))
    places = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|\S", source)]
    width, best, where = min(max(sum(want.values()), 20), len(places)), 0.0, None
    for i in range(len(places) - width + 1 if want and width else 0):
        window = places[i : i + width]
        have = Counter(w.lower() for w, _, _ in window)
        if sum(min(n, have[w]) for w, n in want.items()) / sum(want.values()) >= 0.55:
            text = " ".join(w for w, _, _ in window)
            recall = sum(b.size for b in difflib.SequenceMatcher(None, quote, text, autojunk=False).get_matching_blocks()) / len(quote)
            if recall > best:
                best, where = recall, (window[0][1], window[-1][2])
    return where if best >= 0.85 else None


def test_like_words_equal_every_window_by_hand():
    rnd, found = random.Random(7), 0
    for _ in range(400):
        words = [rnd.choice(["net", "sales", "rose", "to", "$", "4", "5.2", "of", "the", "Income", "über", "taxes", ",", "in"]) for _ in range(rnd.randint(0, 70))]
        source = rnd.choice([" ", "  ", "\n"]).join(words)
        at = rnd.randint(0, max(0, len(words) - 1))
        quote = list(" ".join(words[at : at + rnd.randint(1, 25)]))
        for _ in range(rnd.randint(0, 6)):
            if quote:
                quote[rnd.randrange(len(quote))] = rnd.choice("xe 4")
        quote = "".join(quote)
        found += interval_by_hand(quote, source) is not None
        assert grounding.fuzzy_interval(quote, source) == interval_by_hand(quote, source), (quote, source)
    assert found > 100
    assert grounding.fuzzy_interval("income of taxes rose in the net sale", "words " * 300_000 + "income of taxes rose in the net sales today") is not None


def test_grounding_of_nulls_and_very_short_and_long_sources(spark):
    rows = [("revenue of 5", None), (None, "revenue of 5"), (None, None), ("", ""), ("revenue of 5", ""), ("revenue", "r"), ("no such", "é"), ("Revenue was high", "Revenue was  high " * 50_000)]
    facts = spark.createDataFrame([(q, s, "Revenue", None, None) for q, s in rows] + [("a b", "a b", None, None, "x")], "grounding_quote string, source string, metric_name string, text_nuance string, section string")
    out = [(r["grounding_quote"], r["source"], r["alignment_status"], r["confidence"]) for r in grounding.ground(facts.withColumn("_quote2", F.lit(1))).collect()]
    assert len(out) == 9 and {s for q, s, status, c in out if status == "UNALIGNED" and c == 0.0} >= {None, "", "r", "é"}
    assert [status for q, s, status, _ in out if s and len(s) > 100] == ["EXACT"]
    assert sum(s is None for _, s, _, _ in out) == 2


def ratio_by_hand(a, b):
    """Insertions and deletions by the usual table."""
    def apart(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, before = [i], row
            for j, d in enumerate(y, 1):
                row.append(before[j - 1] if c == d else 1 + min(before[j], row[-1]))
        return row[-1]

    a, b = set(a.split()), set(b.split())
    if not a or not b:
        return 0
    both, left, right = (" ".join(sorted(x)) for x in (a & b, a - b, b - a))
    if both and (not left or not right):
        return 100
    joined = lambda x: " ".join(filter(None, (both, x)))
    rate = lambda d, x, y: 100 - 100 * d / (len(x) + len(y))
    scores = [rate(apart(left, right), joined(left), joined(right))]
    return max(scores + [rate(apart(both, joined(x)), both, joined(x)) for x in (left, right) if both])


def test_token_set_ratio():
    rnd = random.Random(2)
    for _ in range(2000):
        a, b = (" ".join("".join(rnd.choice("abc9é") for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 5))) for _ in "ab")
        assert abs(similarity.token_set_ratio(a, b) - ratio_by_hand(a, b)) < 1e-9, (a, b)
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and similarity.token_set_ratio("x" * 300, "y" * 300) == 0


def test_few_windows_are_matched_and_texts_are_read_once(spark, monkeypatch):
    """One window a text at most is compared block by block where the others can't win; the plan has one pass over the texts."""
    tail = "while the clerk of the building segment kept all of the other papers of that office in good order for the whole time"
    quote = tail.replace("papers", "paperss").replace("kept", "keeps")
    sources = [f"Revenues of order were {i}.25 dollars, {tail}." for i in range(20)]
    want, made = [interval_by_hand(quote, s) for s in sources], []

    class Counted(difflib.SequenceMatcher):
        def __init__(self, *args, **more):
            made.append(1)
            super().__init__(*args, **more)

    monkeypatch.setattr(grounding.difflib, "SequenceMatcher", Counted)
    assert [grounding.fuzzy_interval(quote, s) for s in sources] == want and all(want)
    assert len(made) <= len(sources)
    for name in ("ledger_from_proposals", "grounded_facts", "alignment_counts"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("_fuzzy(") == 1 and plan.count("regexp_replace") <= 8


def test_windows_go_by_their_characters_first(monkeypatch):
    """Subsequences are worked out for one window a text at most where the others lack too many characters, for none where all do."""
    tail = "while the clerk of the building segment kept all of the other papers of that office in good order for the whole time"
    quote, asked = tail.replace("papers", "paperss").replace("good", "bad"), []
    sources = [f"Revenues of order were {i}.75 dollars, {tail}." for i in range(20)] + [tail.replace("e", "y").replace("t", "k") + " of the of the of in for all that"] * 3
    counted = lambda *x: asked.append(1) or similarity.common_length(*x)
    monkeypatch.setattr(grounding, "common_length", counted)
    assert [grounding.fuzzy_interval(quote, s) for s in sources] == [interval_by_hand(quote, s) for s in sources]
    assert len(asked) <= 20


def test_counts_of_proposals_come_by_one_scan(spark):
    """Proposals are read once, whatever way their quotes are found, and what only ledger rows need isn't worked out for the counts."""
    plan = plans.QUERIES["alignment_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan and "o_orderdate" not in plan.split("Relation [")[0]
