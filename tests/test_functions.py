from pyspark.sql import functions as F

from factledger.functions import numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, text.tokens(F.lit("Net Sales for 2023, sales x"))) == ["sales", "2023", "sales"]


def test_recall(spark):
    recall = lambda q, t: one(spark, text.lexical_recall(F.array(*map(F.lit, q)).cast("array<string>"), F.lit(t)))
    assert recall(["revenue", "2023"], "Revenue grew in 2023 by much") == 1.0
    assert recall([], "anything") == 1.0
    assert recall(["revenue"], "[Previous Context: revenue of old]\n\nnothing here") == 0.0
    assert recall(["a1", "a1"], "a1") == 0.5


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("Apple Inc. rose. Mr. X e.g. it fell! Ok"))) == ["Apple Inc.", "rose.", "Mr. X e.g. it fell!", "Ok"]


def test_entity_ids(spark):
    assert one(spark, text.entity_id(F.lit(" Acme, Inc. "))) == "ID_ACME_INC"
    assert one(spark, text.entity_id(F.lit(""))) == one(spark, text.entity_id(F.lit(None).cast("string"))) == "EXP_GLOBAL"


def test_replace_first_word(spark):
    swap = lambda t, a, b: one(spark, text.replace_first_word(F.lit(t), F.lit(a), F.lit(b)))
    assert swap("5 Million and 6 million", "million", "billion") == "5 billion and 6 million"
    assert swap("5 millions", "million", "billion") is None


def test_cells(spark):
    cell = lambda s: tuple(one(spark, numeric.parse_cell(F.lit(s))))
    assert cell("1,234(1)") == (1234.0, None)
    assert cell("—") == cell("-") == (0.0, "Dash treated as zero")
    assert cell("(10.5)") == (-10.5, "Negative (parentheses)")
    assert cell("10.5b") == (10.5, None)
    assert cell("$ 100") == (100.0, None)
    assert cell("N/A") == cell("12%") == cell("5d 6f") == (None, None)


def test_noise(spark):
    noise = lambda s: one(spark, numeric.is_noise(F.lit(s)))
    assert all(map(noise, ["$ 12657", "(1,757)", "2.35", "-6781", "100", "£ 500", "---", "12.5%", "1e5"]))
    assert not any(map(noise, ["Revenue", "Gross Margin (%)", "Total Assets 2023"]))


def test_posterior_and_softmax(spark):
    assert abs(one(spark, numeric.posterior_mean(F.lit(9.0), F.lit(10.0))) - 9.000001 / 11.000001) < 1e-12
    assert [round(x, 4) for x in one(spark, numeric.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))] == [0.09, 0.2447, 0.6652]


def test_close(spark):
    close = lambda a, b: one(spark, numeric.close(F.lit(a), F.lit(b)))
    assert close(5466.0, 5466.312) and not close(1000.0, 1006.5) and close(0.0, 0.01)
