import numpy as np
from pyspark.sql import functions as F

from factledger import plans
from factledger.operators import evaluation, factory, ingest, ledger, retrieval

SF = "/root/testdata/sf0.001"


def test_header_path_skips_levels(spark):
    headers = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(t).alias("title")) for n, t in ((1, "A"), (3, "B"), (4, "C"), (3, "D"))))
    assert spark.range(1).select(ingest.header_path(headers).alias("x")).first()["x"] == ["A", "A > B", "A > B > C", "A > B > D"]


def test_header_paths_query_against_brute_force(spark):
    have = {r["doc_id"]: (r["headers"], r["last_path"]) for r in plans.QUERIES["header_paths"](spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        stack, n = [], 0
        for line in doc["text"].split("\n"):
            if line.strip(" "):
                stack = stack[: len(line) % 4] + [line.split(" ")[0]]
                n += 1
        assert have.get(doc["doc_id"], (0, "")) == (n, " > ".join(stack))


def test_packing_skips_and_goes_on(spark):
    rows = [("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("b", 1, 200), ("b", 2, 100), ("b", 3, 1)]
    packed = ingest.pack(spark.createDataFrame(rows, "source string, id long, size long"), "source", 100).where("taken").collect()
    assert sorted((r["source"], r["id"]) for r in packed) == [("a", 1), ("a", 3), ("b", 2)]


def test_segments(spark):
    doc = "text\n\n| a | b |\n\n| 1 | 2 |\nmore"
    found = ingest.segment(ingest.lines(spark.createDataFrame([(1, doc)], "id long, text string"))).orderBy("block").collect()
    assert [(r["kind"], r["n_lines"]) for r in found] == [("TEXT", 2), ("TABLE", 3), ("TEXT", 1)]


def test_melt(spark):
    table = "| Item | 2023 | 2022 |\n|---|---|---|\n| Net Sales | 100 | 90 |\n| Net Income | (10.5) | 5 |\n| Per Share | 5.25 | x |"
    grid = ingest.cells(spark.createDataFrame([("t", table)], "id string, content string"))
    rows = {(r["metric_name"], r["period_end"]): r for r in ingest.melt(grid, F.lit("(In millions)")).collect()}
    assert rows["Net Sales", "2023"]["num_value"] == 1e8 and rows["Net Sales", "2023"]["scale"] == 1e6
    assert rows["Net Income", "2023"]["num_value"] == -1.05e7 and rows["Net Income", "2023"]["nuance"] == "Negative (parentheses)"
    assert rows["Per Share", "2023"]["unit"] == "USD/Share" and rows["Per Share", "2022"]["num_value"] is None and len(rows) == 6


def test_boilerplate(spark):
    is_bad = lambda c, s="": spark.range(1).select(ingest.is_boilerplate(F.lit(c), F.lit(s)).alias("x")).first()["x"]
    assert is_bad("https://a.b/c https://d.e") and is_bad("1/28/26, 3:13 PM") and is_bad("☒ yes ☐ no, as far as known") and is_bad("short")
    assert is_bad("Some words about the filer", "Indicate by check mark") and not is_bad("☒ ☐ net income of the company")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None), (98, [0.0] * 8)], "id long, embedding array<double>")
    found = {}
    for r in retrieval.nearest(frame, frame.where("id % 10 = 0"), 3, block=2).collect():
        found.setdefault(r["query_id"], []).append((-r["similarity"], r["vec_id"]))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(0, 60, 10):
        want = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(60) if i != q)[:3]
        assert sorted(found[q]) == want


def test_exact_metric_anywhere_turns_fuzzy_off(spark):
    rows = spark.createDataFrame([("ID_A", "Revenue"), ("ID_B", "Net Revenue")], "entity_id string, metric_name string")
    only_b = rows.where("entity_id = 'ID_B'")
    assert ledger.with_metrics(only_b, rows, ["Revenue"]).count() == 0
    assert ledger.with_metrics(only_b, only_b, ["Revenue"]).count() == 1


def test_unknown_status_stays(spark):
    rows = spark.createDataFrame([("UNALIGNED",), ("EXACT",), (None,)], "s string")
    assert ledger.aligned(rows, F.col("s")).count() == 2


def test_split_is_a_tenth_and_at_least_one_of_three(spark):
    rows = [(i, "a") for i in range(50)] + [(i, "b") for i in range(50, 53)] + [(99, "c")]
    found = factory.split_families(spark.createDataFrame(rows, "family long, bucket string")).groupBy("bucket", "split").count().collect()
    assert {(r["bucket"], r["split"]): r["count"] for r in found} == {
        ("a", "test"): 5, ("a", "val"): 5, ("a", "train"): 40, ("b", "test"): 1, ("b", "val"): 1, ("b", "train"): 1, ("c", "train"): 1,
    }


def test_family_ids(spark):
    name = lambda s: spark.range(1).select(factory.family_id(F.lit(s)).alias("x")).first()["x"]
    assert name("sabotaged_finqa_A/2010/p_1_ab12cd34") == "finqa_A/2010/p_1" and name("plain_1") == "plain_1"


def test_replication(spark):
    pool = spark.createDataFrame([(i,) for i in range(3)], "id long")
    counts = {r["id"]: r["count"] for r in factory.replicate(pool, 8).groupBy("id").count().collect()}
    assert counts == {0: 3, 1: 3, 2: 2} and factory.replicate(pool, 2).count() == 2 and factory.replicate(pool.where("id > 5"), 4).count() == 0


def test_survivors(spark):
    runs = {(1, 1, 1, 1): "ALL_WIN", (0, 0, 0, 0): "ALL_FAIL", (0, 0, 0, 1): "ONLY_4_WINS", (0, 1, 0, 0): "BASELINE_FAILS", (1, 0, 1, 0): "OTHER", (1, None, 1, 1): None}
    for flags, want in runs.items():
        columns = [F.lit(None if f is None else bool(f)).cast("boolean") for f in flags]
        assert spark.range(1).select(evaluation.survivor_class(columns).alias("x")).first()["x"] == want


def test_year_guard(spark):
    years = retrieval.guarded_years(F.array(F.lit("2021"), F.lit("2022"), F.lit("2019")), F.lit("growth in 2021"), F.array(F.lit("2019")))
    assert spark.range(1).select(years.alias("x")).first()["x"] == ["2021", "2019"]


def test_numbers_of_a_context_are_read_once(spark):
    """However many pairs are tried, the plan reads a context's numbers in one place; the flags are those of each pair by hand."""
    context = [3.0, 8.0, 20.0, 20.5]
    near = lambda x, n: abs(x - n) <= max(abs(n) * 0.01, 0.01)
    ways = lambda x, y: (x + y, x - y, (x - y) / abs(y) * 100, x / y * 100, x / y)
    by_hand = {n: not (n in (*context, 100) or any(near(w, n) for i, x in enumerate(context) for j, y in enumerate(context) if i != j for w in ways(x, y))) for n in range(2, 300)}
    rows = spark.createDataFrame([(n, f"It is {n}", "3 and 8 and 20 and 20.5") for n in by_hand] + [(-1, None, "3 and 8"), (-2, "It is 7", None), (-3, "It is 7", "")], "n long, said string, context string")
    found = rows.select("n", evaluation.hallucinated(F.col("said"), F.col("context"), F.lit("how many"), F.lit(False), F.lit(True)).alias("flag"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 6
    flags = {r["n"]: r["flag"] for r in found.collect()}
    assert [flags.pop(n) for n in (-1, -2, -3)] == [False, True, True] and flags == by_hand
