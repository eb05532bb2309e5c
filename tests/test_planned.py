"""Plans with every kind of scope, empty and null parts; chunks ranked only where there are too many; contexts."""

import pytest

from factledger.operators import planned

LEDGER = "row_id string, entity_id string, company_label string, metric_name string, num_value double, period_end string, source_chunk_id string, source_record_id string, text_nuance string, alignment_status string, ord int"
PLANS = "query_id int, entity_ids array<string>, record string, company string, years array<string>, metrics array<string>, nuance string"
FACTS = [
    ("a", "E1", "C1", "Net Sales", 1.0, "FY2023", "c1", "r1", None, "EXACT", 3), ("b", "E1", "EXP_GLOBAL", "Cost of sales", 2.0, "2022", "c1", "r2", "Restated", None, 1), ("c", "E2", "C2", "Net Sales", 3.0, None, None, "r1", "x", "EXACT", 2),
    ("d", "E1", "C1", "Net Sales", 4.0, "2023", "c2", "r1", None, "UNALIGNED", 0), ("e", None, None, None, None, "2023", None, None, None, "FUZZY", 4),
]


def found(spark, *plan, limit=10):
    rows = planned.facts_of(spark.createDataFrame([(1, *plan)], PLANS), spark.createDataFrame(FACTS, LEDGER), limit).orderBy("rank").collect()
    return [r["row_id"] for r in rows]


def test_scopes_and_filters(spark):
    assert found(spark, ["E1", "E1"], None, None, None, None, None) == ["b", "a"]
    assert found(spark, ["E1"], "r1", None, None, None, None) == ["b", "c", "a"] and found(spark, None, "r1", None, None, None, None) == ["c", "a"]
    assert found(spark, [], "", None, [], [], "") == ["b", "c", "a", "e"] and found(spark, [], "", None, [], [], "", limit=2) == ["b", "c"]
    assert found(spark, None, None, "C1", None, None, None) == ["b", "a"] and found(spark, None, None, None, ["2023"], None, None) == ["a", "e"]
    assert found(spark, None, None, None, None, ["Net Sales", "sales"], None) == ["c", "a"]  # meant exactly, since the ledger has one of the names
    assert found(spark, None, None, None, None, ["SALES"], None) == ["b", "c", "a"] and found(spark, None, None, None, None, ["net"], None) == ["c", "a"]
    assert found(spark, None, None, None, None, None, "restat") == ["b"] and found(spark, ["E9"], "r9", None, None, None, None) == []
    with pytest.raises(ValueError, match="neither"):
        planned.facts_of(spark.createDataFrame([(i, None, None, None, None, None, None) for i in range(3)], PLANS), spark.createDataFrame(FACTS, LEDGER), most_open=2)


def test_chunks_are_ranked_only_where_there_are_too_many(spark):
    kinds = "query_id int, id string, ord int, content string, section_path array<string>"
    chunks = [(1, "x", 1, "none", None), (1, "y", 2, "Sales", []), (1, "y", 5, "again", []), (1, "z", 3, "sales of net", ["A", "B"]), (2, "p", 1, "none", None), (2, "q", 2, "net sales", None)]
    facts = spark.createDataFrame([(1, "x"), (1, None), (2, "q")], "query_id int, source_chunk_id string")
    words = spark.createDataFrame([(1, ["net", "SALES"])], "query_id int, keywords array<string>")
    top = planned.chunks_of(spark.createDataFrame(chunks, kinds), facts, words, limit=2)
    assert [(r["query_id"], r["id"], r["score"]) for r in top.orderBy("query_id", "rank").collect()] == [(1, "x", 5), (1, "z", 2), (2, "p", 0), (2, "q", 5)]
    rows = planned.facts_of(spark.createDataFrame([(1, ["E1"], None, None, None, None, None)], PLANS), spark.createDataFrame(FACTS + [("a2", *FACTS[0][1:])], LEDGER))
    out = {r["query_id"]: r["context"] for r in planned.contexts(spark.createDataFrame([(1,), (3,)], "query_id int"), rows, top, ["row_id", "num_value", "nuance_note"], "Cite.").collect()}
    assert "| row_id | num_value |\n| --- | --- |\n| b | 2.0 |\n| a | 1.0 |\n" in out[1] and "--- CHUNK_ID: z ---\nSECTION: A > B\nCONTENT:\nsales of net\n" in out[1] and "SECTION: Unknown" in out[1]
    assert planned.NO_FACTS in out[3] and planned.NO_CHUNKS in out[3] and out[3].endswith("REASONING:\nCite.\n")


def test_any_number_of_plans_without_entity_or_record(spark):
    """More than ten thousand of them, equal and different ones, sent to the ledger or joined in parts; rows of one id are ranked together."""
    years = lambda i: [None, [], ["2022"], ["2023"], ["FY", "2022"]][i % 5]
    rows = [(i, None, "" if i % 2 else None, ["C1", "", None][i % 3], years(i), None, None) for i in range(10_500)] + [(0, None, None, "C1", None, None, None), (-1, ["E1"], None, "C1", None, None, None)]
    plans, ledger = spark.createDataFrame(rows, PLANS), spark.createDataFrame(FACTS, LEDGER)
    fits = lambda f, company, years: f[9] != "UNALIGNED" and (not company or f[2] in ("C1", "EXP_GLOBAL")) and (not years or any(y in (f[5] or "") for y in years))
    order = {f[0]: f[10] for f in FACTS}
    want = {}
    for plan in rows:
        of_entity = lambda f: f[1] == "E1" or not plan[1]  # noqa: E731, B023
        want.setdefault(plan[0], []).extend(f[0] for f in FACTS if of_entity(f) and fits(f, plan[3], plan[4]))
    want = {(q, n, f) for q, fs in want.items() for n, f in enumerate(sorted(fs, key=order.get)[:3], 1)}
    for sent in (10_000, 2):
        out = planned.facts_of(plans, ledger, limit=3, most_sent=sent).collect()
        assert len(out) == len(want) and {(r["query_id"], r["rank"], r["row_id"]) for r in out} == want
