"""Each corpus' own rules on odd records."""

from pyspark.sql import functions as F

from factledger.operators import corpora as C


def test_companies(spark):
    texts = ["What did Pfizer pay?", "cvs pharmacies", "CVS Health and 3m", "pge of California", "nothing", None, "a nike shoe", "PG&E"]
    out = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.company_in(F.col("t")).alias("c")).collect()]
    assert out == ["Pfizer", "CVS Health", "3M", "PG&E", "Global_Entity", "Global_Entity", "NIKE", "PG&E"]


def test_programs_and_tables(spark):
    kinds = "id string, pre_text array<string>, table array<array<string>>, post_text array<string>, question string, program string, exe_ans string"
    rows = [("1", ["before"], [["a"], ["-1.5"]], ["after"], "q?", "add(1, 2)", "-3.5 and 4"), (None, None, None, None, None, None, None), (None, [], [], [], "", "", "")]
    out = C.programs(spark.createDataFrame(rows, kinds)).collect()
    assert out[0]["context_chunks"] == ["before", "| a |\n| --- |\n| -1.5 |\n", "after"] and out[0]["metadata"]["original_values"] == '["-3.5","4"]' and out[0]["metadata"]["has_logic_trace"] == "true"
    assert len(out) == 3 and out[1]["context_chunks"] == [] and out[1]["metadata"]["has_logic_trace"] == "false" and out[1]["id"] != "finqa_"
    question = "struct<uid: string, question: string, answer: array<string>, answer_type: string, derivation: string, scale: string>"
    asked = [("u", "q", ["1", "2"], "arithmetic", "3-2", "million"), ("v", "q", ["x"], "arithmetic", "", None), ("w", "q", ["x"], None, None, None), ("x", "q", ["x"], "count", None, None), ("y", "q", [], "span", None, None), ("z", "q", None, "span", None, None)]
    pages = spark.createDataFrame([([["h"], ["1"]], ["text", ""], asked), (None, None, None), (None, None, [])], f"table array<array<string>>, paragraphs array<string>, questions array<{question}>")
    out = {r["id"]: r for r in C.tables_and_texts(pages).collect()}
    assert out.keys() == {"tatqa_u", "tatqa_v", "tatqa_w", "tatqa_x"} and out["tatqa_u"]["target_sentence"] == "1, 2" and out["tatqa_u"]["trace_code"].startswith("result = 3 - 2")
    assert [out[f"tatqa_{k}"]["trace_code"] for k in "vwx"] == [C.ANALYSIS, C.LOOKUP, C.COUNTING] and len(out["tatqa_u"]["context_chunks"]) == 3


def test_filings_hallucinations_and_axioms(spark):
    gold = [("1", "q", "a", ["e", None], "D_2020_10K", 2020, "3M", None), ("2", "q", "a", [None], None, None, None, None), ("3", "q", "a", None, None, None, None, None)]
    out = C.gold_filings(spark.createDataFrame(gold, "financebench_id string, question string, answer string, evidence array<string>, doc_name string, doc_period int, company string, doc_link string")).collect()
    assert [(r["id"], r["context_chunks"], r["metadata"]["doc_period"], r["metadata"]["doc_link"]) for r in out] == [("finbench_gold_1", ["e"], "2020", "")]
    head = "QUESTION (THIS DOES NOT COUNT AS BACKGROUND INFORMATION):\n"
    prompt = f"{head}Who?\n--\nDOCUMENT:\nOracle says\n--\nANSWER:\nthey\n--\n"
    judged = [("1", "FAIL", [prompt, '{"REASONING": ["a", "b"], "SCORE": 1}']), ("2", "Pass", [prompt]), ("3", "?", [prompt]), ("4", None, [prompt]), ("5", "PASS", []), ("6", "PASS", None), ("7", "PASS", ["no sections"])]
    out = {r["id"]: r for r in C.judged_filings(spark.createDataFrame(judged, "id string, label string, messages array<string>")).collect()}
    assert {k: r["label"] for k, r in out.items()} == {"finbench_test_1": "Unfounded", "finbench_test_2": "Supported"}
    assert out["finbench_test_1"]["metadata"]["original_reasoning"] == '["a", "b"]' and out["finbench_test_2"]["metadata"]["company"] == "Oracle" and out["finbench_test_1"]["metadata"]["sabotage_ready"] == "false"
    said = [(" q ", "c c c", "a", "Not hallucination", "10k"), ("q", "c", "a", "HALLUCINATION", "10k"), ("q", "c", "a", "other", "10k"), ("", "c", "a", "hallucination", "10k"), ("q", None, "a", "hallucination", "10k"), ("q", "c", "a", None, "10k")]
    out = C.hallucinations(spark.createDataFrame(said, "query string, context string, answer string, label string, doc_type string")).collect()
    assert [(r["label"], r["query"], r["metadata"]["token_estimate"]) for r in out] == [("Supported", "q", "4"), ("Unfounded", "q", "1")] and len({r["id"] for r in out}) == 2
    known = [("Economics and Law", "q ", " b", None), ("Myths", "q", "b", "s"), (None, "q", "b", "s"), ("law", None, "b", "s"), ("law", "q", None, "s")]
    out = C.axioms(spark.createDataFrame(known, "category string, question string, best_answer string, source string"), ("Law", "Economics")).collect()
    assert [(r["query"], r["target_sentence"], r["context_chunks"], r["metadata"]["source_ref"]) for r in out] == [("q", "b", [], "Unknown")]
