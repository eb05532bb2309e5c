import json
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from factledger.schema import LEDGER
from factledger.sources import tables
from factledger.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_absent_ledger_is_empty(spark, tmp_path):
    assert tables.read_ledger(spark, str(tmp_path / "none")).count() == 0
    tables.write_ledger(spark.createDataFrame([], LEDGER), str(tmp_path / "some"))
    assert tables.read_ledger(spark, str(tmp_path / "some")).count() == 0


def test_json_lines_last_record_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "v": 1}\nnot json\n{"id": "x", "v": 2}\n{"id": "y", "v": 3}\n')
    rows = tables.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, v int", "id")
    assert {r["id"]: r["v"] for r in rows.where("id IS NOT NULL").collect()} == {"x": 2, "y": 3}


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in tables.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_splits(spark, tmp_path):
    tables.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).where("split = 'test'").first()["id"] == 2


def events_at(spark, path):
    rows = [(i, f"2024-01-01 0{i // 4}:{i % 4}0:00", i % 2, "click", 1.5) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr(
        "event_id", "timestamp(t) AS ts", "user_id", "event_type", "value"
    ).write.mode("append").parquet(path)


def test_windows_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    events_at(spark, path)
    query = events.tumbling(events.read_events(spark, path, SCHEMA)).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = events.tumbling(spark.read.schema(SCHEMA).parquet(path))
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())


def test_log_adds_nothing_twice(spark, tmp_path):
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    events_at(spark, path)
    for k in range(2):  # the second run forgets what the first has done
        events.write_new(events.read_events(spark, path, SCHEMA), log, str(tmp_path / f"checkpoint{k}"), "event_id").awaitTermination()
    assert spark.read.json(log).count() == 12
    assert tables.unprocessed(spark.range(14).withColumnRenamed("id", "event_id"), tables.completed(spark, log, "event_id"), "event_id").count() == 2


def test_log_goes_on_from_its_checkpoint_without_reading_itself(spark, tmp_path):
    """New files bring new and old keys and a null; the log is moved away in between, so only the state can know the old keys."""
    path, log, place = str(tmp_path / "in"), tmp_path / "log", str(tmp_path / "checkpoint")
    events_at(spark, path)
    events.write_new(events.read_events(spark, path, SCHEMA, 1), str(log), place, "event_id").awaitTermination()
    log.rename(tmp_path / "moved")
    spark.sql("SELECT CAST(id AS LONG) AS event_id, timestamp('2024-01-02 00:00:00') AS ts, 1L AS user_id, 'click' AS event_type, 1.0D AS value FROM VALUES (3), (11), (12), (12), (13), (NULL) AS t(id)").write.mode("append").parquet(path)
    events.write_new(events.read_events(spark, path, SCHEMA, 1), str(log), place, "event_id").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.json(str(log)).collect()) == [12, 13]

def test_routed_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "label": " General"}\nbroken\n{"id": "2", "label": "SUPPORTED"}\n{"id": "3", "label": "odd"}\n{"id": "4"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "5", "label": "supported"}\n')
    (tmp_path / "c.txt").write_text('{"id": "6", "label": "supported"}\n')
    rows = tables.read_routed(spark, str(tmp_path), "id string, label string", {"general": "axioms", "supported": "facts"})
    assert {(r["id"], r["pool"], r["file"]) for r in rows.collect()} == {("1", "axioms", "a.jsonl"), ("2", "facts", "a.jsonl"), ("5", "facts", "b.jsonl")}


def test_checkpoint(spark, tmp_path):
    lines = [
        '{"chunk_id": "a", "proposed_count": 3, "accepted_rows": [{"row_id": "x"}, {"row_id": "y"}]}', '{"chunk_id": "b", "block_type": "TABLE", "proposed_count": 9, "accepted_rows": [{"row_id": "z"}]}',
        '{"chunk_id": "c", "block_type": "TEXT", "proposed_count": 2, "accepted_rows": []}', '{"chunk_id": "d"}', "", "{broken",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    done, rows, counts = tables.read_checkpoint(spark, str(tmp_path / "log.jsonl"), "row_id: string")
    assert {r[0] for r in done.collect()} == {"a", "b", "c"}
    assert sorted(r[0] for r in rows.collect()) == ["x", "y", "z"]
    assert tuple(counts.first()) == (5, 2)


def test_csv_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('q,a\n"line\nend, ""quoted""",1\n')
    (tmp_path / "b.csv").write_text("q,a,extra\nx,2,y\n")
    rows = tables.read_csv_parts(spark, {"10k": str(tmp_path / "a.csv"), "news": str(tmp_path / "b.csv")})
    assert {(r["q"], r["a"], r["extra"], r["doc_type"]) for r in rows.collect()} == {('line\nend, "quoted"', "1", None, "10k"), ("x", "2", "y", "news")}


def test_pages_and_archives(spark, tmp_path):
    page = {"table": {"uid": "t", "table": [["a", "b"]]}, "paragraphs": [{"uid": "2", "order": 2, "text": "two"}, {"uid": "1", "order": 1, "text": "one"}], "questions": [{"uid": "q1"}, {"uid": "q2"}]}
    (tmp_path / "pages.json").write_text(json.dumps([page, {**page, "questions": []}]))
    rows = tables.read_pages(spark, str(tmp_path / "pages.json"), "uid: string").collect()
    assert [(r["uid"], r["table"], r["paragraphs"]) for r in rows] == [("q1", [["a", "b"]], ["one", "two"]), ("q2", [["a", "b"]], ["one", "two"])]
    with zipfile.ZipFile(tmp_path / "sets.zip", "w") as z:
        z.writestr("d/train.json", '[{"id": "1"}, {"id": "2"}]')
        z.writestr("d/test.json", '[{"id": "3"}]')
        z.writestr("d/readme.txt", "no")
    rows = tables.read_zipped_json(spark, str(tmp_path / "sets.zip"), "id: string").collect()
    assert {(r["member"], r["id"]) for r in rows} == {("d/train.json", "1"), ("d/train.json", "2"), ("d/test.json", "3")}


def test_envelopes(spark, tmp_path):
    config = {"k": "5", "model": "m"}
    (tmp_path / "e.json").write_text(json.dumps({"_config": {"model": "m", "k": 5}, "results": [{"id": "1", "answer": "x"}, {"id": "2", "answer": "TIMEOUT_FAILURE"}]}, indent=1))
    retry = F.col("answer") == "TIMEOUT_FAILURE"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        rows = tables.read_envelope(spark, str(tmp_path / "e.json"), "id: string, answer: string", config, retry)
        assert [tuple(r) for r in rows.collect()] == [("1", "x")]
        tables.write_envelope(rows, config, str(tmp_path / "own"))
        assert [tuple(r) for r in tables.read_envelope(spark, str(tmp_path / "own"), "id: string, answer: string", config, lines=True).collect()] == [("1", "x")]
    assert len((tmp_path / "own").glob("*.json").__next__().read_text().splitlines()) == 1
    with pytest.warns(UserWarning, match="other settings"):
        tables.read_envelope(spark, str(tmp_path / "e.json"), "id: string, answer: string", {"k": "9", "model": "m"})


def test_links_of_chunks(spark):
    chunks, ledger = spark.createDataFrame([("a",), ("b",)], "chunk_id string"), spark.createDataFrame([("r2", "a"), ("r1", "a"), ("r1", "a"), ("r3", None)], "row_id string, source_chunk_id string")
    assert {r["chunk_id"]: r["row_ids"] for r in tables.link_rows(chunks, ledger).collect()} == {"a": ["r1", "r2"], "b": []}
