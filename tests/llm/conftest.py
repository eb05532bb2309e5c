import pytest

LONG = " ".join(f"word{i % 977} of part {i // 7}." for i in range(12_000))
BASE = " ".join(f"alpha{i} beta{i % 11} gamma" for i in range(60))


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and very long texts, repeats, ties, and columns named like results."""
    path = str(tmp_path_factory.mktemp("awkward"))
    docs = [
        (1, BASE, "en", "a", 5), (2, BASE, "en", "a", 5), (3, BASE + " end", "en", None, 5), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \n\t ", "de", "b", 4),
        (7, LONG, "en", "b", 9), (None, "no id a@b.co 4111 1111 1111 1111", "en", "c", 3), (8, "é😀 Zu\n" * 40, "fr", "c", 1), (8, "é😀 Zu\n" * 40, "fr", "c", 1), (9, "a", "en", "", 1),
        (10, LONG + " tail", "en", "b", 9),
    ]
    extra = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: "'x'" for c in ("n_words", "kept", "size", "shard", "slot", "id", "row", "n", "digest", "mark", "places", "copies", "target", "rank", "bands", "start", "item_id", "quality", "_match", "_dropped", "key", "nth", "_key", "_n", "_copy")}
    frame = spark.createDataFrame(docs, extra)
    frame.selectExpr("*", *(f"{v} AS {k}" for k, v in clash.items())).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (6, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(BASE.split()[3:20])), (2, "Alpha0 BETA0"), (None, "gamma alpha5"), (3, None), (4, "  "), (1, " ".join(BASE.split()[30:50])), (10, "nowhere " * 20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://A.example.net/en/1"), (2, None), (3, "no scheme"), (None, "https://x.org/fr/2.html?q#f"), (4, "x://"), (1, "http://A.example.net/en/1"), (5, "http://h/" + "a/" * 40), (6, "http://n.net")]
    spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "substr(url, 1, 12) AS html", "'x' AS host", "'x' AS rule").write.parquet(f"{path}/pages.parquet")
    turns = [
        (1, 0, "user", "hi <s>"), (1, 1, "assistant", "&amp; [x]"), (1, 1, "assistant", "&amp; [x]"), (1, None, "user", None), (None, 0, None, "x"), (2, 0, "assistant", None), (3, 5, "user", "only"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS example", "'x' AS last").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path
