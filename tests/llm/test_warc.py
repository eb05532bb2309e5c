"""Archives written and read back, predicates that reach the reader, archives of others, and broken ones."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factledger.llm import queries, warc

SHA = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
PAGES = [
    (1, "http://a/1", "<p>same"), (2, None, "<p>same"), (2, "http://a/2\r\nX: y", "<p>same"), (None, "u", "<p>same"), (3, "http://é/", None), (4, "x", ""), (5, "x", "é😀\r\n\r\nWARC/1.1\r\n" * 3), (6, "y", "long " * 300_000),
]


def by_hand(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[(r["html"] or "").encode()].append(r["page_id"])
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            again = k > 0 and len(data) >= least
            yield i, len(data), SHA(data), "revisit" if again else "response", ids[0] if again else None


def test_awkward_pages(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'x' AS row", "'x' AS digest")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    assert Counter(map(tuple, queries.op13_warc_source(spark, str(tmp_path)).collect())) == Counter(by_hand(frame.collect()))
    frame.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op13_warc_source(spark, f"{tmp_path}/none").count() == 0
    large = warc.read(spark, warc.write(warc.records(frame, least=100)))
    assert Counter(large.select("page_id", "record_type").collect()) == Counter((i, t) for i, _, _, t, _ in by_hand(PAGES_AS_ROWS, 100))


PAGES_AS_ROWS = [dict(zip(("page_id", "url", "html"), p, strict=True)) for p in PAGES]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    frame = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", "".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest() for k in range(200))) for i in range(10, 70)] + PAGES, "page_id long, url string, html string")
    return warc.write(warc.records(frame.repartition(3)), path, file_mb=0)


def files(path):
    return sorted(Path(path.removeprefix("file://")).glob("*.warc.gz"))


def test_text_is_kept_and_others_can_read_it(spark, archive):
    rows = warc.read(spark, archive).where("page_id = 5").collect()
    assert [r["payload"].decode() for r in rows] == [PAGES[6][2]] and rows[0]["http_length"] == len(PAGES[6][2].encode())
    text = gzip.decompress(files(archive)[0].read_bytes())  # plain gzip to any other reader
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    assert warc.read(spark, archive).where("page_id = 2 and target_uri is not null").first()["target_uri"] == "http://a/2%0D%0AX:%20y"


def test_predicates_are_decided_before_the_payload(spark, archive, tmp_path):
    """The end of every long response is overwritten: reading it fails, stepping over it doesn't."""
    for name in files(archive):
        data = bytearray(name.read_bytes())
        if len(data) > 6_000:
            data[-1000:-8] = bytes(992)
        (tmp_path / name.name).write_bytes(data)
    place = f"file://{tmp_path}"
    heads = warc.read(spark, place, payload="false")
    assert heads.count() == 68 and heads.where("payload IS NOT NULL").count() == 0
    assert warc.read(spark, place).where("record_type = 'revisit'").count() == 4  # three of the four equal pages and one of the two empty ones
    with pytest.raises(Exception, match="warc"):
        warc.read(spark, place).where("record_type = 'response' AND page_id = 17").collect()


@pytest.mark.parametrize(
    "condition",
    ["page_id = 4", "page_id IN (1, 2)", "page_id IS NULL", "page_id IS NOT NULL", "page_id >= 58", "NOT (page_id > 2)", "target_uri LIKE 'http://h1%'", "target_uri LIKE '%7'", "target_uri LIKE '%h2/1%'", "record_type <> 'response'", "refers_to <=> NULL", "NOT page_id IS NULL AND page_id < 2 AND http_length > 5", "page_id = 1 OR record_type = 'revisit'"],
)
def test_predicates_mean_what_spark_means(spark, archive, condition):
    whole = spark.createDataFrame(warc.read(spark, archive).collect(), warc.SCHEMA)
    assert Counter(map(str, warc.read(spark, archive).where(condition).collect())) == Counter(map(str, whole.where(condition).collect()))


def test_only_listed_files_are_read(spark, archive):
    place = Path(archive.removeprefix("file://"))
    stray = place / "part-00000-lost-0.warc.gz"
    stray.write_bytes(files(archive)[0].read_bytes())
    assert warc.read(spark, archive, payload="false").count() == 68
    stray.unlink()


OTHER = (
    b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\n  y\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 45\r\n\r\n"
    b"HTTP/1.0 200 OK\r\ncontent-length:  7\r\n\r\npayload\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 5000\r\n\r\n" + b"r" * 5000 + b"\r\n\r\n"
)


@pytest.mark.parametrize("how", ["plain", "one", "each"])
def test_archives_of_others(spark, tmp_path, how):
    parts = [b"WARC/1.0" + p for p in OTHER.split(b"WARC/1.0")[1:]]
    parts[1] = parts[1].replace(b"Content-Length: 45", b"Content-Length: %d" % len(b"HTTP/1.0 200 OK\r\ncontent-length:  7\r\n\r\npayload"))
    data = {"plain": b"".join(parts), "one": gzip.compress(b"".join(parts)), "each": b"".join(map(gzip.compress, parts))}[how]
    (tmp_path / ("x.warc" if how == "plain" else "x.warc.gz")).write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}").select("record_type", "record_id", "target_uri", "http_length", F.col("payload").cast("string")).collect()
    assert [tuple(r) for r in rows] == [("warcinfo", None, None, None, "hello"), ("response", "urn:uuid:1", "http://x/ y", 7, "payload"), ("resource", None, None, None, "r" * 5000)]
    (tmp_path / ("x.warc" if how == "plain" else "x.warc.gz")).write_bytes(data[: len(data) - 30] if how != "plain" else data[:-3000])
    assert warc.read(spark, f"file://{tmp_path}", mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="x.warc"):
        warc.read(spark, f"file://{tmp_path}").collect()
