"""Splitting at line ends, blocks of pages by hand, and a stream that gives the rows of the batch, over restarts and pages out of order."""

import random

import pytest

from factledger.operators import structure
from factledger.streaming import pages as P


def split_by_hand(text, most):
    """Word for word what is asked for: the last line end within the budget, else the next one after it."""
    if len(text) <= most:
        return [text]
    out, rest = [], text
    while len(rest) > most:
        at = rest[:most].rfind("\n")
        at = rest.find("\n", most) if at == -1 else at
        if at == -1:
            return out + [rest.strip()]
        out += [rest[:at].strip()] if rest[:at].strip() else []
        rest = rest[at:].lstrip("\n")
    return out + ([rest.strip()] if rest.strip() else [])


def test_split():
    first, second = "First sentence is short.", "Second sentence is a bit longer and exceeds the limit."
    assert structure.split_lines(f"{first}\n{second}", 50) == [first, second]
    whole = "This is one very long paragraph with absolutely no newline characters in it."
    assert structure.split_lines(whole, 50) == [whole]
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice("ab \n\n") for _ in range(rnd.randint(0, 60)))
        most = rnd.randint(1, 12)
        assert [p for p in structure.split_lines(text, most) if p] == [p for p in split_by_hand(text, most) if p], (text, most)
    long = "x" * 500_000 + "\n" + "y\n" * 500_000
    assert max(map(len, structure.split_lines(long)[1:])) <= structure.MOST


PAGES = [
    ("r", 0, "# One\n## Two\nFirst part of the document.\n\n| a | b |\n|---|---|\n| 1 | 2 |\nNote 12."),
    ("r", 1, "Still under Two.\n#### Deep\ntext"),
    ("r", 2, None), ("r", 3, ""), ("r", 4, "\n  \n"), ("r", 5, "## Three\n#No header\n" + "line of words\n" * 400 + "| lone | pipe |"),
    ("r", 6, "end"), ("s", 0, "| x | y |\nno rule"), ("s", 1, "#  Title  \n"), ("s", 2, "after\n| t |\n| --- |\n\n\ntail"), (None, 0, "without a record"), (None, 1, "and on"),
]


def by_hand(pages, most=structure.MOST):
    state = {}
    for record, page, text in sorted(pages, key=lambda p: (str(p[0]), p[1])):
        blocks, *state[record] = structure.page_blocks(text, *state.get(record, ([], "")), most)
        for k, b in enumerate(blocks):
            yield record, page, k, b["kind"], tuple(b["path"]), b["content"]


def rows(frame):
    return sorted(((r["record"], r["page"], r["seq"], r["kind"], tuple(r["path"]), r["content"]) for r in frame.collect()), key=str)


def test_blocks(spark):
    frame = spark.createDataFrame(PAGES, "record string, page long, text string").repartition(3)
    found = rows(structure.blocks_of_pages(frame, "record", "page"))
    assert found == sorted(by_hand(PAGES), key=str)
    r = {(x[1], x[2]): x for x in found if x[0] == "r"}
    assert r[0, 1][3:] == ("TABLE", ("One", "Two"), "| a | b |\n|---|---|\n| 1 | 2 |")  # a table says nothing of what came before
    assert r[0, 2][5] == "[Previous Context: | a | b |\n|---|---|\n| 1 | 2 |]\n\nNote 12."  # but the text behind it does
    assert r[1, 0][4] == ("One", "Two") and r[1, 0][5].startswith("[Previous Context: Note 12.]")
    assert r[1, 1][4] == ("One", "Two", "Deep") and r[5, 0][4] == ("One", "Three")
    assert [len(x[5]) > 3000 for x in found if x[0] == "r" and x[1] == 5].count(True) <= 1  # a piece and its prefix
    assert structure.blocks_of_pages(frame.limit(0), "record", "page").count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, seed):
    """Pages in random order over several micro-batches, with repeats, and a restart of the query after each."""
    pages = [p for p in PAGES if p[0]]
    order = pages + pages[:3]
    random.Random(seed).shuffle(order)
    source, sink, place = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for part in (order[:4], order[4:9], order[9:]):
        spark.createDataFrame(part, "record string, page long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("record string, page long, text string").parquet(source)
        job = P.stream_blocks(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start()
        job.awaitTermination()
    assert rows(spark.read.parquet(sink)) == sorted(by_hand(pages), key=str)
