"""Near words by comparing all with all; lists short and long; the bound on affected grams; forms and roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from brute import lower
from factledger.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words, ratio=10):
    out = {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = found[0] if found and -found[0][0] >= ratio * n else None
        out[w] = (n, len(found), form and form[1], form and -form[0])
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        yield w, *out[w], root


def found(frame):
    return Counter(map(tuple, frame.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("most", [64, 2])
def test_random_words(spark, most, monkeypatch):
    """Few letters and close words; with lists of at most 2 words nearly all are merged by their open parts."""
    monkeypatch.setattr(spelling, "MOST", most)
    rnd = random.Random(most)
    counts = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))): 10 ** rnd.randint(0, 5) for _ in range(700)}
    counts |= {"internationalisation" + x: n for x, n in (("", 5000), ("s", 50), ("x", 3), ("es", 4))}
    counts |= {"ba" * 400: 7, "ba" * 400 + "b": 90, "b" + "ba" * 400: 1000}
    assert found(spelling.group(words_of(spark, counts))) == Counter(by_hand(counts))


def test_one_edit_spoils_no_more_grams_than_said():
    rnd = random.Random(3)
    for _ in range(2000):
        frequent = {}
        for _ in range(rnd.randint(0, 20)):
            g = "".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4)))
            frequent |= {g[:k]: frequent.get(g[:k], 0) + 1 for k in range(2, len(g) + 1)}
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 9)))
        i = rnd.randrange(len(w) + 1)
        v = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "c" + w[i:], w[:i] + "c" + w[i + 1 :]])
        text = lambda x: Counter(x[a : min(e, len(x))] for a, e in spelling.decompose(x, frequent))  # noqa: E731,B023
        if v and v != w:
            shared = sum((text(w) & text(v)).values())
            assert all(shared >= len(g) - spelling.affected(g, len(x)) for x in (w, v) for g in [spelling.decompose(x, frequent)])


def test_chains_and_ties(spark):
    counts = {"abcdefg": 10**6, "abcdefgh": 10**4, "abcdefghi": 10**2, "abcdefghij": 10, "abcdefghijk": 1, "zbcdefg": 1, "abcdefz": 10**6, "lonelyword": 3}
    rows = {r["word"]: r for r in spelling.group(words_of(spark, counts)).collect()}
    assert rows["abcdefghijk"]["root"] == "abcdefg" and rows["zbcdefg"]["form"] == "abcdefg" and rows["lonelyword"]["n_near"] == 0
    assert rows["abcdefgh"]["form"] == "abcdefg" and rows["abcdefg"]["form"] is None  # a tie between equal counts has no form
    assert spelling.group(words_of(spark, {"a": 1}).limit(0)).count() == 0


def test_counts(spark, awkward, tmp_path):
    docs = [(1, "Zürich zurich ZÜRICH Basel-Basel straße" * 3), (None, "Zürich Genève genève"), (2, None), (3, ""), (4, "misspelling " * 200 + "x" * 3000 + "123longword_longword"), (4, "misspelling")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    for path in (str(tmp_path), awkward):
        counts = Counter()
        for r in spark.read.parquet(f"{path}/documents.parquet").collect():
            for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
                run = lower(run)
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
        counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
        assert found(queries.op11_spelling_variants(spark, path)) == Counter(by_hand(counts))
