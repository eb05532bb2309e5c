"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form that each is a variant of.

Variable-length grams. The dictionary keeps a gram of ``SHORTEST`` letters or more only as long as more than a share of all gram positions hold it
(``FREQUENT``): so it has fewer than that many grams, whatever the vocabulary. At each of its positions a word takes the shortest gram that is
not in the dictionary, ``LONGEST`` letters at most, or what is left of the word: rare letters give short grams, common ones long grams.

Affected grams. Whether a word has a gram hangs on the gram's own letters alone (and on the word's end, where it ran into it). One edit therefore
spoils the grams that cover its place and no other; ``affected`` is the largest number of them over all places. Two near words share
all other grams, in the same order, so with grams in a fixed order (rare ones first) the first that they share is among the first ``affected + 1`` of both: only
those lists are merged. A shared gram left of the edit stands behind the same beginning, one right of it before the same end; lists are therefore of words
that share the gram with all before it, or with all behind it. Words of which one edit can spoil all grams share one more list, whole.

A list with more than ``MOST`` words is merged by what its words leave open: two near words have an open part in common once a letter of one or both is
dropped, so their lists are keyed by that. All candidates are then verified. No list of any size is paired with itself in whole.

Counting takes whole texts; a task holds the distinct words of ``FLUSH`` at most.

Defined results: null and empty texts have no words, a null id is written as nothing; words are compared by code point; equal rows count each; ties for
a form go to the smallest word; a word without near words has none of them and is its own root; words of any length are one row; an empty table
gives an empty result; only the named columns are read, so no other can clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

SHORTEST, LONGEST = 2, 5
FREQUENT, MOST, FLUSH = 200_000, 64, 300_000
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E680
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def count_runs(docs: DataFrame, runs: str, shortest: int, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, n: how often each run that ``runs`` matches (A-Z in lower case) stands in ``docs`` (doc_id, text).

    ``change`` gets the row's id as text and the run, and gives the word to be counted. Words shorter than ``shortest`` go.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, found = re.compile(runs), Counter()
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                here = Counter()
                for run, n in Counter(pattern.findall(text or "")).items():
                    if len(run) >= shortest:
                        here[run.translate(LOWER)] += n
                doc = "" if doc is None else str(doc)
                for run, n in here.items():
                    word = change(doc, run) if change else run
                    if len(word) >= shortest:
                        found[word] += n
                if len(found) > FLUSH:
                    yield flushed()
                    found.clear()
        yield flushed()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame) -> dict[str, int]:
    """Grams shorter than ``LONGEST`` that hold more than one of ``FREQUENT`` gram positions each, with their counts."""
    parts = ", ".join(f"transform(sequence(1, greatest(length(word) - {q - 1}, 1)), i -> substring(word, i, {q}))" for q in range(SHORTEST, LONGEST + 1))
    grams = words.select(F.expr(f"explode(concat({parts}))").alias("gram")).groupBy("gram").count()
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(MOST, letters * (LONGEST - SHORTEST + 1) // FREQUENT)
    return {r["gram"]: r["count"] for r in grams.where(F.col("count") > least).collect()}  # fewer than FREQUENT


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """The (start, end) of a word's grams. One that is still frequent at the word's end has an end behind it: it hangs on the end too."""
    size, out = len(word), []
    for a in range(max(1, size - SHORTEST + 1)):
        e = min(a + SHORTEST, size)
        while e < size and e - a < LONGEST and word[a:e] in frequent:
            e += 1
        out.append((a, e + (e == size and e - a < LONGEST and word[a:e] in frequent)))
    return out


def affected(grams: list[tuple[int, int]], size: int) -> int:
    """The most grams that one edit can spoil."""
    steps = [0] * (size + 2)
    for a, e in grams:
        steps[a] += 1
        steps[e] -= 1
    most = now = 0
    for s in steps:
        now += s
        most = max(most, now)
    return most


def lists_of(word: str, frequent: dict[str, int]) -> set[tuple[int, int]]:
    """(key, split) of the lists a word is in; the part left open is before -split, or from split on."""
    grams = decompose(word, frequent)
    spoiled, size = affected(grams, len(word)), len(word)

    def order(g: tuple[int, int]) -> tuple:
        text = word[g[0] : g[1]]
        return frequent.get(text, 0), xxhash.xxh64_intdigest(text), text, g

    out = set() if spoiled < len(grams) else {(0, 0)}
    for a, e in sorted(grams, key=order)[: spoiled + 1]:
        e = min(e, size)
        out.add((signed(xxhash.xxh64_intdigest(word[:e], 1)), e))
        out.add((signed(xxhash.xxh64_intdigest(word[a:], 2)), -a or -size - 1))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def open_part(word: str, split: int) -> str:
    return word[split:] if split >= 0 else "" if split < -len(word) else word[:-split]


def reductions(text: str) -> set[int]:
    """Hashes of ``text`` and of all that one letter less makes of it, in time that grows with its length only."""
    heads, powers = [0], [1]
    for c in text:
        heads.append((heads[-1] * BASE + ord(c) + 1) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    whole, n = heads[-1], len(text)
    return {whole} | {(heads[i] * powers[n - 1 - i] + whole - heads[i + 1] * powers[n - 1 - i]) % PRIME for i in range(n)}


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n (a < b): all pairs of ``words`` (word, n) at a distance of exactly one."""
    spark = words.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    known = spark.sparkContext.broadcast(dictionary(words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(lists_of(w, known.value)) for w in batch.column("word").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            flat = [x for several in lists for x in several]
            columns = [pa.array([k for k, _ in flat], pa.int64()), pa.array([s for _, s in flat], pa.int64()), batch.column("word").take(at), batch.column("n").take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "split", "word", "n"])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "split", "word", "n")), strict=True)
            keyed = ((signed(xxhash.xxh64_intdigest(h.to_bytes(8, "big"), k & (2**64 - 1))), w, n) for k, s, w, n in rows for h in reductions(open_part(w, s)))
            while part := [x for _, x in zip(range(50_000), keyed)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.string(), pa.int64()))], names=["key", "word", "n"])

    listed = cut(words.mapInArrow(index, "key long, split long, word string, n long"), "gram-lists")
    long = cut(listed.groupBy("key").count().where(F.col("count") > MOST).select("key"), "gram-long")
    short = listed.join(long, "key", "left_anti").select("key", "word", "n")
    split = listed.join(long, "key", "left_semi").mapInArrow(divide, "key long, word string, n long")
    lists = cut(short.unionByName(split), "gram-merged")
    a, b = (lists.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a["key"] == b["key"]) & near).select("a", "a_n", "b", "b_n").distinct()


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for ``words`` (word, n), each word once.

    form: the near word of the largest n, if that is at least ``ratio`` times the word's own. root: the last form from form to form.
    """
    words = cut(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("near")).alias("best")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("minus"), F.col("a").alias("near")).alias("best"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    formed = -F.col("best.minus") >= F.col("n") * ratio
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")
    )
    out = cut(out, "spelling-forms")
    # each step multiplies n by the ratio, so chains are short; every round doubles how far they are followed
    most = out.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio))) if ratio > 1 else most
    links = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        links = cut(links, "spelling-roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
