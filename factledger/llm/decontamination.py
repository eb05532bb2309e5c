r"""Benchmark decontamination with a generalised suffix automaton of test items.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. The automaton holds the word
sequences of all items. A document's words are streamed through it; at each word it knows the longest
suffix that occurs in an item. Where that reaches ``window`` words, the last ``window`` words are hit; an item of
fewer words is hit where it occurs whole. A document is contaminated if its hit words reach ``coverage``
of its words; ``remove`` drops such documents, or cuts the hit spans out of them.

Items are cut into pieces that overlap by ``window - 1`` words, and pieces are dealt to chunks of about
``chunk_words`` words. One chunk's automaton is broadcast at a time, so its size does not depend on the
number of items. With more chunks the documents are passed over once by a sieve, a Bloom filter of all windows
(64 bits a word, 128 MB at most; a fuller one only lets more documents through), and written once; only those that may hold a window are streamed through
each chunk's automaton, which alone decides.

Defined results: null and empty texts have no words and are never contaminated, such items never occur;
an item without an id is known as the empty string; items that repeat an id are one item; repeated documents are judged one by
one; a very long text is streamed whole; items that share a window are all named; ``remove`` carries any other column along, whatever
its name; empty tables give an empty result or one without hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix64, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Generalised suffix automaton over words; every state knows the items whose windows end in it."""

    def __init__(self, pieces: list[tuple[str, list[str], bool]], window: int):
        self.window, self.ids = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words], whole) for item, words, whole in pieces if words]
        self.shortest = min([window, *(len(words) for _, words, _ in coded)])
        for _, words, _ in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, words, whole in coded:
            state = 0
            for i, w in enumerate(words):
                state = self.step[state][w]  # an item's prefixes are all in the automaton
                if i + 1 >= window:
                    self.full.setdefault(self._holding(state, window), set()).add(item)
            if whole and len(words) < window:
                self.short.setdefault(self._holding(state, len(words)), {}).setdefault(len(words), set()).add(item)
        self.window_state = [self._holding(s, window) if self.length[s] >= window else 0 for s in range(len(self.step))]
        self.shorts = [self._shorts(s) for s in range(len(self.step))] if self.short else None

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _holding(self, state: int, length: int) -> int:
        """The state on the suffix path that holds the suffix of that length."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _shorts(self, state: int) -> list[tuple[int, set[str]]]:
        found = []
        while state > 0:
            found += self.short.get(state, {}).items()
            state = self.link[state]
        return found

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (start, end) in words, merged, and the items found."""
        codes = np.array([self.ids.get(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        step, link, length = self.step, self.link, self.length
        for begin, end in edges.reshape(-1, 2).tolist():  # runs of words that items have: matches can't leave them
            if end - begin < self.shortest:
                continue
            state = longest = 0
            for at, w in enumerate(codes[begin:end].tolist(), begin + 1):
                while state and w not in step[state]:
                    state = link[state]
                    longest = length[state]
                state = step[state].get(w, 0)
                longest = longest + 1 if state else 0
                reach = 0
                if longest >= self.window:
                    reach = self.window
                    items |= self.full.get(self.window_state[state], ())
                if self.shorts:
                    for size, names in self.shorts[state]:
                        if size <= longest:
                            reach = max(reach, size)
                            items |= names
                if reach:
                    start = at - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, items


class Sieve:
    """Bloom filter of window hashes: a document without any of them has no hit; with one it may have."""

    def __init__(self, window: int, words: int, marks: int = 4):
        self.window, self.marks, self.sizes = window, marks, set()
        self.bits = np.zeros(1 << (min(30, max(16, (64 * words).bit_length())) - 3), np.uint8)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))

    @staticmethod
    def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) - size + 1
        rolled = np.zeros(n, np.uint64)
        for j in range(size):
            rolled = mix64(rolled + codes[j : j + n])
        return rolled

    def _place(self, hashes: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
        slots = mix64(hashes + np.uint64(mark)) & np.uint64(8 * len(self.bits) - 1)
        return slots >> np.uint64(3), (slots & np.uint64(7)).astype(np.uint8)

    def add(self, words: list[str]) -> None:
        size = min(self.window, len(words))
        self.sizes.add(size)
        hashes = self._hashes(self._codes(words), size)
        for mark in range(self.marks):
            byte, bit = self._place(hashes, mark)
            np.bitwise_or.at(self.bits, byte, np.left_shift(np.uint8(1), bit))

    def lets_through(self, words: list[str]) -> bool:
        codes = self._codes(words)
        for size in self.sizes:
            hashes = self._hashes(codes, size) if len(words) >= size else codes[:0]
            for mark in range(self.marks):
                byte, bit = self._place(hashes, mark)
                hashes = hashes[(self.bits[byte] >> bit & 1).astype(bool)]
            if len(hashes):
                return True
        return False


def pieces(items: DataFrame, window: int, longest: int = 4096) -> DataFrame:
    """item, words, whole: each item's words, cut with an overlap where there are many."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(SQL_WORD), F.lit(0))
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(longest))))
        .select("item", F.slice("w", F.col("start") + 1, longest + window - 1).alias("words"), (F.size("w") < window).alias("whole"))
    )


def match(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), chunk_words: int = 100_000, into: str = "_match") -> DataFrame:
    """``docs`` (all columns) with n_words, n_hit, spans, item_ids, contaminated in a struct named ``into``.

    Spans are in words; ``coverage`` is a fraction (numerator, denominator). A column of that name gives way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cuts = pieces(items, window)
    total = cuts.agg(F.sum(F.size("words"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_words))
    cuts = cuts.withColumn("chunk", F.pmod(F.xxhash64("item", "words"), F.lit(chunks)))
    found = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<start: int, end: int>>, item_ids: array<string>, contaminated: boolean>"
    frame = docs.withColumn(into, F.lit(None).cast(found))
    if chunks == 1:
        return frame.mapInArrow(_pass(spark.sparkContext.broadcast(Automaton(_rows(cuts), window)), coverage, into), frame.schema)
    cuts = cut(cuts.repartitionByRange("chunk").sortWithinPartitions("chunk"), "pieces")
    sieve = Sieve(window, total)
    for k in range(chunks):
        for _, words, _ in _rows(cuts.where(F.col("chunk") == k)):
            sieve.add(words)
    through = fresh(frame, "_through")
    marked = frame.withColumn(through, F.lit(False))
    marked = cut(marked.mapInArrow(_sift(spark.sparkContext.broadcast(sieve), into, through), marked.schema), "sifted")
    suspects = marked.where(F.col(through)).drop(through)
    for k in range(chunks):
        automaton = spark.sparkContext.broadcast(Automaton(_rows(cuts.where(F.col("chunk") == k)), window))
        suspects = cut(suspects.mapInArrow(_pass(automaton, coverage, into), frame.schema), "decontaminate")
    return marked.where(~F.col(through)).drop(through).unionByName(suspects)


def _rows(chunk: DataFrame) -> list[tuple[str, list[str], bool]]:
    """One chunk's pieces, about ``chunk_words`` words, in a fixed order."""
    return [(r["item"], r["words"], r["whole"]) for r in sorted(chunk.select("item", "words", "whole").collect())]


def _sift(sieve, into: str, through: str):
    """Documents as without hits, and whether they may have one after all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, passed = [], []
            for text in b["text"].to_pylist():
                words = WORD.findall((text or "").translate(TO_LOWER))
                out.append({"n_words": len(words), "n_hit": 0, "spans": [], "item_ids": [], "contaminated": False})
                passed.append(sieve.value.lets_through(words))
            for name, values in ((into, out), (through, passed)):
                at = b.schema.get_field_index(name)
                b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
            yield b

    return run


def _pass(automaton, coverage: tuple[int, int], into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for b in batches:
            out = []
            for text, before in zip(b["text"].to_pylist(), b[into].to_pylist(), strict=True):
                words = WORD.findall((text or "").translate(TO_LOWER))
                spans, items = machine.match(words)
                if before:
                    spans = _merged(spans + [(s["start"], s["end"]) for s in before["spans"]])
                    items |= set(before["item_ids"])
                hit = sum(e - s for s, e in spans)
                out.append({
                    "n_words": len(words), "n_hit": hit, "spans": [{"start": s, "end": e} for s, e in spans], "item_ids": sorted(items),
                    "contaminated": hit > 0 and coverage[1] * hit >= coverage[0] * len(words),
                })
            at = b.schema.get_field_index(into)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in WORD.finditer((text or "").translate(TO_LOWER))]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s][0]])
        done = at[e - 1][1]
    return "".join([*out, (text or "")[done:]])


def remove(docs: DataFrame, items: DataFrame, how: str = "drop", **limits) -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with their hit spans cut out (``cut``)."""
    columns, into = docs.columns, fresh(docs, "_match")
    found = match(docs, items, into=into, **limits)
    if how == "drop":
        return found.where(~F.col(f"{into}.contaminated")).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                cut_spans(t, [(s["start"], s["end"]) for s in m["spans"]]) if m["contaminated"] else t
                for t, m in zip(b["text"].to_pylist(), b[into].to_pylist(), strict=True)
            ]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).select(columns)

    return found.mapInArrow(run, docs.schema)
