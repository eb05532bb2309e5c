r"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Words are runs of ``[^\x20\x09-\x0D]``. Each document gets its statistics in one pass over its whole text; the trees
are fitted on at most ``sample_rows`` labelled documents (those with the smallest hash of doc_id), flattened
into numpy node arrays and applied to every document. Features in ``RISING`` can only raise the
estimated share of bad documents. Bad is a document of quality 0 or, where ``labels`` has the column, a toxic one. Counts of
characters can't tell the latter, so one statistic is the number of harsh words: those (letters only, lower-cased) that stand in
toxic documents of the sample many times as often as in its others; the sample bounds their number.

A document is rejected by the base rule (under 20 words, or over 30 % of its words in repeated 8-word
windows) or by the trees. Defined results: null texts have no words and are rejected; labels that are null are
ignored; without labels of both kinds the base rule decides alone; repeated rows are judged one by one; ties for the sample
go by the labels themselves; a very long text is counted whole; ``keep_good`` carries any other column along, whatever its name;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, small_batches, text_bytes

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
EDGES = bytes(b for b in range(128) if not chr(b).isalpha())
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_bars", "n_harsh")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "bars", "line_words", "harsh")
RISING = ("symbols", "dup_lines", "repeats", "harsh")
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that the text has twice or more, and the number of distinct words."""
    ids: dict[bytes, int] = {}
    codes = [ids.setdefault(w, len(ids)) for w in words]
    if len(words) <= window:
        return 0, len(ids)
    with np.errstate(over="ignore"):
        mixed = mix64(np.array(codes, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        n = len(codes) - window + 1
        keys = np.zeros(n, np.uint64)
        for k in range(window):
            keys = keys * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0, len(ids)
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(starts), 1)
    np.add.at(edge, np.flatnonzero(starts) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum()), len(ids)


def repeated_lines(lines: list[bytes]) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return again


def bare(words: Iterable[bytes]) -> list[bytes]:
    """Words without what isn't a letter at their ends, in lower case (ASCII)."""
    return [w.lower().strip(EDGES) for w in words]


def statistics(raw: bytes, harsh: frozenset[bytes] = frozenset()) -> list[int]:
    """The counts named in ``COUNTS``; bytes.split() and lower() know ASCII only, as the word rule does."""
    words, lines = raw.split(), raw.split(b"\n")
    solid = raw.translate(None, SPACE)
    without = lambda some: len(solid) - len(solid.translate(None, some))
    repeats, distinct = repeated_words(words)
    return [
        len(words), len(solid.decode("utf-8", "replace")), without(SYMBOLS), repeated_lines(lines), repeats,
        len(lines), distinct, without(UPPER), without(DIGITS), without(MARKS), solid.count(b"|"),
        sum(map(harsh.__contains__, bare(words))) if harsh else 0,
    ]


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.astype(np.float64).T, strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_bars"] / words, c["n_words"] / np.maximum(c["n_lines"], 1), np.minimum(c["n_harsh"], 10),
    ])


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    harsh: frozenset[bytes] = frozenset()

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, rising: tuple[int, ...], trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted logistic trees on binned features; children of a split on a rising feature keep its order."""
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    codes = np.column_stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T, strict=True)])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots, score = [], np.full(len(y), base)

    def grow(rows: np.ndarray, low: float, high: float, left_depth: int) -> int:
        g, h = grad[rows], hess[rows]
        weight = lambda a, b: np.clip(-a / (b + ridge), low, high)
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
        own = float(weight(g.sum(), h.sum()))
        me = len(nodes)
        nodes.append([0, 0.0, me, me, own * rate])
        if not left_depth or h.sum() < 2 * least:
            return me
        best = (1e-6, None)
        for f in range(x.shape[1]):
            k = len(edges[f]) + 1
            gs, hs = np.cumsum(np.bincount(codes[rows, f], g, k))[:-1], np.cumsum(np.bincount(codes[rows, f], h, k))[:-1]
            gr, hr = g.sum() - gs, h.sum() - hs
            wl, wr = weight(gs, hs), weight(gr, hr)
            gain = gain_of(gs, hs, wl) + gain_of(gr, hr, wr) - gain_of(g.sum(), h.sum(), own)
            gain[(hs < least) | (hr < least) | ((wl > wr) if f in rising else False)] = -1
            if len(gain) and gain.max() > best[0]:
                at = int(gain.argmax())
                best = (float(gain[at]), (f, at, float(wl[at]), float(wr[at])))
        if best[1] is None:
            return me
        f, at, wl, wr = best[1]
        below = codes[rows, f] <= at
        middle = (wl + wr) / 2
        bounds = ((low, middle), (middle, high)) if f in rising else ((low, high), (low, high))
        nodes[me][:2] = [f, float(edges[f][at])]
        nodes[me][2] = grow(rows[below], *bounds[0], left_depth - 1)
        nodes[me][3] = grow(rows[~below], *bounds[1], left_depth - 1)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), -4.0, 4.0, depth))
        one = Trees(np.array(roots[-1:]), *_columns(nodes), depth, 0.0)
        score = score + _raw(one, x)
    return Trees(np.array(roots), *_columns(nodes), depth, base)


def _columns(nodes: list[list[float]]) -> tuple[np.ndarray, ...]:
    f, c, l, r, v = zip(*nodes, strict=True)
    return np.array(f, np.int32), np.array(c), np.array(l, np.int32), np.array(r, np.int32), np.array(v)


def _raw(trees: Trees, x: np.ndarray) -> np.ndarray:
    p = trees.probability(x)
    return np.log(p / (1 - p))


def _statistics_of(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...], harsh: frozenset[bytes] = frozenset()) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = np.array([statistics(t, harsh) for t in text_bytes(b["text"])], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), *map(pa.array, counts.T)], [*keep, *COUNTS])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees | None:
    """Trees for the share of bad documents (quality 0 or toxic), from at most ``sample_rows`` labelled documents."""
    small_batches(docs.sparkSession)
    toxic = F.coalesce(F.col("toxic"), F.lit(0)).cast("int") if "toxic" in labels.columns else F.lit(0)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), toxic.alias("toxic")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    some = known.orderBy(F.xxhash64(F.lit(10), "doc_id"), "quality", "toxic").limit(sample_rows)
    held = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample_rows rows of numbers
    held = cut(held.select("text", "quality", "toxic"), "labelled")
    harsh = harsh_words(held)
    schema = ", ".join(["quality int", "toxic int", *(f"{c} long" for c in COUNTS)])
    rows = (
        held.mapInArrow(lambda it: _statistics_of(it, ("quality", "toxic"), harsh), schema)
        .orderBy(F.xxhash64(*COUNTS), "quality", "toxic").limit(sample_rows).collect()
    )
    bad = np.array([r["quality"] == 0 or r["toxic"] == 1 for r in rows], np.float64)
    if not 0 < bad.sum() < len(bad):
        return None
    return replace(fit(features(np.array([r[2:] for r in rows], np.int64)), bad, tuple(map(FEATURES.index, RISING))), harsh=harsh)


def harsh_words(labelled: DataFrame, share: float = 0.05, least: int = 8, times: float = 20.0) -> frozenset[bytes]:
    """Words that a ``share`` of the sample's toxic texts have (``least`` of them at any rate) and that are ``times`` as frequent in
    them as in the others. Texts are counted once, and the share is more than a group of like texts has: or else any
    word of a document that was copied often would do.
    """
    labelled = labelled.dropDuplicates(["text", "toxic"])  # at most the sample's rows
    sizes = labelled.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    if not n.get(1) or not n.get(0):
        return frozenset()
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,}(?![a-z])"), F.lit(0)))).alias("word")
    counts = labelled.select("toxic", word).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") == 0).alias("no"))
    ratio = (F.col("yes") / n[1]) / ((F.col("no") + 0.5) / n[0])
    found = counts.where((F.col("yes") >= max(least, share * n[1])) & (ratio >= times))
    return frozenset(r["word"].encode() for r in found.select("word").collect())


def verdicts(counts: np.ndarray, trees: Trees | None, reject_above: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, bad (the trees' estimate) and kept."""
    n, repeats = counts[:, 0], counts[:, 4]
    failed = (n < 20) | (100 * repeats > 30 * n)
    bad = trees.probability(features(counts)) if trees and len(counts) else np.zeros(len(counts))
    return failed, bad, ~failed & (bad <= reject_above)


def judge(docs: DataFrame, trees: Trees | None, reject_above: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, bad and kept for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _statistics_of(batches, ("doc_id",), trees.harsh if trees else frozenset()):
            counts = np.column_stack([b[c].to_numpy() for c in COUNTS]) if len(b) else np.zeros((0, len(COUNTS)), np.int64)
            failed, bad, kept = verdicts(counts, trees, reject_above)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(bad), pa.array(kept)], [*b.schema.names, "base_failed", "bad", "kept"])

    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS), "base_failed boolean", "bad double", "kept boolean"])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees | None, reject_above: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't rejected."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([statistics(t, trees.harsh if trees else frozenset()) for t in text_bytes(b["text"])], np.int64).reshape(-1, len(COUNTS))
            yield b.filter(pa.array(verdicts(counts, trees, reject_above)[2]))

    return docs.mapInArrow(run, docs.schema)
