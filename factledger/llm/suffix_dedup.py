r"""Removal of repeated byte strings with suffix arrays.

Every byte is removed that lies in a ``LENGTH``-byte string which also starts earlier in the corpus (smaller doc_id,
or earlier in the same document). Strings are judged on the input.

Comparing every shard's suffix array with every other's would be quadratic in the shards, so shards are made
by content. Each ``LENGTH``-byte window has an anchor, the ``GRAM``-byte string in it with the smallest hash; equal windows have
equal anchors at the same place. Consecutive windows of one anchor form a run.

1. Each task lets only the first of runs with the same bytes through and marks the others as repeats (for runs that it met often
   enough to remember), so a passage that a third of all documents share comes from a task once. Runs are then dealt by
   their anchor's hash. Anchors that occur once are done. Of runs with the same bytes the first stays and all others are
   repeats: copies never go further, however many there are.
2. First runs whose anchor also has other runs bring their bytes to the anchor's shard. There a suffix
   array is built by Larsson-Sadakane refinement in numpy, common prefixes of neighbours come from Kasai's
   algorithm, walked over all runs of the shard in lockstep, and windows that share ``LENGTH`` bytes are repeats of the
   first of them. A shard too large for one array is cut into blocks; a block's windows are looked up among those of the
   blocks before by binary search.
3. An anchor with more than ``PARTS`` blocks is dealt to several shards by document. Each names the first of its windows by a
   128-bit digest, and of equal digests all but the first are repeats: so no shard grows with the corpus.
4. Repeats come back to their documents as ranges of window starts.

Defined results: null texts are empty; a document without a doc_id is compared with nothing and kept whole; rows
with the same doc_id and text are one document, of the same doc_id with different texts the one with the smaller text hash comes
first; a very long text is cut into overlapping parts of ``PIECE`` bytes; an empty table gives an empty result; other columns are not
read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, small_batches, text_bytes

LENGTH, GRAM = 100, 32
PIECE, BLOCK, PARTS = 2 << 20, 4 << 20, 16
REMEMBERED = 200_000  # runs that a task remembers since they came twice


def _words(buffer: np.ndarray, kind: str) -> np.ndarray:
    """The 8-byte word that starts at each byte; ``buffer`` has 8 spare bytes at its end."""
    return np.ndarray(len(buffer) - 8, kind, buffer.tobytes(), strides=(1,))


def runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run; documents lie at [starts, ends) of ``raw``."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none.astype(np.uint64)
    width = LENGTH - GRAM + 1
    word = _words(np.concatenate((raw, np.zeros(8, np.uint8))), "<u8")
    n = len(raw) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        grams = (grams ^ word[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(29)
    grams = mix64(grams)
    # the place in the low bits makes every key differ and the leftmost of equal grams the smallest
    keys = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    anchor = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(m + 1, np.int8)  # windows that lie in one document
    long = ends - starts >= LENGTH
    inside[starts[long]] += 1
    inside[ends[long] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside)[:m] > 0)
    if not len(at):
        return none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1) | np.isin(at[1:], starts))))
    first = at[new]
    return first, np.diff(np.append(new, len(at))), grams[anchor[first]]


def _pieces(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Documents in batches of about ``PIECE`` bytes; long ones in parts that overlap by ``LENGTH - 1``."""
    held, size = [], 0
    for doc_id, mark, raw in docs:
        if len(raw) < LENGTH:
            continue
        for base in range(0, len(raw) - LENGTH + 1, PIECE):
            part = raw[base : base + PIECE + LENGTH - 1]
            held.append((doc_id, mark, base, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


RUN = ("anchor", "same", "doc_id", "mark", "start", "n")


class Firsts:
    """Of runs with equal bytes the first in document order; all others are repeats.

    A batch is judged by sorting; runs that came twice in a batch are remembered, so later batches are judged with them.
    """

    def __init__(self):
        self.held: dict[int, tuple] = {}

    def __call__(self, c: dict[str, np.ndarray]) -> list[pa.RecordBatch]:
        order = np.lexsort((c["start"], c["mark"], c["doc_id"], c["anchor"], c["same"]))
        c = {k: v[order] for k, v in c.items()}
        equal = lambda *names: np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in names])
        head = np.concatenate(([True], ~equal("same", "anchor")))
        given_twice = np.concatenate(([False], equal(*RUN)))
        several = head & np.append(~head[1:], False)
        known = head & np.fromiter((k in self.held for k in c["same"].tolist()), bool, len(head)) if self.held else np.zeros(len(head), bool)
        repeat = ~head & ~given_twice
        out, late = head & ~several & ~known, []
        for at in np.flatnonzero(several | known).tolist():
            new = tuple(int(c[k][at]) for k in RUN)
            old = self.held.setdefault(new[1], new)
            if old[0] != new[0] or old is new:  # another anchor under the same hash goes on alone
                out[at] = old is not new
            elif old[2:5] != new[2:5]:
                first, other = sorted((old, new), key=lambda r: r[2:])
                self.held[new[1]] = first
                late.append(other)
        found = [self._rows([c[k][out] for k in RUN], False), self._rows([c[k][repeat] for k in RUN], True)]
        if late:
            found.append(self._rows([np.array(v, np.int64) for v in zip(*late, strict=True)], True))
        return found + (self.rest() if len(self.held) > REMEMBERED else [])

    def rest(self) -> list[pa.RecordBatch]:
        rows, self.held = list(self.held.values()), {}
        return [self._rows([np.array(v, np.int64) for v in zip(*rows, strict=True)], False)] if rows else []

    @staticmethod
    def _rows(columns: list[np.ndarray], repeat: bool) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 5 + (pa.int32(),)
        # repeats are judged: they are dealt evenly, by where they stand
        deal = columns[2] * 1_000_003 + columns[4] if repeat else columns[0]
        arrays = [pa.array(v.astype(np.int32) if t == pa.int32() else v, t) for v, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(deal), pa.array(np.full(len(deal), repeat))], [*RUN, "deal", "repeat"])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = (d for b in batches for d in zip(b["doc_id"].to_pylist(), b["mark"].to_pylist(), text_bytes(b["text"]), strict=True))
    firsts = Firsts()
    for batch in _pieces(docs):
        joined = b"".join(p for *_, p in batch)
        ends = np.cumsum([len(p) for *_, p in batch])
        starts = np.concatenate(([0], ends[:-1]))
        first, count, anchor = runs(np.frombuffer(joined, np.uint8), starts, ends)
        doc = np.searchsorted(ends, first, side="right")
        of = lambda k: np.array([d[k] for d in batch], np.int64)[doc]
        same = [xxhash.xxh3_64_intdigest(joined[p:e]) for p, e in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)]
        if len(first):
            yield from firsts({
                "anchor": anchor.view(np.int64), "same": np.array(same, np.uint64).view(np.int64), "doc_id": of(0), "mark": of(1),
                "start": first - starts[doc] + of(2), "n": count.astype(np.int64),
            })
    yield from firsts.rest()


def _judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in, sorted; out go repeats, and first runs whose anchor has other runs too (``open``)."""
    last, waiting = None, None  # the row before; the first run of its anchor while no other is known
    for rows in batches:
        known = rows.filter(rows["repeat"]).select(list(RUN))
        if len(known):
            yield _with_open(known, False)
        b = rows.filter(pc.invert(rows["repeat"])).select(list(RUN))
        if not len(b):
            continue
        c = {k: b[k].to_numpy() for k in b.schema.names}
        before = {k: np.concatenate(([c[k][0] if last is None else last[k]], c[k][:-1])) for k in c}
        fresh = np.zeros(len(b), bool)
        fresh[0] = last is None
        new_anchor = fresh | (c["anchor"] != before["anchor"])
        new_run = new_anchor | (c["same"] != before["same"])
        again = ~new_run & (c["doc_id"] == before["doc_id"]) & (c["mark"] == before["mark"]) & (c["start"] == before["start"])  # a row given twice
        group = np.cumsum(new_anchor)
        classes = np.bincount(group, new_run, group[-1] + 1)
        opened = new_run & (~new_anchor | (classes[group] > 1))
        repeat = ~new_run & ~again
        if waiting is not None and new_run[group == 0].any():  # the waiting anchor goes on with another run
            yield _with_open(waiting, True)
            waiting = None
        if new_anchor.any():
            at = int(np.flatnonzero(new_anchor)[-1])
            waiting = b.slice(at, 1) if classes[-1] == 1 else None
        picked = opened | repeat
        out = b.filter(pa.array(picked))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(opened[picked])], [*out.schema.names, "open"])
        last = {k: v[-1] for k, v in c.items()}


def _with_open(b: pa.RecordBatch, value: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([value] * len(b))], [*b.schema.names, "open"])


def _take_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "part", "doc_id", "mark", "start", "n", "bytes"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for b in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, mark, raw, places in zip(b["doc_id"].to_pylist(), b["mark"].to_pylist(), text_bytes(b["text"]), b["places"].to_pylist(), strict=True):
            for p in places:
                row = (p["anchor"], p["part"], doc_id, mark, p["start"], p["n"], raw[p["start"] : p["start"] + p["n"] + LENGTH - 1])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order: by 8-byte words first, then only groups that are still equal, by the rank of what follows, at doubled
    lengths (Larsson-Sadakane refinement)."""
    n = len(text)
    word = _words(np.concatenate((text, np.zeros(8, np.uint8))), ">u8").astype(np.uint64)
    order = np.argsort(word, kind="stable")
    # beyond the end stand zeros that aren't there: the shorter of such suffixes comes first
    tail = np.minimum(n - order, 8)
    new = np.concatenate(([True], (word[order[1:]] != word[order[:-1]])))
    tie = np.flatnonzero(~new & ((tail < 8) | (np.concatenate(([8], tail[:-1])) < 8)))
    if len(tie):
        order = order[np.lexsort((np.minimum(n - order, 8), np.cumsum(new)))]
        tail = np.minimum(n - order, 8)
        new = np.concatenate(([True], (word[order[1:]] != word[order[:-1]]) | (tail[1:] != tail[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    have = 8
    while True:
        edge = np.append(new, True)
        at = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(at):
            return order
        some = order[at]
        after = some + have
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        new[at] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = np.maximum.accumulate(np.where(new[at], at, 0))
        have *= 2


def _alike(word: np.ndarray, left: np.ndarray, right: np.ndarray, have: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at ``left`` and ``right``, up to ``most``, given that ``have`` bytes agree."""
    out = np.minimum(have, most)
    going = np.flatnonzero(out < most)
    while len(going):
        k = out[going]
        differ = word[left[going] + k] ^ word[right[going] + k]
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes before the first that differs
        out[going] = np.minimum(k + np.where(differ == 0, 8, lowest), most)
        going = going[(differ == 0) & (out[going] < most)]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Kasai's walk: the common prefix, up to ``most``, of the suffix at begin + t (t < count) and the one before it in ``order``.

    A suffix shares with its predecessor at most one byte less than the suffix one place to the left did, so only what
    comes after is compared. All runs are walked at once, one place a step. Zero elsewhere, and for the first of all.
    """
    word = _words(np.concatenate((text, np.zeros(most + 16, np.uint8))), "<u8")
    before = np.empty(len(text), np.int64)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    out = np.zeros(len(text), np.int64)
    lanes = np.argsort(-count, kind="stable")
    begin, count = begin[lanes], count[lanes]
    active = np.searchsorted(-count, -np.arange(int(count[0]) if len(count) else 0), side="left")  # lanes with more than t places
    have = np.zeros(len(begin), np.int64)
    for t, lanes_left in enumerate(active.tolist()):
        here = begin[:lanes_left] + t
        other = before[here]
        have = np.where(other < 0, 0, _alike(word, here, np.maximum(other, 0), np.where(other < 0, most, np.maximum(have[:lanes_left] - 1, 0)), most))
        out[here] = have
    return out


def equal_to_previous(text: np.ndarray, order: np.ndarray, window_at: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For the windows in ``order``: whether each has ``LENGTH`` bytes in common with the window before.

    Suffixes that are no windows may stand between two; the few that come under consideration are compared directly.
    """
    word = _words(np.concatenate((text, np.zeros(LENGTH + 16, np.uint8))), "<u8")
    spots = np.flatnonzero(window_at[order] >= 0)
    full = shared[order] >= LENGTH
    same = full[spots[1:]]
    gap = np.flatnonzero(same & (spots[1:] > spots[:-1] + 1))
    if len(gap):
        left, right = order[spots[gap]], order[spots[gap + 1]]
        same[gap] = _alike(word, left, right, np.zeros(len(gap), np.int64), LENGTH) >= LENGTH
    return same


def repeats(rows: list[tuple], known: dict | None = None) -> list[tuple[int, int, int, int]]:
    """(doc_id, mark, start, n) ranges of windows that start earlier elsewhere; rows are (doc_id, mark, start, n, bytes).

    ``known`` carries the windows of earlier blocks of the same anchor, sorted, for binary search, and gets the first ones of
    this block as ``fresh``: (doc_id, mark, start, digest).
    """
    text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows])[:-1])).astype(np.int64)
    counts = np.array([r[3] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[owner] + step
    doc, mark = (np.array([r[k] for r in rows], np.int64)[owner] for k in (0, 1))
    start = np.array([r[2] for r in rows], np.int64)[owner] + step
    window_at = np.full(len(text), -1, np.int64)
    window_at[place] = np.arange(len(place))
    suffixes = suffix_array(text)
    same = equal_to_previous(text, suffixes, window_at, common_prefixes(text, suffixes, begin, counts))
    order = window_at[suffixes]
    order = order[order >= 0]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate(([0], ~same)))
    ranked = np.lexsort((start, mark, doc, group))
    first = np.concatenate(([True], group[ranked[1:]] != group[ranked[:-1]]))
    again = np.zeros(len(order), bool)
    again[ranked[~first]] = True
    if known is not None:
        heads = ranked[first]
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[place[heads]]
        own = np.column_stack((windows, np.ones(len(heads), np.uint8))).view(f"S{LENGTH + 1}").ravel()  # the last byte keeps final zeros
        if "windows" in known:
            at = np.minimum(np.searchsorted(known["windows"], own), len(known["windows"]) - 1)
            again[heads[known["windows"][at] == own]] = True  # blocks come in document order
        fresh = ~again[heads]
        known["fresh"] = [(*where, xxhash.xxh3_128_digest(w.tobytes())) for *where, w in zip(doc[heads[fresh]].tolist(), mark[heads[fresh]].tolist(), start[heads[fresh]].tolist(), windows[fresh], strict=True)]
        known["windows"] = np.sort(np.concatenate((known["windows"], own[fresh])) if "windows" in known else own[fresh])
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    new = np.concatenate(([True], (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)))
    at = np.flatnonzero(new)
    return list(zip(doc[hit[at]].tolist(), mark[hit[at]].tolist(), start[hit[at]].tolist(), np.diff(np.append(at, len(hit))).tolist(), strict=True))


def _match_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, part and document; arrays are built over whole anchors, or over blocks of a large one.

    Out go repeats, and for anchors in several parts (part >= 0) the first windows with their digests.
    """
    whole: list[tuple] = []  # rows of finished anchors
    rows: list[tuple] = []  # rows of the current one
    whole_size = size = 0
    anchor, part, known = None, -1, None

    def batch(columns: list, digests: list | None = None) -> pa.RecordBatch:
        arrays = [pa.array(v, pa.int64()) for v in columns] + [pa.array(digests or [None] * len(columns[0]), pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "start", "n", "digest"])

    def done(some: list[tuple], earlier: dict | None = None) -> Iterator[pa.RecordBatch]:
        yield batch(list(zip(*repeats(some, earlier), strict=True)) or [[]] * 4)
        if earlier and part >= 0 and earlier["fresh"]:
            doc, mark, start, digest = zip(*earlier["fresh"], strict=True)
            yield batch([doc, mark, start, [1] * len(doc)], list(digest))

    for b in batches:
        for key, own, *row in zip(*(b[k].to_pylist() for k in ("anchor", "part", "doc_id", "mark", "start", "n", "bytes")), strict=True):
            if (key, own) != (anchor, part):
                if known is not None:
                    yield from done(rows, known)
                else:
                    whole += rows
                    whole_size += size
                if whole_size >= BLOCK:
                    yield from done(whole)
                    whole, whole_size = [], 0
                anchor, part, known, rows, size = key, own, {} if own >= 0 else None, [], 0
            elif size >= BLOCK:
                known = {} if known is None else known
                yield from done(rows, known)
                rows, size = [], 0
            rows.append(tuple(row))
            size += len(row[4])
    if known is not None:
        yield from done(rows, known)
    else:
        whole += rows
    if whole:
        yield from done(whole)


def removed(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs that windows cover; places are (first window start, number of windows)."""
    out: list[list[int]] = []
    for start, n in sorted(places):
        end = start + n + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, z) for a, z in out]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text, places: each row of ``docs`` with the ranges of windows that start earlier elsewhere."""
    small_batches(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    named = marked.where("doc_id IS NOT NULL")
    run = "anchor long, same long, doc_id long, mark long, start long, n int"
    found = named.mapInArrow(_find_runs, f"{run}, deal long, repeat boolean")
    judged = cut(found.repartition("deal").sortWithinPartitions("anchor", "same", "doc_id", "mark", "start").mapInArrow(_judge_runs, f"{run}, open boolean"), "runs")
    by_doc = marked.repartition("doc_id", "mark")
    opened = judged.where("open").select("anchor", "doc_id", "mark", "start", "n")
    sizes = opened.groupBy("anchor").agg(F.sum(F.col("n") + LENGTH - 1).alias("bytes")).where(F.col("bytes") > PARTS * BLOCK)
    parts = cut(sizes.select("anchor", F.ceil(F.col("bytes") / (PARTS * BLOCK)).alias("parts")), "large-anchors")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "mark"), F.col("parts")), F.lit(-1)).cast("int").alias("part")
    opened = opened.join(parts, "anchor", "left").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", part, "start", "n")).alias("places"))
    bytes_of = by_doc.dropDuplicates(["doc_id", "mark"]).join(opened, ["doc_id", "mark"]).mapInArrow(_take_bytes, "anchor long, part int, doc_id long, mark long, start long, n int, bytes binary")
    in_order = bytes_of.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "mark", "start")
    matched = cut(in_order.mapInArrow(_match_runs, "doc_id long, mark long, start long, n long, digest binary"), "matched-runs")
    earlier = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id", "mark", "start")) > 1  # a row for each part at most
    across = matched.where("digest IS NOT NULL").withColumn("again", earlier).where("again").select("doc_id", "mark", "start", "n")
    within = matched.where("digest IS NULL").select("doc_id", "mark", "start", "n")
    all_places = judged.where("NOT open").select("doc_id", "mark", "start", F.col("n").cast("long").alias("n")).unionByName(within).unionByName(across)
    places = all_places.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    return by_doc.join(places, ["doc_id", "mark"], "left")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of start and end in bytes), kept (binary) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b["text"])
            spans = [removed([(p["start"], p["n"]) for p in places or ()]) for places in b["places"].to_pylist()]
            kept = [b"".join(t[a:z] for a, z in zip([0, *(e for _, e in s)], [*(a for a, _ in s), len(t)], strict=True)) for t, s in zip(texts, spans, strict=True)]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], span),
                    pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                ["doc_id", "n_bytes", "removed", "kept", "kept_sha256"],
            )

    return repeated_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary, kept_sha256 string")
