r"""MinHash near-duplicates with odd sketches.

Texts are lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and turned into sets of word shingles; a text of
fewer words is one shingle. Two documents are linked if their Jaccard similarity reaches a threshold.

1. Documents with equal sets collapse into a class, which the smallest doc_id stands for.
2. Bands of MinHash samples find candidates; their length follows from the threshold, so that a pair at the threshold shares no
   band with a probability under 1e-6 (1.3e-7 at 0.8). In each bucket all classes are paired with the smallest only (a
   star), not with each other.
3. All samples folded into a parity bitmap are the odd sketch: the ones in the XOR of two sketches estimate the
   similarity, and pairs that are far off are dropped (``most_ones``: six standard deviations of the samples from the threshold).
4. The rest is confirmed on the full sets, and links are joined into components.
5. Where a bucket's members ended in several components, members outside the largest one are compared with
   all others of the cluster that buckets connect, in blocks of bounded size inside tasks: sketches of all first, then the full sets of
   those with a near sketch in the block. So no link between buckets' members is lost, and no list of all pairs is ever made.

Hubs: a star's centre or a common bucket may hold a third of all rows. Their sums are made by partial aggregation, and what is
summed is joined back under a key that is dealt anew (``dealt``), so adaptive execution can split the hot side.

Defined results: documents without words and those without a doc_id are linked with nothing; rows that repeat a
doc_id are one document with the links of all of them; of equal sets the smallest doc_id stands for all; a very long text is one
set, held whole by a task; ``keep_one`` carries any other column along, whatever its name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix64, small_batches, text_bytes

SAMPLES, SKETCH_BITS, BLOCK, WEIGHT = 200, 512, 500, 4_000_000
_DRAW = np.random.default_rng(7)
FACTORS = _DRAW.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
SALTS = _DRAW.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


class Shingler:
    """Sorted sets of hashed word shingles; word hashes are remembered up to a bound."""

    def __init__(self, size: int, most: int = 300_000):
        self.size, self.most = size, most
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # bytes know ASCII letters and white space only, as the word rule does
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.array(list(map(known.__getitem__, words)), np.uint64)
        n = min(self.size, len(codes))
        count = len(codes) - n + 1
        keys = np.full(count, n, np.uint64)
        for k in range(n):
            keys = keys * np.uint64(0xD1342543DE82EF95) + codes[k : k + count]
        keys = np.sort(mix64(keys))
        return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def samples(keys: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 1024):
        np.minimum(low, (keys[at : at + 1024, None] * FACTORS + SHIFTS).min(0), out=low)
    return low


def band_rows(percent: int) -> int:
    """The longest bands with which a pair at the threshold shares none with a probability under 1e-6."""
    fits = [r for r in range(1, 11) if (1 - (percent / 100) ** r) ** (SAMPLES // r) < 1e-6]
    if not fits:
        raise ValueError(f"{SAMPLES} samples do not find pairs at {percent} %")
    return max(fits)


def most_ones(percent: int) -> int:
    """Ones in the XOR of two sketches that a pair at the threshold stays under, six standard deviations of its samples away."""
    share = 1 - percent / 100
    flips = 2 * SAMPLES * share + 12 * (SAMPLES * share * (1 - share)) ** 0.5
    odd = lambda n, bits: (1 - (1 - bits / SKETCH_BITS) ** n) / 2  # noqa: E731 # share of places that n flips leave odd
    return int(SKETCH_BITS * odd(flips, 2) + 2.5 * (SKETCH_BITS * odd(flips, 4) / 2) ** 0.5)


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    bands = len(low) // rows
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mix64(keys * np.uint64(0xD1342543DE82EF95) + low[k : bands * rows : rows])
    return keys


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    places = mix64(low ^ SALTS) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands, sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(t) for t in text_bytes(b["text"])]
            lows = [samples(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else band_keys(x, rows).view(np.int64) for x in lows], pa.list_(pa.int64())),
                    pa.array([None if x is None else odd_sketch(x).view(np.int64) for x in lows], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def dealt(key: str) -> Column:
    """A key's value under another expression: what is aggregated by the key is shuffled once more for a join on this, and so
    adaptive execution may split a hot key of the other side, which it can't do above an aggregate."""
    return F.col(key).bitwiseXOR(F.lit(1).cast("long"))


def joined_back(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the aggregates of a key that a third of them may share."""
    return rows.withColumn("_deal", dealt(key)).join(sums.withColumn("_deal", dealt(key)).drop(key), "_deal").drop("_deal")


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) from undirected edges (a, b), by alternating large and small stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        state = now
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined_back(both.where("v > u"), lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined_back(large, lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, held = Shingler(size), None, None
        for b in batches:
            keep = []
            for a, text_a, text_b in zip(b["a"].to_pylist(), text_bytes(b["text_a"]), text_bytes(b["text_b"]), strict=True):
                if (a, text_a) != last:  # pairs come by their smaller member
                    last, held = (a, text_a), shingle(text_a)
                keep.append(alike(held, shingle(text_b), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(rows: pd.DataFrame, percent: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray of a block with the targets of other components whose sketches and sizes are near, nearest first."""
    sketch = np.array(rows["sketch"].tolist(), np.int64).view(np.uint64).reshape(len(rows), -1)
    ids, roots, lengths = rows["id"].to_numpy(), rows["root"].to_numpy(), rows["n"].to_numpy()
    stray, outside = (rows["role"] == "s").to_numpy(), rows["stray"].to_numpy()
    targets = np.flatnonzero(~stray)
    for x in np.flatnonzero(stray):
        ones = np.bitwise_count(sketch[targets] ^ sketch[x]).sum(1)
        near = (roots[targets] != roots[x]) & (ones <= limit) & (100 * np.minimum(lengths[targets], lengths[x]) >= percent * np.maximum(lengths[targets], lengths[x]))
        near &= ~outside[targets] | (ids[targets] < ids[x])  # two strays meet once
        yield x, targets[near][np.argsort(ones[near], kind="stable")]


def _survivors(percent: int, limit: int, columns: list[str]):
    """The rows of a block that have a near one in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = np.zeros(len(rows), bool)
        for x, near in _near(rows, percent, limit):
            kept[near] = True
            kept[x] |= len(near) > 0
        return rows.loc[kept, columns]

    return run


def _cell(size: int, percent: int, limit: int):
    """Links between strays and targets of one block; one for each stray and component is enough."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler(size)
        sets = [shingle((t or "").encode()) for t in rows["text"]]
        ids, roots = rows["id"].to_numpy(), rows["root"].to_numpy()
        links = []
        for x, near in _near(rows, percent, limit):
            found = set()
            for y in near:
                if roots[y] not in found and alike(sets[x], sets[y], percent):
                    found.add(roots[y])
                    links.append((ids[y], ids[x]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark, limit = docs.sparkSession, most_ones(percent)
    signed = cut(signatures(docs, size, band_rows(percent)), "signatures")
    classes = cut(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    pairs = cut(joined_back(keys, shared, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "candidates")
    known = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # a sort-merge join at every size: the list of candidates grows with the corpus
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(known.hint("merge"), "id", "left_semi"), "candidate-texts")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    ones = sum(F.bit_count(F.col("s_a")[k].bitwiseXOR(F.col("s_b")[k])) for k in range(SKETCH_BITS // 64))
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (ones <= limit))
        .select("a", "b")
    )
    small_batches(spark)
    with_texts = near.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = cut(with_texts.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long"), "links")
    roots = components(links)
    members = (
        components(pairs).withColumnRenamed("root", "cluster").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    )
    members = cut(members, "members")
    weighed = members.join(classes.select("id", F.col("n").alias("weight")), "id")
    counts = weighed.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / WEIGHT)).cast("int")  # noqa: E731 # rows and shingles of a block are bounded
    several = (
        counts.groupBy("cluster")
        .agg(F.max(F.struct("n", (-F.col("root")).alias("minus"), "w")).alias("top"), F.sum("n").alias("all"), F.sum("w").alias("sum"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            "cluster", (-F.col("top.minus")).alias("largest"), blocks(F.col("all"), F.col("sum")).alias("tb"),
            blocks(F.col("all") - F.col("top.n"), F.col("sum") - F.col("top.w")).alias("sb"),
        )
    )
    inside = joined_back(members, several, "cluster").withColumn("stray", F.col("root") != F.col("largest"))
    inside = inside.join(classes.select("id", "n", "sketch"), "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    targets = inside.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("sb") - 1)), "role": F.lit("t")}).withColumn("j", own("tb"))
    strays = inside.where("stray").withColumns({"j": F.explode(F.sequence(F.lit(0), F.col("tb") - 1)), "role": F.lit("s")}).withColumn("i", own("sb"))
    cells = targets.unionByName(strays).select("cluster", "i", "j", "role", "id", "root", "stray", "n", "sketch")
    near = cells.groupBy("cluster", "i", "j").applyInPandas(_survivors(percent, limit, cells.columns), cells.schema)
    with_sets = cut(near, "near-cells").join(texts, "id")
    more = cut(with_sets.groupBy("cluster", "i", "j").applyInPandas(_cell(size, percent, limit), "a long, b long"), "more-links")
    linked = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
    named = (
        signed.select("doc_id", "n_shingles", "digest")
        .join(classes.select("digest", F.col("id").alias("_class")), "digest", "left")
        .join(linked.select(F.col("id").alias("_class"), "root"), "_class", "left")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "_class", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for."""
    name = fresh(docs, "_dropped")
    dropped = groups(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped.hint("merge"), docs["doc_id"].cast("long") == F.col(name), "left_anti")
