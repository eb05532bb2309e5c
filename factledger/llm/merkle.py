"""Merkle manifest of a dataset, kept as a postorder append log.

Rows are leaves; each tree (rows of one value of ``tree``, in the order asked for) joins every ``FAN`` consecutive nodes into one
until one is left, its subroot. The subroots, in order of their trees, are joined in the same way to the root.

Aligned builders: leaves are dealt by ``rank // SPAN`` (a power of ``FAN``), so that a builder has a whole subtree, whatever
the tree's size. It takes its leaves in order and writes each node when it is complete, children before parents; these
segments, one row of 32-byte digests each, are the log. A tree with more than one segment is built in tiers: the roots
of one tier's segments are the leaves of the next, a ``SPAN``-th as many.

Proofs: in postorder the place of a node follows from the sizes of the subtrees before it alone (``place``), so siblings are
read from a segment by position, with no pointers and no search. Siblings above a segment are those of its root
one tier up, worked out once a segment and handed down to its leaves.

No builder sees more than ``SPAN`` leaves, hot trees are spread by rank, and the driver sees one number a call.

Defined results: nulls in any field are ``-`` in the leaf (so null and empty differ); very long texts are hashed whole; rows with equal keys are ordered by
their digest and get a proof each; a null tree is a tree of its own, before the others; a lone leaf is its own subroot and a lone subroot the root,
with no siblings (the digest of the empty proof); an empty table has no rows; further columns are carried along by ``build`` only if named, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FAN, SPAN, SIZE = 8, 8**4, 32


def field(column: Column) -> Column:
    """A field's part of a leaf: its length in bytes, a colon and its value; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest (lowercase hex) of a row's fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in children).encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def place(level: int, index: int, leaves: int, levels: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of a tree with so many leaves and levels.

    The node is complete with leaf ``end``. By then all nodes up to its level that end there are written; of the levels
    above, those that ended with an earlier leaf.
    """
    end = min((index + 1) * FAN**level, leaves)
    upto = sum(-(-end // FAN**k) for k in range(level + 1))
    return upto + sum((end - 1) // FAN**k for k in range(level + 1, levels + 1)) - 1


def write_log(leaves: list[bytes], levels: int) -> bytes:
    """The nodes over ``leaves`` in the order in which they are complete."""
    log, waiting = [], [[] for _ in range(levels)]
    for i, node in enumerate(leaves, 1):
        log.append(node)
        for level in waiting:
            level.append(node)
            if len(level) < FAN and i < len(leaves):
                break
            node = parent(level)
            level.clear()
            log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaves: int, levels: int, index: int) -> tuple[list[str], list[str]]:
    """For each level from the leaf up, the hex digests left and right of the path, read from the log by place."""

    def read(level: int, nodes: range) -> str:
        at = (SIZE * place(level, i, leaves, levels) for i in nodes)
        return "".join(log[a : a + SIZE].hex() for a in at)

    lefts, rights = [], []
    for level in range(levels):
        first = index - index % FAN
        lefts.append(read(level, range(first, index)))
        rights.append(read(level, range(index + 1, min(first + FAN, -(-leaves // FAN**level)))))
        index //= FAN
    return lefts, rights


@dataclass
class Forest:
    """``rows``: the leaves with ``_tree``, ``_rank`` and ``_n`` (leaves of the tree). ``tiers``: the log's segments. ``roots``: _tree, digest."""

    rows: DataFrame
    tiers: list[DataFrame]
    roots: DataFrame
    span: int


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, from 0 within ``_tree`` in the given order, and ``_n``: ranges of rows are counted, not sorted in one task."""
    by = ["_tree", *order]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("_tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("_tree")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_tree", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_rows").over(tree).alias("_n"))
    ranked = placed.withColumn("_part", part).join(starts, ["_tree", "_part"])
    return ranked.withColumn("_rank", F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def segments(rows: DataFrame, span: int) -> DataFrame:
    """One tier of the log from (_tree, _rank, _n, digest): _tree, _block, _n, levels, nodes."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rank")
        n = group["_n"][0].as_py()
        leaves = group["digest"].to_pylist()
        levels = min(height(n), height(span))
        kept = group.slice(0, 1).select(["_tree", "_block", "_n"])
        return kept.append_column("levels", pa.array([levels], pa.int32())).append_column("nodes", pa.array([write_log(leaves, levels)], pa.binary()))

    dealt = rows.select("_tree", F.floor(F.col("_rank") / span).alias("_block"), "_rank", "_n", "digest")
    return dealt.groupBy("_tree", "_block").applyInArrow(build, "_tree string, _block long, _n long, levels int, nodes binary")


def last_digest(nodes: str = "nodes") -> Column:
    return F.substring(nodes, -SIZE, SIZE)


def grow(rows: DataFrame, order: list[str], span: int = SPAN) -> Forest:
    """Write the log of every tree, ``span`` leaves (a power of ``FAN``) a builder. ``rows``: _tree (string, not null), digest (binary) and what else is to be carried along."""
    rows = cut(numbered(rows, order), "merkle-leaves")
    most = rows.agg(F.max("_n")).first()[0] or 0
    tiers, now = [], rows
    while not tiers or most > 1:
        tiers.append(cut(segments(now, span), "merkle-log"))
        most = -(-most // span)
        blocks = F.ceil(F.col("_n") / span).cast("long")
        now = tiers[-1].where(blocks > 1).select("_tree", F.col("_block").alias("_rank"), blocks.alias("_n"), last_digest().alias("digest"))
    roots = [t.where(F.col("_n") <= span).select("_tree", last_digest().alias("digest")) for t in tiers]
    return Forest(rows, tiers, reduce(DataFrame.unionByName, roots), span)


PATH = "lefts array<string>, rights array<string>"


def _joined(segment: dict, index: int, span: int) -> tuple[list[str], list[str]]:
    """Siblings of a segment's leaf: within the segment, then those of the segment's own root further up."""
    levels, log = segment["levels"], segment["nodes"]
    leaves = min(span, segment["_n"] - segment["_block"] * span)
    lefts, rights = siblings(log, leaves, levels, index)
    return lefts + (segment["lefts"] or []), rights + (segment["rights"] or [])


def prove(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """``forest.rows`` with ``lefts`` and ``rights``: for each level up to the root, the digests (hex, concatenated) beside the path.

    ``above`` (_tree, lefts, rights, and binary columns that every row of the tree gets too) continues the path from the subroots on.
    """

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The path of every leaf of an upper tier's segment, that is of a segment one tier down."""
        for batch in batches:
            for one in batch.to_pylist():
                first = one["_block"] * span
                ranks = range(first, min(first + span, one["_n"]))
                paths = [_joined(one, r - first, span) for r in ranks]
                columns = [pa.array([one["_tree"]] * len(paths)), pa.array(ranks, pa.int64()), *(pa.array([p[k] for p in paths], pa.list_(pa.string())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["_tree", "_block", "lefts", "rights"])

    keys, upper, span = ["_tree", "_block"], None, forest.span
    facts = [c for c in above.columns if c not in ("_tree", "lefts", "rights")] if above is not None else []
    for tier in reversed(range(len(forest.tiers))):
        # the root of a tree's only segment goes on with what is above, the other segments' with the next tier's path
        parts = [] if above is None else [forest.tiers[tier].where(F.col("_n") <= span).select(*keys).join(above.select("_tree", "lefts", "rights"), "_tree")]
        if upper is not None:
            parts.append(upper)
        none = F.lit(None).cast("array<string>")
        whole = forest.tiers[tier].join(reduce(DataFrame.unionByName, parts), keys) if parts else forest.tiers[tier].withColumns({"lefts": none, "rights": none})
        if tier:
            upper = cut(whole.mapInArrow(hand_down, f"_tree string, _block long, {PATH}"), "merkle-paths")
    if facts:
        whole = whole.join(above.select("_tree", *facts), "_tree")
    names = [c for c in forest.rows.columns if c not in ("_rank", "_n")]

    def extract(rows: pa.Table, segment: pa.Table) -> pa.Table:
        one = segment.to_pylist()[0]
        paths = [_joined(one, rank - one["_block"] * span, span) for rank in rows["_rank"].to_pylist()]
        out = rows.select(names)
        for k, name in enumerate(("lefts", "rights")):
            out = out.append_column(name, pa.array([p[k] for p in paths], pa.list_(pa.string())))
        for name in facts:
            out = out.append_column(name, pa.array([one[name]] * len(paths), pa.binary()))
        return out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in forest.rows.schema if f.name in names), PATH, *(f"{c} binary" for c in facts)])
    rows = forest.rows.withColumn("_block", F.floor(F.col("_rank") / span))
    return rows.groupBy(*keys).cogroup(whole.groupBy(*keys)).applyInArrow(extract, schema)


def proof(lefts: Column | str = "lefts", rights: Column | str = "rights") -> Column:
    """Digest of all siblings, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def fold(digest: Column, lefts: Column | str = "lefts", rights: Column | str = "rights") -> Column:
    """The root (hex) that a leaf (hex) and its siblings give."""
    beside = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(beside, digest, lambda d, s: F.sha2(F.concat(s["a"], d, s["b"]), 256))


def manifest(rows: DataFrame, tree: str, order: list[str], digest: str, keep: list[str], span: int = SPAN) -> DataFrame:
    """``keep`` and the hex columns leaf, subroot, root with lefts and rights, the siblings up to the root, for each row.

    ``digest`` names the leaves (hex); rows of one ``tree`` are in the given order, ties by their digest.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null before all others
    leaves = cut(rows.select(key.alias("_tree"), F.unhex(digest).alias("digest"), F.struct(*order).alias("_by"), F.struct(*keep).alias("_row")), "merkle-rows")
    forest = grow(leaves, ["_by", "digest", "_row"], span)
    roots = cut(forest.roots, "merkle-roots")
    top = grow(roots.select(F.lit("").alias("_tree"), "digest", F.col("_tree").alias("_of")), ["_of"], span)
    above = prove(top).join(F.broadcast(top.roots.select("_tree", F.col("digest").alias("root"))), "_tree")  # of one row
    above = cut(above.select(F.col("_of").alias("_tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root"), "merkle-top")
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return prove(forest, above).select("_row.*", hexed("digest", "leaf"), hexed("subroot", "subroot"), hexed("root", "root"), "lefts", "rights")
