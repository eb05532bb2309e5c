"""The manifest by hand: every tree level by level, proofs checked by folding, towers of several tiers."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from factledger.llm import merkle, queries

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
PART = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(left, right) digests a level, and what is left above."""
    for nodes in tree[:-1]:
        first = i - i % 8
        yield nodes[first:i], nodes[i + 1 : first + 8]
        i //= 8


def by_hand(rows):
    trees = defaultdict(list)
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]) if r["text"] is not None else None
        head = PART(r["doc_id"]) + PART(r["source"]) + PART(r["lang"]) + PART(r["n_chars"])
        changed = H(head + PART(low)) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else None
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, H(head + PART(r["text"])), changed))
    built = {k: levels([leaf for _, _, leaf, _ in sorted(v, key=lambda x: x[:3])]) for k, v in trees.items()}
    langs = sorted(built, key=lambda k: (k is not None, (k or "").encode()))
    top = levels([built[k][-1][0] for k in langs])
    for k in langs:
        for i, (known, key, leaf, changed) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            way, node = [*path(built[k], i), *path(top, langs.index(k))], changed or leaf
            for left, right in way:
                node = H(*left, node, *right)
            yield key if known else None, leaf, built[k][-1][0], top[-1][0], H(*(x for a, b in way for x in a + b)), node, node == top[-1][0]


def test_against_hand(spark, awkward):
    rows = spark.read.parquet(f"{awkward}/documents.parquet").collect()
    assert Counter(map(tuple, queries.op12_merkle_manifest(spark, awkward).collect())) == Counter(by_hand(rows))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 513, 700])
def test_places(n):
    h = merkle.height(n)
    nodes = [[i.to_bytes(32, "big") for i in range(n)]]
    for _ in range(h):
        nodes.append([merkle.parent(nodes[-1][i : i + 8]) for i in range(0, len(nodes[-1]), 8)])
    log = merkle.write_log(nodes[0], h)
    assert len(log) == 32 * sum(map(len, nodes)) and len(nodes[-1]) == 1
    for k, level in enumerate(nodes):
        assert all(log[32 * merkle.place(k, i, n, h) :][:32] == x for i, x in enumerate(level))


def test_several_tiers(spark):
    """Trees of 1 to 700 leaves and nine trees, with builders of 8 leaves: up to four tiers, and two above the subroots."""
    sizes = {None: 1, "": 2, "a": 8, "b": 9, "c": 64, "d": 65, "e": 130, "é": 513, "z": 700}
    docs = [(i, f"Text {t} {i}", t, None, i) for t, n in sizes.items() for i in range(n)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = rows.select("doc_id", "lang", merkle.leaf(*(rows[c] for c in queries.FIELDS)).alias("digest"))
    done = merkle.manifest(leaves, "lang", ["doc_id"], "digest", keep=["doc_id"], span=8)
    found = done.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("p"), merkle.fold(done["leaf"]).alias("f")).collect()
    assert all(r["f"] == r["root"] for r in found)
    assert Counter((*r[:5],) for r in found) == Counter(x[:5] for x in by_hand(rows.collect()))
