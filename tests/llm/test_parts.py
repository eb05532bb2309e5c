"""Data structures beneath the operators."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from brute import links, lower
from factledger.llm import decontamination, mixing, near_dedup, quality, queries, sharding, suffix_dedup, tokens


@pytest.mark.parametrize("block", [1 << 16, 1 << 9])
def test_wavelet_queries(monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    ids = np.random.default_rng(1).integers(0, 50_257, 3000).astype(np.uint16)
    ids[::7] = 13
    matrix = tokens.WaveletMatrix(tokens.pack(ids, [1000, 2000], [5, None], 16))
    assert (matrix.ids(np.uint16) == ids).all() and matrix.lengths.tolist() == [1000, 2000] and matrix.doc_ids == [5, None]
    assert all(matrix.access(i) == ids[i] for i in range(0, 3000, 41))
    at = np.flatnonzero(ids == 13)
    assert matrix.count(13) == len(at) and matrix.count(13, 100, 900) == (ids[100:900] == 13).sum() and matrix.count(49_999, 0, 0) == 0
    assert [matrix.occurrence(13, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        matrix.occurrence(13, len(at))
    assert len(tokens.WaveletMatrix(tokens.pack(ids[:0], [], [], 16)).ids()) == 0


def test_a_point_query_inflates_few_blocks(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 1 << 9)
    ids = np.random.default_rng(2).integers(0, 50_257, 40_000).astype(np.uint16)
    matrix, inflated = tokens.WaveletMatrix(tokens.pack(ids, [len(ids)], [1], 16)), []
    frame = matrix._frame
    monkeypatch.setattr(matrix, "_frame", lambda k: inflated.append(k) or frame(k))
    assert matrix.access(12_345) == ids[12_345] and len(inflated) <= 16 < 79 * 16
    before = len(inflated)
    assert matrix.count(int(ids[7])) == (ids == ids[7]).sum() and len(inflated) - before <= 32


def test_occurrences_in_files(spark):
    docs = spark.createDataFrame([(2, "a b a"), (1, None), (None, "a, b"), (3, "b" * 50)], "doc_id long, text string")
    encoder = tokens.Encoder(queries.tokenizer_path())
    files, token = tokens.write(docs, queries.tokenizer_path(), shard_tokens=4), encoder.tokenizer.encode(" b", add_special_tokens=False).ids[0]
    want = sorted((str(d), k) for d, t in docs.collect() for k, i in enumerate(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) if i == token)
    assert sorted((str(r["doc_id"]), r["at"]) for r in tokens.occurrences(files, token).collect()) == want and len(want) == 2


def test_chunked_encoding_is_that_of_whole_texts():
    import random

    encoder = tokens.Encoder(queries.tokenizer_path(), most=500)
    random.seed(2)
    texts = ["".join(random.choice("ab 1  \n\t'’é.!,  \x1c\x85\0²\u3000-") for _ in range(random.randint(0, 16))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        ids, counts = encoder.encode(texts[at : at + 100])
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts[at : at + 100], add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_the_encoder_remembers_words_however_they_stand():
    """A stop, a line break or another batch makes no new words, and what the library holds at once is bounded."""
    encoder, asked = tokens.Encoder(queries.tokenizer_path(), call=3), []
    known = encoder._encode
    encoder._encode = lambda words: asked.append(words.to_pylist()) or known(words)
    texts = ["the house stood. the house, old\nthe house.\nold\n", "\nstood house\n\nthe. house.\t old", "", "a  house\n old. ", "the\0house", "the\u2028house. old\x85", "Éé house, é."]
    for batch in (texts, texts[::-1]):
        ids, counts = encoder.encode(batch)
        want = [e.ids for e in encoder.tokenizer.encode_batch(batch, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    words = [w for some in asked for w in some]
    assert len(words) == len(set(words)) and not asked[1] and " house" in words and not {" house.", " house,", " stood."} & set(words)


def test_what_the_encoder_holds_at_once_is_bounded():
    encoder, sizes = tokens.Encoder(queries.tokenizer_path(), most=2000, call=100), []

    class Seen:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, words, **how):
            sizes.append(sum(len(w.split(" ")) for w in words))
            return self.inner.encode_batch_fast(words, **how)

    encoder.by_space = Seen(encoder.by_space)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    for at in range(0, 10_000, 1000):
        encoder.encode([" ".join(map(name, range(at, at + 1000)))])
        assert len(encoder.known) <= 2000
    assert sum(sizes) >= 10_000 and max(sizes) <= 201  # a space before a word is a letter of it
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(64)), "text": ["x" * (1 << 18)] * 64})
    held = [sum(map(len, texts)) for _, texts in tokens._gathered(batch.slice(k, 1) for k in range(64))]
    assert sum(held) == 16 << 20 and max(held) < 8 << 20


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(97, 100, 300), np.full(350, 97), rng.integers(97, 99, 200), np.zeros(20)]).astype(np.uint8)
    order, raw = suffix_dedup.suffix_array(text), text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    begin, count = np.array([0, 300, 500, 800]), np.array([250, 120, 300, 70])
    found = suffix_dedup.common_prefixes(text, order, begin, count)
    places = {b + t for b, n in zip(begin, count, strict=True) for t in range(n)}
    for a, b in zip(order.tolist(), order[1:].tolist(), strict=False):
        if b in places:
            assert min(found[b], len(raw) - max(a, b)) == next((k for k in range(min(100, len(raw) - max(a, b))) if raw[a + k] != raw[b + k]), min(100, len(raw) - max(a, b)))
        else:
            assert found[b] == 0


def test_runs_of_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 256, 400).astype(np.uint8)
    docs = [np.concatenate((rng.integers(0, 256, n).astype(np.uint8), shared, rng.integers(0, 256, n).astype(np.uint8))) for n in (0, 37, 150)]
    ends = np.cumsum([len(d) for d in docs])
    starts = np.concatenate(([0], ends[:-1]))
    first, count, anchor = suffix_dedup.runs(np.concatenate(docs), starts, ends)
    assert count.sum() == sum(len(d) - 99 for d in docs)
    of = {int(p): int(a) for f, c, a in zip(first, count, anchor, strict=True) for p in range(f, f + c)}
    for p in range(301):
        assert len({of[int(s) + n + p] for s, n in zip(starts, (0, 37, 150), strict=True)}) == 1


@pytest.mark.parametrize(("block", "remembered", "piece"), [(4 << 20, 200_000, 2 << 20), (2000, 3, 2000), (300, 0, 700)])
def test_repeats_in_small_blocks(monkeypatch, block, remembered, piece):
    """The tasks' work without Spark: runs are remembered or not, arrays are whole or cut into blocks that binary search merges."""
    import random

    import pyarrow as pa

    for name, value in (("BLOCK", block), ("REMEMBERED", remembered), ("PIECE", piece)):
        monkeypatch.setattr(suffix_dedup, name, value)
    random.seed(9)
    passage = "".join(random.choice("abcd \n") for _ in range(300)).encode()
    own = lambda n: bytes(random.choice(b"abcd ") for _ in range(random.randint(0, n)))
    texts = [own(200) + passage[random.randint(0, 150) : random.randint(150, 300)] + own(30) + passage[:120] for _ in range(40)] + [b"x" * 350, passage, passage]
    order = [*range(0, len(texts), 2), *range(1, len(texts), 2)]
    docs = pa.table({"doc_id": order, "mark": [0] * len(order), "text": [texts[i] for i in order]})
    batches = lambda table: table.combine_chunks().to_batches(max_chunksize=7)
    table = lambda found: pa.Table.from_batches(list(found)).sort_by([(k, "ascending") for k in ("anchor", "same", "doc_id", "mark", "start")])
    judged = table(suffix_dedup._judge_runs(batches(table(suffix_dedup._find_runs(batches(docs)))))).to_pylist()
    rows = sorted((r["anchor"], -1, r["doc_id"], 0, r["start"], r["n"], texts[r["doc_id"]][r["start"] : r["start"] + r["n"] + 99]) for r in judged if r["open"])
    opened = pa.table(dict(zip(("anchor", "part", "doc_id", "mark", "start", "n", "bytes"), zip(*rows, strict=True), strict=True)))
    matched = [r for b in suffix_dedup._match_runs(batches(opened)) for r in b.to_pylist()]
    have = {(r["doc_id"], p) for r in [*matched, *(r for r in judged if not r["open"])] for p in range(r["start"], r["start"] + r["n"])}
    seen, want = set(), set()
    for i, raw in enumerate(texts):
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                want.add((i, p))
            seen.add(raw[p : p + 100])
    assert have == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    ones = []
    for share in (0.0, 0.05, 0.11, 0.3):  # 0.11 exchanged: similarity 0.8
        b = a.copy()
        b[: int(share * len(b))] = rng.integers(0, 1 << 63, int(share * len(b))).astype(np.uint64)
        b = np.unique(b)
        ones.append(int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))).sum()))
    assert ones[0] == 0 and ones == sorted(ones) and ones[2] < near_dedup.most_ones(80)
    assert near_dedup.band_rows(80) == 5 and near_dedup.band_rows(50) == 2 and near_dedup.most_ones(60) > near_dedup.most_ones(80)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 4), (20, 21), (22, 21), (30, 30)]
    found = {r["id"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20, 22: 20}


def test_ring_places_clockwise_and_keeps_the_bound():
    points, owners = sharding.ring(10, 64)
    units = [(a, a, 100) for a in range(len(points))]
    placed = sharding.resolve(units, owners, 10, 1.05)
    room, want = [64_000 * 1.05 / 10] * 10, {}
    for unit, arc, load in units:  # the first point clockwise whose shard has room
        want[unit] = next(int(s) for s in np.roll(owners, -arc) if room[s] >= load)
        room[want[unit]] -= load
    assert placed == want and sum(placed[a] == owners[a] for a in range(len(points))) > 0.8 * len(points)


def test_shards_of_rows(spark):
    """Sizes near equal, gapless slots, equal keys together unless they are heavy, and few moves for one more shard."""
    rng = np.random.default_rng(8)
    keys = [7] * 4000 + rng.integers(100, 3000, 8000).tolist() + [None] * 5
    frame = spark.createDataFrame([(i, k, int(w)) for i, (k, w) in enumerate(zip(keys, rng.integers(1, 50, len(keys)), strict=True))], "id long, key long, load long")
    place = lambda n: {r["id"]: r for r in sharding.shard_rows(frame, frame["key"], frame["load"], shards=n).collect()}
    found, grown = place(8), place(9)
    load, slots, homes, weight = np.zeros(8), {}, {}, {}
    for r in found.values():
        load[r["shard"]] += r["load"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["key"], set()).add(r["shard"])
        weight[r["key"]] = weight.get(r["key"], 0) + r["load"]
    assert len(found) == len(keys) and load.max() < 1.02 * load.mean() and load.min() > 0.98 * load.mean()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for k, h in homes.items() if weight[k] <= load.mean() / sharding.HEAVY) and 1 < len(homes[7]) <= 4
    assert sum(found[i]["shard"] != grown[i]["shard"] for i in found) < 0.4 * len(found)  # hashing anew would move eight ninths


def written(spark, sf_dir):
    """Each stage's input, and the last one's output."""
    inputs, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = near_dedup.cut(stage(spark, docs, sf_dir), name)
        assert name == "token_output" or docs.columns == inputs[name].columns
    return inputs, docs


def contaminated(text, items):
    """Hit words and all words of a text, by windows of 13 words."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = {tuple(w[i : i + 13]) for w in map(word, items) if w for i in range(max(1, len(w) - 12))}
    words, hit = word(text), set()
    for n in {len(g) for g in grams}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
    return len(hit), len(words)


def test_pipeline_stages(spark):
    """Each stage's decisions, by brute force on its own input."""
    sf = "/root/testdata/sf0.001"
    inputs, out = written(spark, sf)
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in inputs.items()}
    texts = {n: {r["doc_id"]: r["text"] or "" for r in d.collect()} for n, d in inputs.items()}
    # quality: the base rule and a walk through the fitted nodes
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    trees, want = quality.train(inputs["quality_rules"], labels), []
    for i in ids["quality_rules"]:
        counts = quality.statistics(texts["quality_rules"][i].encode(), trees.harsh if trees else frozenset())
        bad = 0.0
        if trees:
            row, bad = quality.features(np.array([counts]))[0], trees.base
            for node in trees.roots.tolist():
                while trees.left[node] != node:
                    node = int(trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node])
                bad += trees.value[node]
        if counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0] and bad <= 0:
            want.append(i)
    assert sorted(ids["minhash_near_dedup"]) == sorted(want) and len(want) < len(ids["quality_rules"])
    found = links(texts["minhash_near_dedup"], 5)
    assert sorted(ids["benchmark_decontamination"]) == sorted(i for i, (_, root) in found.items() if root == i)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {i: contaminated(t, items) for i, t in texts["benchmark_decontamination"].items()}
    assert sorted(ids["source_mixing"]) == sorted(i for i, (h, n) in hits.items() if not (h and 20 * h >= n))
    # mixing: what each source takes is near its target, and no document comes more than twice
    copies, sources = Counter(ids["token_output"]), {r["doc_id"]: r["source"] for r in inputs["source_mixing"].collect()}
    size = {i: len(t.split()) for i, t in texts["source_mixing"].items()}
    total, weight, source_size, target = sum(size.values()), {}, Counter(), {}
    for k, s in enumerate(sorted(set(sources.values()))):
        weight[s] = (3, 1, 2)[k % 3]
    for i, s in sources.items():
        source_size[s] += size[i]
    left, going = 1.5 * total, set(weight)
    while full := {s for s in going if 2 * source_size[s] <= left * weight[s] / sum(weight[x] for x in going)}:
        target |= {s: 2 * source_size[s] for s in full}
        left, going = left - sum(2 * source_size[s] for s in full), going - full
    target |= {s: left * weight[s] / sum(weight[x] for x in going) for s in going}
    taken, largest = Counter(), Counter()
    for i, n in copies.items():
        taken[sources[i]] += n * size[i]
    for i, s in sources.items():
        largest[s] = max(largest[s], size[i])
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= 2 * largest[s] + 1 for s in target)
    # tokens: ids of whole texts, one document after the other
    tokenizer, at, rows = tokens.Encoder(queries.tokenizer_path()).tokenizer, 0, []
    for i in sorted(ids["token_output"]):
        own = [*tokenizer.encode(texts["token_output"][i], add_special_tokens=False).ids, 2]
        rows.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, out.collect())) == rows


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty):
    inputs, out = written(spark, awkward)
    kept = {n: [r["doc_id"] for r in d.collect()] for n, d in inputs.items()}
    assert {7, 10} & set(kept["source_mixing"]) and len(kept["source_mixing"]) <= len(kept["benchmark_decontamination"]) <= len(kept["minhash_near_dedup"])
    assert out.count() == len(kept["token_output"])
    assert all(d.count() == 0 for d in written(spark, empty)[0].values()) and corpus_pipeline.run(spark, empty).count() == 0


def test_columns_named_like_results_stay(spark):
    """Every filtering operator hands on columns with names of its own results and helpers."""
    names = ("copies", "size", "mark", "key", "row", "nth", "_match", "_dropped", "n_words", "kept", "_copy", "digest", "target", "_key", "_n")
    rows = [(i, f"word{i} " * 30 + "and so on", "a", *("x" * k for k in range(len(names)))) for i in range(4)] + [(None, "no id " * 20, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for found in (mixing.emit(docs), near_dedup.keep_one(docs), decontamination.remove(docs, items), decontamination.remove(docs, items, how="cut"), quality.keep_good(docs, None)):
        assert found.columns == docs.columns
        assert all(tuple(r)[2:] == whole[r["doc_id"]][2:] for r in found.collect())
    assert {r["doc_id"] for r in decontamination.remove(docs, items).collect()} == {1, 2, 3, None}


def test_near_duplicates_at_other_thresholds(spark):
    import random

    random.seed(12)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(random.choice(["x", "y", w]) if random.random() < 0.03 * (i % 9) else w for w in base[: 40 + i % 20]) for i in range(50)}
    for percent in (60, 90):
        found = near_dedup.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=1, percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == links(texts, 1, percent)
    with pytest.raises(ValueError):
        near_dedup.band_rows(5)


@pytest.mark.parametrize("window", [1, 3, 13])
def test_the_sieve_lets_every_window_through(window):
    rng = np.random.default_rng(7)
    texts = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in rng.integers(0, 60, 400)]
    sieve = decontamination.Sieve(window, 2000)
    items = [t for t in texts[:40] if t]
    for words in items:
        sieve.add(words)
    windows = {tuple(t[a : a + min(window, len(t))]) for t in items for a in range(max(1, len(t) - window + 1))}
    holds = [any(tuple(t[a : a + n]) in windows for n in {len(w) for w in windows} for a in range(len(t) - n + 1)) for t in texts]
    passed = [sieve.lets_through(t) for t in texts]
    assert all(p for h, p in zip(holds, passed, strict=True) if h)
    assert sum(passed) - sum(holds) <= 40


def test_many_chunks_find_what_one_finds(spark, awkward, empty):
    for folder in (awkward, empty):
        docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
        one, many = (decontamination.match(docs, items, window=4, chunk_words=n, into="found_here") for n in (100_000, 7))
        assert one.columns == many.columns
        assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
