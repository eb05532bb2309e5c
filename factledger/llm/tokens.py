r"""Token-ID output: one wavelet matrix per shard, readable without unpacking.

Texts are encoded with a public tokenizer file; an end id follows each document. Documents are range
partitioned by doc_id (ties by text, null first), each partition is cut into shards of about ``shard_tokens`` ids, and a
shard becomes one file: a small header, the doc_ids, the document lengths, a rank directory and one bit-plane for each bit of
an id. Planes are zstd-compressed in blocks, and the directory has the ones before each block, so access, rank (count)
and select (occurrence) inflate a block or two of each plane. The files are rows of a Parquet table in the shared folder,
so they lie wherever Spark can write.

A text is encoded in chunks. Byte-level BPE never joins what stands before a space with what follows, so
chunks between spaces are encoded alone, and their words remembered, within bounds; texts with unusual white space are cut more
carefully. The ids are those of encoding the whole text.

Defined results: null and empty texts give the end id alone; null doc_ids come first; repeated rows are
documents of their own; a very long text is a shard of its own and is held whole by one task; an empty table gives no file;
only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: For Arrow: unusual white space, and the mark used below; spaces beside other white space; line breaks beside other white space.
RARE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]"
MANY_SPACES, BREAKS_BY_SPACE = r"  | [\n\t\r]|[\n\t\r] $", r"\n[ \n\t\r]|[ \t\r]\n"
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )|(?= \S)")

#: Byte-level BPE writes each byte as a letter: printable Latin-1 bytes as themselves, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHER = [b for b in range(256) if b not in PRINTABLE]
LETTERS = np.arange(256, dtype="<u2")
LETTERS[OTHER] = 256 + np.arange(len(OTHER))
LETTERS[0] = 32  # the mark between words


def marks(text: str) -> str | None:
    """``text`` with ``\\0`` between parts that byte-level BPE encodes independently; None if it has such a character."""
    return None if "\0" in text else "\0".join(BEFORE_SPACE.split(text))


def marked(texts: pa.Array) -> pa.Array:
    """``marks`` of all texts; where no white space stands beside other, Arrow sets them, also around line breaks between visible characters."""
    rare, many, beside = (pc.match_substring_regex(texts, p) for p in (RARE, MANY_SPACES, BREAKS_BY_SPACE))
    careful = pc.or_(rare, many)
    lines = pc.if_else(beside, texts, pc.replace_substring(texts, "\n", "\0\n\0"))
    out = pc.replace_substring(lines, " ", "\0 ")
    some = pa.array([marks(t) for t in texts.filter(careful).to_pylist()], texts.type)
    return pc.replace_with_mask(out, careful, some) if len(some) else out


#: Letters after at most one space are one pre-token; a full stop or comma after them, at the end of a chunk, is another.
LETTERS_ONLY, LETTERS_AND_STOP = r"^ ?\pL+$", r"^ ?\pL+[.,]$"
STOPS = frozenset(".,")


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``source`` that ``picks`` name, one after the other, and the length of each."""
    lengths = sizes[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    places = np.repeat((starts[picks] - (ends - lengths)).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return source[places], lengths


def _split(chunk: str) -> tuple[str, ...]:
    """Line breaks between visible characters, and a full stop or comma after a letter, are tokens of their own."""
    if "\n" not in chunk:
        return (chunk[:-1], chunk[-1]) if chunk[-1:] in STOPS and chunk[-2:-1].isalpha() else (chunk,)
    lines = chunk.split("\n")
    if any(not x or x[0].isspace() or x[-1].isspace() for x in (lines[0].removeprefix(" "), *lines[1:])):
        return (chunk,)
    out = list(_split(lines[0]))
    for line in lines[1:]:
        out += "\n", *_split(line)
    return tuple(out)


class Encoder:
    """A tokenizer file with a bounded memory of words: an Arrow array of them, and where their ids lie.

    Each batch's distinct words are looked up in one call; when the memory is full, the words of the latest batch stay.
    """

    def __init__(self, path: str, most: int = 500_000, call: int = 10_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.most, self.call = Tokenizer.from_file(path), most, call  # words of one call are held with all that the library keeps of them
        vocabulary = self.tokenizer.get_vocab()
        self.letters = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.letters[list(vocabulary.values())] = list(map(len, vocabulary))
        self.by_space = Tokenizer(self.tokenizer.model)
        self.by_space.pre_tokenizer = WhitespaceSplit()
        self.tokenizer.model._resize_cache(0)  # words come here once, so the library's own memory of them only costs
        self.wide = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known = pa.array([], pa.large_string())
        self.ids, self.starts, self.sizes = np.zeros(0, self.wide), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, and each word's start and size in them; the tokenizer's model takes all words of letters in few calls."""
        letters = pc.match_substring_regex(words, LETTERS_ONLY)
        plain = letters.to_numpy(zero_copy_only=False)
        found, sizes = [np.zeros(0, self.wide)], np.empty(len(words), np.int64)
        some, own = words.filter(letters), []
        for at in range(0, len(some), self.call):
            raw = np.frombuffer("\0".join(some[at : at + self.call].to_pylist()).encode(), np.uint8)
            one = self.by_space.encode_batch_fast([LETTERS[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0]
            ids = np.array(one.ids, self.wide)
            gaps = np.flatnonzero(raw == 0)
            # a word ends where its letters end
            ends = np.searchsorted(np.cumsum(self.letters[ids]), np.append(gaps, len(raw)) - np.arange(len(gaps) + 1)) + 1
            own.append(np.diff(ends, prepend=0))
            found.append(ids)
        sizes[plain] = np.concatenate([np.zeros(0, np.int64), *own])
        some, own = words.filter(pc.invert(letters)), []
        for at in range(0, len(some), self.call):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(some[at : at + self.call].to_pylist(), add_special_tokens=False)]
            own += map(len, coded)
            found.append(np.fromiter(itertools.chain.from_iterable(coded), self.wide))
        sizes[~plain] = own
        starts, base = np.empty(len(words), np.int64), 0
        for kind in (plain, ~plain):
            ends = np.cumsum(sizes[kind])
            starts[kind] = base + ends - sizes[kind]
            base += int(ends[-1]) if len(ends) else 0
        return np.concatenate(found), starts, sizes

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The place in the memory of each of the distinct words; new ones are encoded first."""
        places = pc.index_in(words, value_set=self.known)
        known = pc.is_valid(places).to_numpy(zero_copy_only=False)
        out = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + len(words) > self.most and len(self.known):
            held = out[known]
            self.ids, self.sizes = gather(self.ids, self.starts, self.sizes, held)
            self.starts, self.known = np.cumsum(self.sizes) - self.sizes, self.known.take(pa.array(held))
            out[known] = np.arange(len(held))
        new = words.filter(pa.array(~known))
        ids, starts, sizes = self._encode(new)
        out[~known] = len(self.known) + np.arange(len(new))
        self.starts, self.sizes, self.ids = np.concatenate((self.starts, len(self.ids) + starts)), np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        self.known = pa.concat_arrays([self.known, new])
        return out

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and how many each has; words that chunks share are looked up once."""
        alone, stopped = pc.match_substring_regex(chunks, LETTERS_ONLY), pc.match_substring_regex(chunks, LETTERS_AND_STOP)
        ended = chunks.filter(stopped)
        split = [_split(c) for c in chunks.filter(pc.invert(pc.or_(alone, stopped))).to_pylist()]
        pieces = [chunks.filter(alone), pc.utf8_slice_codeunits(ended, 0, -1), pc.utf8_slice_codeunits(ended, -1), pa.array(list(itertools.chain.from_iterable(split)), pa.large_string())]
        words = pa.concat_arrays(pieces).dictionary_encode()
        codes = np.split(words.indices.to_numpy(), np.cumsum(list(map(len, pieces)))[:-1])
        one, two = (x.to_numpy(zero_copy_only=False) for x in (alone, stopped))
        counts = np.where(two, 2, 1)
        counts[~(one | two)] = list(map(len, split))
        edges = np.concatenate(([0], np.cumsum(counts)))
        order, rest = np.empty(edges[-1], np.int64), np.ones(edges[-1], bool)
        for places, some in ((edges[:-1][one], codes[0]), (edges[:-1][two], codes[1]), (edges[:-1][two] + 1, codes[2])):
            order[places], rest[places] = some, False
        order[rest] = codes[3]
        places = self._learn(words.dictionary)
        ids, lengths = gather(self.ids, self.starts, self.sizes, places[order])
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[edges])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        parts = pc.split_pattern(marked(pa.array(texts, pa.large_string())), "\0")
        coded = pc.fill_null(parts, []).flatten().dictionary_encode()
        own, sizes = self._encode_chunks(coded.dictionary)
        ids, lengths = gather(own, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy())))]
        counts = np.diff(edges)
        if parts.null_count:  # a text that has the mark itself is encoded in one piece
            pieces = np.split(ids, edges[1:-1])
            for k in np.flatnonzero(parts.is_null()):
                pieces[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.wide)
            ids, counts = np.concatenate(pieces), np.array(list(map(len, pieces)))
        return ids, counts


BLOCK = 1 << 16  # bits of a plane that one frame holds


def planes_of(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes, most significant first, each ordered by the planes above it; and the zeros of each."""
    planes, zeros = [], []
    for k in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << k)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        low = np.flatnonzero(~ones)
        zeros.append(len(low))
        ids = np.concatenate((ids[low], ids[np.flatnonzero(ones)]))
    return planes, zeros


def pack(ids: np.ndarray, lengths: list[int], doc_ids: list[int | None], bits: int) -> bytes:
    """A shard's file: ``WVM2``, header length, header, then zstd frames of doc_ids, lengths, the rank directory and the planes.

    A plane is cut into blocks of ``BLOCK`` bits, a frame each; the directory has the ones of a plane before each block.
    """
    planes, zeros = planes_of(ids, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks = [[p[at : at + BLOCK // 8] for at in range(0, len(p), BLOCK // 8)] for p in planes]
    ranks = np.array([np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in p)])[: len(p)] for p in blocks], "<u4")
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [squeeze(x.tobytes()) for x in (numbers, np.array(lengths, "<u4"), ranks, *itertools.chain.from_iterable(blocks))]
    header = {"ids": len(ids), "docs": len(doc_ids), "null_ids": [k for k, d in enumerate(doc_ids) if d is None], "zeros": zeros, "parts": [len(p) for p in parts]}
    head = json.dumps(header).encode()
    return b"".join([b"WVM2", struct.pack("<I", len(head)), head, *parts])


class WaveletMatrix:
    """A shard's file, read where it is asked for: a point query inflates one block or two of each plane."""

    def __init__(self, file: bytes):
        if file[:4] != b"WVM2":
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", file[4:8])
        header = json.loads(file[8 : 8 + size])
        self.file, self.n, self.zeros = file, header["ids"], header["zeros"]
        self.ends = 8 + size + np.cumsum(header["parts"])
        self.frames = np.concatenate(([8 + size], self.ends[:-1]))
        self.inflate = zstandard.ZstdDecompressor().decompress
        self.doc_ids: list[int | None] = np.frombuffer(self._frame(0), "<i8").tolist()
        for k in header["null_ids"]:
            self.doc_ids[k] = None
        self.lengths = np.frombuffer(self._frame(1), "<u4")
        self.ranks = np.frombuffer(self._frame(2), "<u4").reshape(len(self.zeros), -1).astype(np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _frame(self, k: int) -> bytes:
        return self.inflate(self.file[self.frames[k] : self.ends[k]])

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block; the blocks asked for last are held."""
        found = self.held.get((plane, block))
        if found is None:
            if len(self.held) >= 4 * len(self.zeros):
                self.held.clear()
            raw = np.frombuffer(self._frame(3 + plane * self.ranks.shape[1] + block), np.uint8)
            found = self.held[plane, block] = np.unpackbits(raw, bitorder="little")[: self.n - block * BLOCK].view(bool)
        return found

    def ids(self, kind: type = np.uint32) -> np.ndarray:
        """The whole sequence, from the lowest plane upwards."""
        out, blocks = np.zeros(self.n, kind), self.ranks.shape[1]
        for k, zero in enumerate(reversed(self.zeros)):
            first = 3 + (len(self.zeros) - 1 - k) * blocks
            raw = np.frombuffer(b"".join(map(self._frame, range(first, first + blocks))), np.uint8)
            ones = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            order = np.empty(self.n, kind)
            order[np.flatnonzero(~ones)] = out[:zero]
            order[np.flatnonzero(ones)] = out[zero:] | kind(1 << k)
            out = order
        return out

    def _ones(self, k: int, at: int) -> int:
        """Ones of a plane before a place."""
        if at >= self.n:
            return self.n - self.zeros[k]
        block, inside = divmod(at, BLOCK)
        return int(self.ranks[k, block]) + (int(np.count_nonzero(self._block(k, block)[:inside])) if inside else 0)

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for k, zero in enumerate(self.zeros):
            one = bool(self._block(k, at // BLOCK)[at % BLOCK])
            value = value << 1 | one
            ones = self._ones(k, at)
            at = zero + ones if one else at - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for k, zero in enumerate(self.zeros):
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = (zero + a, zero + b) if value >> (len(self.zeros) - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs between two places."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _select(self, k: int, one: bool, nth: int) -> int:
        """The place of the nth (from 0) bit of that kind in a plane."""
        have = self.ranks[k] if one else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[k]
        block = int(np.searchsorted(have, nth, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(k, block) == one)[nth - int(have[block])])

    def occurrence(self, value: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of an id."""
        start, end = self._range(value, 0, self.n)
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        at = start + nth
        for k in range(len(self.zeros) - 1, -1, -1):
            one = bool(value >> (len(self.zeros) - 1 - k) & 1)
            at = self._select(k, one, at - self.zeros[k] if one else at)
        return at


_ENCODERS: dict[str, Encoder] = {}


def _gathered(batches: Iterator[pa.RecordBatch], enough: int = 6 << 20) -> Iterator[tuple[list[int | None], list[str]]]:
    """doc_ids and texts of about ``enough`` bytes: the more texts, the more of their words are the same, and the more is held at once."""
    doc_ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        doc_ids += b["doc_id"].to_pylist()
        texts += [t or "" for t in b["text"].to_pylist()]
        size += b["text"].nbytes
        if size >= enough:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 500_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shards; the table of files: part, shard, docs, tokens, file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or Encoder(tokenizer)
        _ENCODERS[tokenizer] = encoder
        end = np.array([end_id], encoder.wide)
        bits = max(int(end_id).bit_length(), (encoder.tokenizer.get_vocab_size() - 1).bit_length())
        part, shard = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for h in held for x in (h, end)])
            row = (part, shard, len(held), len(ids), pack(ids, [len(h) + 1 for h in held], doc_ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "docs", "tokens", "file"])

        for rows, texts in _gathered(batches):
            ids, counts = encoder.encode(texts)
            for doc_id, own in zip(rows, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                held.append(own)
                doc_ids.append(doc_id)
                size += len(own) + 1
                if size >= shard_tokens:
                    yield flush()
                    held, doc_ids, size, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part int, shard int, docs long, tokens long, file binary"), "token-shards")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """part, shard, doc_id, at (place in the document) of each occurrence of an id, found by rank and select in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, file in zip(b["part"].to_pylist(), b["shard"].to_pylist(), b["file"], strict=True):
                matrix = WaveletMatrix(file.as_py())
                at = np.array([matrix.occurrence(token, k) for k in range(matrix.count(token))], np.int64)
                ends = np.cumsum(matrix.lengths, dtype=np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(at), pa.int32()), pa.array([shard] * len(at), pa.int32()), pa.array([matrix.doc_ids[k] for k in doc], pa.int64()),
                        pa.array(at - (ends - matrix.lengths)[doc]),
                    ],
                    ["part", "shard", "doc_id", "at"],
                )

    return files.select("part", "shard", "file").mapInArrow(run, "part int, shard int, doc_id long, at long")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in the whole output), n_tokens, ids_crc32, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, file in zip(b["part"].to_pylist(), b["shard"].to_pylist(), b["file"], strict=True):
                matrix = WaveletMatrix(file.as_py())
                lengths, doc_ids = matrix.lengths, matrix.doc_ids
                ids = matrix.ids(np.uint16 if len(matrix.zeros) <= 16 else np.uint32).astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = files.select("part", "shard", "file").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the writer
    parts = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
