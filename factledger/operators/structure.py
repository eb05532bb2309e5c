"""Pages of records to section-aware blocks: headers, tables and texts, long texts split, and what carries over from page to page.

A page's blocks hang on what came before in two small things: the stack of open headers and the last characters of what was last said. Both follow from
a page's headers and its tail, so pages are read in parallel twice: once for these, which are folded in page order (small rows, one stream a record, nothing
kept but the state), and once, with the state they begin with, for their blocks. ``streaming.pages`` does the same on a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the longest text block, and how much of it stands before the next one
MOST, TAIL = 3000, 300
HEADER = re.compile(r"(#+)\s+(.*)", re.DOTALL)
BLOCK = "kind: string, path: array<string>, content: string"


def split_lines(text: str, most: int = MOST) -> list[str]:
    """``text`` cut at the last line end within ``most`` characters, or else at the next one: no line is ever broken.

    Pieces have no white space at their ends; one place is kept in the text, so the work grows with its length only.
    """
    if len(text) <= most:
        return [text]
    pieces, at = [], 0
    while len(text) - at > most:
        end = text.rfind("\n", at, at + most)
        if end < 0:
            end = text.find("\n", at + most)
        if end < 0:
            break
        pieces.append(text[at:end].strip())
        at = end
        while text.startswith("\n", at):
            at += 1
    pieces.append(text[at:].strip())
    return [p for p in pieces if p] or [""]


def pushed(stack: list[str], level: int, title: str) -> list[str]:
    """Open headers after one more: the stack is cut above its level (entries count, not levels)."""
    return [*stack[: level - 1], title]


def chunks(text: str) -> Iterator[tuple[tuple[int, str] | None, list[str]]]:
    """(header, lines) in order: a header opens a chunk, and so does a change between table lines and others; blank lines stay where they are."""
    header, lines, table = None, [], None
    for line in text.split("\n"):
        found = HEADER.match(line)
        kind = "|" in line if line.strip() else table
        if found or (table is not None and kind != table):
            yield header, lines
            header, lines = None, []
        if found:
            header, table = (len(found[1]), found[2].strip()), None
        else:
            lines.append(line)
            table = kind
    yield header, lines


def page_blocks(text: str | None, stack: list[str], tail: str, most: int = MOST) -> tuple[list[dict], list[str], str]:
    """A page's blocks, and the state behind it. A table (lines with pipes, one of them a rule) stays whole; other texts are split and say what came before."""
    blocks = []
    for header, lines in chunks(text or ""):
        if header:
            stack = pushed(stack, *header)
        content = "\n".join(lines).strip()
        if not content:
            continue
        table = any("|" in x and "---" in x for x in lines)
        for piece in [content] if table else split_lines(content, most):
            before = f"[Previous Context: {tail}]\n\n" if tail and not table else ""
            blocks.append({"kind": "TABLE" if table else "TEXT", "path": stack, "content": before + piece})
            tail = piece[-TAIL:]
    return blocks, stack, tail


def blocks_of_pages(pages: DataFrame, record: str, page: str, most: int = MOST) -> DataFrame:
    """record, page, seq, kind, path, content of every block of ``pages`` (record, page, text).

    Null and empty texts have no blocks and hand on what came before; pages of equal number are read in the order of their texts; a page of any length is
    one row, cut at its line ends; null records are one record.
    """
    named = pages.select(F.col(record).alias("record"), F.col(page).alias("page"), "text")
    numbered = named.withColumn("_key", F.xxhash64("record", "page", "text"))
    keys = dict(named.select("record", "page").dtypes)

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [page_blocks(t, [], "", most) for t in b["text"]]
            heads = [[{"level": h[0], "title": h[1]} for h, _ in chunks(t or "") if h] for t in b["text"]]
            yield b[["record", "page", "_key"]].assign(heads=heads, tail=[tail for _, _, tail in parts])

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack, tail = (), [], ""
        for b in batches:
            starts = []
            for row in b.itertuples(index=False):
                if (who := (None if pd.isna(row.record) else row.record,)) != now:
                    now, stack, tail = who, [], ""
                starts.append((stack, tail))
                for h in row.heads:
                    stack = pushed(stack, h["level"], h["title"])
                tail = row.tail or tail
            yield b[["_key"]].assign(stack=[list(s) for s, _ in starts], before=[t for _, t in starts])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["record", "page"]].assign(blocks=[page_blocks(t, list(s), before, most)[0] for t, s, before in zip(b["text"], b["stack"], b["before"], strict=True)])

    who = f"record {keys['record']}, page {keys['page']}"
    heads = numbered.mapInPandas(outline, f"{who}, _key long, heads array<struct<level: int, title: string>>, tail string")
    in_order = heads.repartition("record").sortWithinPartitions("record", "page", "_key")
    states = in_order.mapInPandas(carry, "_key long, stack array<string>, before string").dropDuplicates(["_key"])
    done = numbered.join(states, "_key").mapInPandas(read, f"{who}, blocks array<struct<{BLOCK}>>")
    return done.select("record", "page", F.posexplode("blocks").alias("seq", "b")).select("record", "page", "seq", "b.*")


def line_pieces(most: int = MOST):
    """A function of a text column: its pieces (see ``split_lines``); null for null."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_lines(t, most))

    return pieces


SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sentence_pieces(text: str, most: int = 1500) -> list[str]:
    """``text`` in pieces of up to ``most`` characters, whole sentences joined by a space; a longer sentence begins a new piece and is taken by words.

    White space at the text's ends doesn't count. A piece keeps a place for the space that would follow, so a sentence of just ``most`` characters stands alone, and a
    word that is longer is a piece of its own, the only one that is too long. A text that fits is returned as it is.
    """
    if len(text) <= most:
        return [text]
    pieces: list[list[str]] = [[]]
    size = 0
    for sentence in SENTENCE.split(text.strip()):
        whole = len(sentence) <= most
        for k, part in enumerate([sentence] if whole else sentence.split()):
            fits = size + len(part) < most and (whole or k)
            if not fits and pieces[-1]:
                pieces.append([])
            size = size + 1 + len(part) if pieces[-1] else len(part)
            pieces[-1].append(part)
    return [joined for p in pieces if (joined := " ".join(p))] or [text]


def sentence_column(most: int = 1500):
    """A function of a text column: its pieces (see ``sentence_pieces``); null for null."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sentence_pieces(t, most))

    return pieces


def token_counter(path: str):
    """A function of a text column: how many ids the tokenizer file at ``path`` gives it; null for null. A task reads the file once."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in parts:
            known = texts.dropna()
            sizes = pd.Series([len(e.ids) for e in tokenizer.encode_batch(known.tolist(), add_special_tokens=False)], index=known.index, dtype="Int64")
            yield sizes.reindex(texts.index)

    return count


def token_prefix(path: str, budget: int):
    """A function of a text column: as much of each text as its first ``budget`` ids cover, by the tokenizer file at ``path``; null for null."""

    @F.pandas_udf("string")
    def prefix(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def cut(text: str | None) -> str | None:
            ends = tokenizer.encode(text, add_special_tokens=False).offsets if text is not None else ()
            return text if len(ends) <= budget else text[: max((e for _, e in ends[:budget]), default=0)]

        for texts in parts:
            yield texts.map(cut)

    return prefix
