"""Pages that arrive in a stream, to the blocks that the batch gives: header stack and last characters are a record's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from factledger.operators.structure import MOST, page_blocks
from factledger.streaming.events import keep_state


class Carry(StatefulProcessor):
    """Reads a record's pages in order of their number. A page that comes before its predecessors waits in the state until they are there.

    State: the next page's number, the header stack and the tail; and the waiting pages. A page that was read before is passed over.
    """

    def __init__(self, first: int, most: int):
        self.first, self.most = first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next long, stack array<string>, tail string")
        self.waiting = handle.getMapState("waiting", "page long", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        at, stack, tail = self.now.get() if self.now.exists() else (self.first, [], "")
        for frame in rows:
            for page, text in zip(frame["page"], frame["text"], strict=True):
                if page >= at and not self.waiting.containsKey((int(page),)):
                    self.waiting.updateValue((int(page),), (text,))
        stack, out = list(stack), []
        while self.waiting.containsKey((at,)):
            (text,) = self.waiting.getValue((at,))
            blocks, stack, tail = page_blocks(text, stack, tail, self.most)
            out += [{"record": key[0], "page": at, "seq": k, **b} for k, b in enumerate(blocks)]
            self.waiting.removeKey((at,))
            at += 1
        self.now.update((at, stack, tail))
        yield pd.DataFrame(out, columns=["record", "page", "seq", "kind", "path", "content"])

    def close(self) -> None:
        pass


def stream_blocks(pages: DataFrame, first: int = 0, most: int = MOST) -> DataFrame:
    """record, page, seq, kind, path, content from a stream of (record string, page long, text), pages numbered from ``first`` without gaps.

    Needs the RocksDB state store. Rows of a page come out once all pages before it are there, in whichever micro-batch that is; a restart goes on from the checkpoint.
    """
    keep_state(pages.sparkSession)
    schema = StructType.fromDDL("record string, page long, seq int, kind string, path array<string>, content string")
    return pages.groupBy("record").transformWithStateInPandas(Carry(first, most), schema, "Append", "None")
