"""Best-fit decreasing packing of tokenised documents into windows.

Each text is encoded, ended with ``end_id`` and cut: full windows first, then the rest.
Rests are dealt into groups of about ``GROUP_PIECES`` by a hash of their row, and each group
is packed on its own: longest first, each into the open window with the least room that
still holds it, found in a segment tree over remaining room. Only ids, lengths and
checksums travel; token ids stay in the task that made them.

Edge cases: a null text is an empty one and gives one piece, its end id. Repeated rows are
separate documents. Ties go by ``doc_id``, then by row. An empty table gives no pieces.
Extra columns are not read. A document of any length is cut into full windows, none is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.common import arrow_schema, batch_of, only, texts_of
from reqweave.llm.tokens import encoder
from reqweave.storage import materialize

WINDOW = 4096
#: Pieces packed together. A group leaves one badly filled window or so; the last windows of a group are its only waste.
GROUP_PIECES = 8192


class RoomTree:
    """Open windows by room left: a segment tree that finds the least sufficient room in ``log2(size)`` steps."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def open(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """``(room, window)`` of the tightest window with at least ``need`` room, removed from the tree."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], size: int = WINDOW) -> list[tuple[int, int]]:
    """``(window, offset)`` of each length; lengths must come in falling order."""
    tree, opened, placed = RoomTree(size), 0, []
    for length in lengths:
        found = tree.take(length)
        if found is None:
            room, window, opened = size, opened, opened + 1
        else:
            room, window = found
        placed.append((window, size - room))
        if room > length:
            tree.open(room - length, window)
    return placed


PIECE = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``size`` ids: full windows of each document, then its rest."""
    schema, end = arrow_schema(PIECE), end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encode, row = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text) + end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    stop = min(start + size, total)
                    for name, value in zip(schema.names, (row, doc_id, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), total), strict=True):
                        out[name].append(value)
                    row += 1
            yield batch_of(schema, out)

    return texts_of(docs, id_col, text_col).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece with its window and the place in it.

    The pieces are written first: their number gives the number of groups, and a lost
    executor repeats neither encoding nor numbering. A full window needs no group.
    """
    cut = materialize(pieces(docs, tokenizer_path, end_id, size), "pieces")
    rests = cut.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group_pieces))
    # sequence ids: full windows have even numbers by row, packed windows odd numbers by group and window
    full = cut.where(F.col("length") >= size).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        placed = best_fit(group["length"].tolist(), size)
        group["sequence_id"] = [((key[0] << 32) + window) * 2 + 1 for window, _ in placed]
        group["offset"] = [offset for _, offset in placed]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = rests.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("bin").applyInPandas(lambda key, group: place(key, group.drop(columns="bin")), PLACED))
