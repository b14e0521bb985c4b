"""Token ids of whole texts, written as packed shards in ascending ``doc_id`` order and read back.

A shard is one row of a Parquet table (``part, seq, n_docs, n_tokens, content``): Spark's
own commit protocol then makes the files safe against lost and repeated tasks on every
file system. ``content`` holds the document ids and their null flags, then two packed
streams (see ``simple8b``): tokens per document, and all token ids.

Order and edge cases: rows are in order of ``doc_id`` (null first), rows with equal id in
order of a hash of their text. A null text is an empty one; it still gets its end id.
Repeated rows are separate documents. An empty table gives an empty table. Extra columns
are not read. Texts are never cut; a shard closes after the document that fills it.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqweave.llm.common import arrow_schema, batch_of, only, remembers, texts_of
from reqweave.llm.simple8b import read_stream, stream_bytes
from reqweave.storage import materialize, new_folder

#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20
#: Pieces of text whose ids a worker remembers at most, in two halves: when the younger is full it becomes the older.
MEMORY_PIECES = 600_000
#: Longer pieces are not remembered.
MEMORY_CHARS = 48
#: Characters at which Python splits but the tokenizers' white space pattern does not (fixed values).
_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: the tokenizer's own pattern for lower-case Latin-1 text, with that range's letters, numbers and white space written out.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class _Memory(dict):
    """Ids by piece as little-endian 32-bit integers, made at first sight by ``make``."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= MEMORY_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Whole text to ids, as little-endian 32-bit integers.

    The word tokenizer lowers letters, cuts the text by a pattern and merges within the pieces only, so a text's ids are
    those of its pieces one after the other; frequent pieces are merged once per worker. Latin-1 texts are cut here
    and their new pieces go straight to the library's merge model. In other texts, stretches between white space are
    handled one by one, by the library where they hold other letters. Texts with special tokens, or with one of the
    separators that Python and the tokenizer see differently, are encoded in one piece. A tokenizer
    that does not work like this, as a probe shows, encodes every stretch itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    merge, bytes_of = tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False)
    byte_letters = {c: bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
    packed = lambda ids: np.array(ids, dtype="<u4").tobytes()
    whole = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
    ids = lambda piece: array("I", [t.id for t in merge(piece if piece.isascii() else piece.translate(byte_letters))])
    pieces = _Memory(lambda piece: ids(piece).tobytes())
    latin = lambda text: b"".join(map(pieces.__getitem__, _PIECES.findall(text.lower())))
    probe = "Straße, d'été 12½ it's “x”\x85$$$ l'a...\xa0ÀÉ".replace("“", "«").replace("”", "»")
    known = sys.byteorder == "little" and array("I").itemsize == 4 and latin(probe) == whole(probe)
    stretches = _Memory(lambda stretch: latin(stretch) if known and _is_latin(stretch) else whole(stretch))

    def encode(text: str) -> bytes:
        if "<|" in text or _ODD.search(text):
            return whole(text)
        return latin(text) if known and _is_latin(text) else b"".join(map(stretches.__getitem__, text.split()))

    return encode


remembers("tokens", encoder.cache_clear)


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


SHARD = "part long, seq long, n_docs long, n_tokens long, content binary"
_SHARD_HEAD = struct.Struct("<4sQ")


def shard_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return _SHARD_HEAD.pack(b"TOK1", len(doc_ids)) + numbers.tobytes() + known.tobytes() + stream_bytes(np.array(counts, np.uint64)) + stream_bytes(ids)


def read_shard(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """``(doc_ids, counts, ids)`` of one shard."""
    magic, n = _SHARD_HEAD.unpack_from(content, 0)
    if magic != b"TOK1":
        raise ValueError("not a token shard")
    at = _SHARD_HEAD.size
    numbers = np.frombuffer(content, "<i8", n, at)
    known = np.frombuffer(content, np.uint8, n, at + 8 * n)
    counts, at = read_stream(content, at + 9 * n)
    ids, _ = read_stream(content, at)
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], counts.astype(np.int64), ids.astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write packed shards below ``path`` in ascending id order."""
    rows = texts_of(docs, id_col, text_col)
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    schema, end = arrow_schema(SHARD), np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encode, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, seq
            content = shard_bytes(doc_ids, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
            out = batch_of(schema, {"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_tokens": [held], "content": [content]})
            ids, doc_ids, held, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(encode(text) + end)
                doc_ids.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= SHARD_TOKENS:
                    yield close()
        if doc_ids:
            yield close()

    ordered.mapInArrow(shards, SHARD).write.parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, seq, first``: tokens before each shard. The window over all parts sees one row per written part."""
    parts = materialize(shards.groupBy("part").agg(F.sum("n_tokens").alias("total")), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner"))
    return rows.join(firsts, "part").select("part", "seq", (F.col("part_first") + F.col("inner")).alias("first"))


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the shards: ``doc_id, start, n_tokens, ids_crc32``."""
    shards = spark.read.parquet(path)
    starts = materialize(shard_starts(shards.drop("content")), "starts")  # written, so that its true size decides the join
    placed = shards.select("part", "seq", "content").join(starts, ["part", "seq"]).select("first", "content")
    schema = arrow_schema(READ)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, ids = read_shard(batch.column(1)[k].as_py())
                ends = np.cumsum(counts)
                raw, starts = memoryview(ids.tobytes()), ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch_of(schema, {"doc_id": doc_ids, "start": starts + batch.column(0)[k].as_py(), "n_tokens": counts, "ids_crc32": crc})

    return placed.mapInArrow(documents, READ)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what they hold per document."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
