"""Removal of byte strings that occur earlier in the corpus, by longest-previous-factor arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with
a smaller id, or before in its own. Where a string may recur is found first, without
sorting every suffix of the corpus:

* Every string has one anchor, the leftmost of its ``GRAM``-byte substrings with the least hash. It
  depends on the string's bytes alone, so equal strings have equal anchors. Neighbouring strings mostly
  share one: a run is a stretch of starts with one anchor, and its text all that these strings cover.
* Runs are hashed, and combined before they are shuffled: of the runs of a task with the same anchor and text
  the earliest alone travels, in packed arrays by buckets of anchors. In its bucket an anchor that
  occurs once is dropped, and a run whose text is that of an earlier one is a copy throughout. Of an anchor
  with many texts in one task a single marked run travels; the others are known to be edges. So a
  bucket holds a bounded number of runs of an anchor from each task, however common it is.
* The earliest runs of anchors with several texts are where copies begin and end. Their texts are laid out in
  corpus order, their suffixes sorted, and the longest previous factor of each start is the longer of its common
  prefixes with the nearest suffixes, before and behind in suffix order, that lie earlier in the corpus.
  Anchors with very many texts (``HOT_RUNS``) do not meet in one task: the strings of their runs are grouped
  by hash instead, each keeping its earliest place.

Edge cases: null and empty texts have no byte and keep none. Texts are whole UTF-8 bytes; the kept bytes need not
be UTF-8. Documents of equal id are ordered by a hash of their text; rows with equal id and equal text are one
document and judged alike. Null ids come last. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.common import texts_of
from reqweave.storage import materialize

LENGTH = 100
GRAM = 32
#: Bytes of text whose runs one bucket holds, and bytes of text that a task combines before it sends.
BUCKET_BYTES, TASK_BYTES = 48 << 20, 48 << 20
#: Texts of one anchor above which a task sends a single run of it to the bucket; the others are edges anyway.
TASK_TEXTS = 64
#: Contexts of one anchor above which its strings are grouped by hash, and bytes of contexts sorted together.
HOT_RUNS, SORTED_BYTES = 20_000, 2 << 20
#: Starts looked at together in a long document.
PART = 1 << 19

_WINDOW = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0xD1342543DE82EF95
_LAST_ID = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


@functools.cache
def _byte_hashes() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of hashed bytes times powers, and the inverse powers that make differences independent of place."""
    size = 1 << max(10, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_hashes()[raw] * _powers(size, _BASE)[: len(raw)], out=sums[1:])
    return sums, _powers(size, pow(_BASE, -1, 1 << 64))


def runs(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, text hash, first start, starts, anchor's place from there)`` of the runs of a document, in order."""
    found = [_part_runs(content, at) for at in range(0, max(1, len(content) - LENGTH + 1), PART)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _part_runs(content: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(content, np.uint8, min(len(content) - at, PART + LENGTH - 1), at)
    starts = len(raw) - LENGTH + 1
    if starts <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    sums, back = _sums(raw)
    grams = starts + _WINDOW - 1
    hashes = _mix((sums[GRAM:] - sums[:-GRAM]) * back[:grams])
    least = (hashes & ~_LOW) | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= _WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:starts], least[_WINDOW - width : _WINDOW - width + starts])
    place = (least & _LOW).astype(np.int64)
    new = np.ones(starts, bool)
    new[1:] = place[1:] != place[:-1]
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, starts))
    anchor = place[first]
    end = first + count - 1 + LENGTH
    text = _mix((sums[end] - sums[first]) * back[first] + ((anchor - first) * 256 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes[anchor], text, (first + at).astype(np.uint32), count.astype(np.uint8), (anchor - first).astype(np.uint8)


_BLOB = struct.Struct("<IIII")
#: Added to a run's place in its anchor's window (at most 68): the anchor has many texts in this task.
_MANY = 128
_EDGE = np.dtype([("doc", "<u4"), ("start", "<u4"), ("end", "<u4"), ("anchor", "<u8"), ("place", "u1")])
_KINDS = [np.dtype(k) for k in ("<u8", "<u8", "<u4", "u1", "u1", "<u2")]


def _blob(ids: np.ndarray, ties: np.ndarray, columns: list[np.ndarray], spans: np.ndarray, edges: np.ndarray) -> bytes:
    """Runs (anchor, text, first, starts, place, document), finished spans (document, start, end) and known edges of one task and bucket."""
    used, index = np.unique(np.concatenate([columns[5], spans[:, 0], edges["doc"]]), return_inverse=True)
    n, m = len(columns[0]), len(spans)
    columns = [*columns[:5], index[:n]]
    spans = np.column_stack([index[n : n + m], spans[:, 1:]]).astype("<u4")
    edges = edges.copy()
    edges["doc"] = index[n + m :]
    parts = [_BLOB.pack(len(used), n, m, len(edges)), ids[used].astype("<i8").tobytes(), ties[used].astype("<i8").tobytes()]
    return b"".join([*parts, *(c.astype(k).tobytes() for c, k in zip(columns, _KINDS, strict=True)), spans.tobytes(), edges.tobytes()])


def _read_blob(content: bytes) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Runs as (anchor, text, first, starts, place, id, tie), spans as (id, tie, start, end), edges as (id, tie, start, end, anchor, place)."""
    docs, n, m, more = _BLOB.unpack_from(content)
    at = _BLOB.size
    ids, ties = (np.frombuffer(content, "<i8", docs, at + k * 8 * docs) for k in (0, 1))
    at += 16 * docs
    columns = []
    for kind in _KINDS:
        columns.append(np.frombuffer(content, kind, n, at))
        at += kind.itemsize * n
    found = np.frombuffer(content, "<u4", 3 * m, at).reshape(-1, 3)
    edges = np.frombuffer(content, _EDGE, more, at + 12 * m)
    known = [ids[edges["doc"]], ties[edges["doc"]], *(edges[c] for c in ("start", "end", "anchor", "place"))]
    return [*columns[:5], ids[columns[5]], ties[columns[5]]], [ids[found[:, 0]], ties[found[:, 0]], found[:, 1], found[:, 2]], known


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.nonzero(new)[0]
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def _task_blobs(docs: list[tuple[int, int, bytes]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Runs of some documents by bucket; of runs with equal anchor and text the earliest alone, the others as spans."""
    docs.sort(key=lambda d: (d[0], d[1]))
    ids, ties = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
    found = [runs(d[2]) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(f[0]) for f in found])
    anchor, text, first, starts, place = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((text, anchor))  # stable: documents came in corpus order
    again = np.zeros(len(order), bool)
    a, t = anchor[order], text[order]
    again[1:] = (a[1:] == a[:-1]) & (t[1:] == t[:-1])
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    here, its = owner[order], owner[order[lead]]
    copy = again & ~((ids[here] == ids[its]) & (ties[here] == ties[its]) & (first[order] == first[order[lead]]))
    gone = np.sort(order[copy])
    texts = order[~again]  # one run per text, by anchor
    lead_text = np.append(True, anchor[texts][1:] != anchor[texts][:-1])[: len(texts)]
    group = np.cumsum(lead_text) - 1
    many = np.bincount(group, minlength=1)[group] > TASK_TEXTS
    place = place.copy()
    place[texts[many & lead_text]] |= _MANY
    keep, known = np.sort(texts[~many | lead_text]), texts[many & ~lead_text]
    edges = np.zeros(len(known), _EDGE)
    for name, values in (("doc", owner), ("start", first), ("end", first.astype(np.int64) + starts - 1 + LENGTH), ("anchor", anchor), ("place", place)):
        edges[name] = values[known]
    edge_bucket = (ties[edges["doc"]] % buckets).astype(np.int64)
    bucket = (anchor >> np.uint64(32)) % np.uint64(buckets)
    spans = []
    for doc in np.unique(owner[gone]):
        mine = gone[np.searchsorted(owner[gone], doc) : np.searchsorted(owner[gone], doc, side="right")]
        s, e = merged(first[mine].astype(np.int64), first[mine].astype(np.int64) + starts[mine] - 1 + LENGTH)
        spans.append(np.column_stack([np.full(len(s), doc), s, e]))
    span = np.concatenate(spans) if spans else np.zeros((0, 3), np.int64)
    span_bucket = (ties[span[:, 0]] % buckets).astype(np.int64)
    keep = keep[np.argsort(bucket[keep], kind="stable")]
    for b in np.union1d(bucket[keep].astype(np.int64), np.union1d(span_bucket, edge_bucket)):
        mine = keep[np.searchsorted(bucket[keep], b) : np.searchsorted(bucket[keep], b, side="right")]
        yield int(b), _blob(ids, ties, [anchor[mine], text[mine], first[mine], starts[mine], place[mine], owner[mine]], span[span_bucket == b], edges[edge_bucket == b])


def ordered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ord, tie, text``: (ord, tie) is a document's place in the corpus."""
    return texts_of(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("ord"), F.xxhash64("text").alias("tie"), "text")


def bucketed_runs(texts: DataFrame, buckets: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), ("content", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for bucket, content in _task_blobs(held, buckets):
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([content], pa.binary())], schema=schema)

        for batch in batches:
            for place, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = text.encode()
                if len(content) >= LENGTH:
                    held.append((place, tie, content))
                    size += len(content)
                if size >= TASK_BYTES or len(held) >= 60_000:
                    yield from close()
                    held, size = [], 0
        if held:
            yield from close()

    return texts.select("ord", "tie", "text").mapInArrow(send, "bucket int, content binary")


FOUND = "ord bigint, tie bigint, start bigint, end bigint, anchor bigint, place int"
_FOUND = pa.schema([("ord", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64()), ("place", pa.int32())])


def copies_and_edges(blobs: DataFrame) -> DataFrame:
    """Spans that are copies (null ``anchor``), and the earliest run of each text of anchors with several texts."""

    def judge(table: pa.Table) -> pa.Table:
        read = [_read_blob(c.as_py()) for c in table.column("content")]
        anchor, text, first, starts, place, ids, ties = (np.concatenate(c) for c in zip(*(r[0] for r in read), strict=True))
        spans = [np.concatenate(c).astype(np.int64) for c in zip(*(r[1] for r in read), strict=True)]
        known = [np.concatenate(c) for c in zip(*(r[2] for r in read), strict=True)]
        marked = place >= _MANY
        place = place & (_MANY - 1)
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        alone = np.ones(len(a), bool)
        alone[1:] &= a[1:] != a[:-1]
        alone[:-1] &= a[:-1] != a[1:]
        rest = order[~alone | marked[order]]
        rest = rest[np.lexsort((first[rest], ties[rest], ids[rest], text[rest], anchor[rest]))]
        a, t = anchor[rest], text[rest]
        new_a, new_t = np.ones(len(rest), bool), np.ones(len(rest), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_t[1:] = new_a[1:] | (t[1:] != t[:-1])
        lead = rest[np.maximum.accumulate(np.where(new_t, np.arange(len(rest)), 0))] if len(rest) else rest
        copy = ~((ids[rest] == ids[lead]) & (ties[rest] == ties[lead]) & (first[rest] == first[lead]))
        group = np.cumsum(new_a) - 1
        several = (np.bincount(group, new_t)[group] > 1) | (np.bincount(group, marked[rest])[group] > 0) if len(rest) else np.zeros(0, bool)
        end = first.astype(np.int64) + starts - 1 + LENGTH
        c, e = rest[copy], rest[new_t & several]
        n = len(spans[0]) + len(c)
        columns = [np.concatenate([spans[k], col[c], col[e], known[k]]).astype(np.int64) for k, col in enumerate((ids, ties, first, end))]
        mask = np.arange(n + len(e) + len(known[0])) < n
        anchors = np.concatenate([np.zeros(n, np.int64), anchor[e].astype(np.int64), known[4].astype(np.int64)])
        places = np.concatenate([np.zeros(n, np.int32), place[e].astype(np.int32), known[5].astype(np.int32)])
        return pa.table([*map(pa.array, columns), pa.array(anchors, mask=mask), pa.array(places, pa.int32(), mask=mask)], schema=_FOUND)

    return blobs.groupBy("bucket").applyInArrow(judge, FOUND)


CONTEXT = "anchor bigint, ord bigint, tie bigint, start bigint, place int, content binary"
_CONTEXT = pa.schema([("anchor", pa.int64()), ("ord", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("place", pa.int32()), ("content", pa.binary())])


def contexts(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """The bytes of the edge runs."""
    asked = edges.groupBy("ord", "tie").agg(F.collect_list(F.struct("anchor", "start", "end", "place")).alias("runs"))
    joined = texts.select("ord", "tie", "text").join(asked, ["ord", "tie"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _CONTEXT]
            for place, tie, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = text.encode()
                for r in own:
                    for column, value in zip(out, (r["anchor"], place, tie, r["start"], r["place"], content[r["start"] : r["end"]]), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _CONTEXT, strict=True)], schema=_CONTEXT)

    return joined.mapInArrow(cut, CONTEXT)


def suffix_ranks(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 8, 16, 32 and 64 bytes, by doubling; places past the end compare lowest."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(text)]
    levels, width = [], 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        levels.append(rank)
        if width == 64:
            return levels
        behind = np.zeros(len(text), np.int64)
        behind[:-width] = rank[width:] if len(text) > width else behind[:-width]
        key = rank.astype(np.uint64) * np.uint64(len(text) + 1) + behind.astype(np.uint64)
        width *= 2


def previous_factor(text: np.ndarray, starts: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Longest previous factor of each start (cut at ``most``, at most 128): the longest prefix that also starts at an earlier one.

    Starts are sorted by their first 128 bytes. The nearest places before and behind in that order that are
    smaller are found by jumping along candidates, all starts at once.
    """
    levels = suffix_ranks(text)
    longest = levels[-1]
    far = np.zeros(len(text) + 64, np.int64)
    far[: len(text)] = longest
    order = starts[np.lexsort((starts, far[starts + 64], longest[starts]))]
    best = np.zeros(len(order), np.int64)
    n = len(order)
    for step in (-1, 1):
        near = np.arange(n) + step
        while True:
            open_ = (near >= 0) & (near < n)
            wrong = np.nonzero(open_ & (order[np.where(open_, near, 0)] > order))[0]
            if not len(wrong):
                break
            near[wrong] = near[near[wrong]]
        here = np.nonzero((near >= 0) & (near < n))[0]
        best[here] = np.maximum(best[here], _common(text, levels, order[here], order[near[here]], most))
    out = np.zeros(len(starts), np.int64)
    out[np.searchsorted(starts, order)] = best
    return out


def _common(text: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of two places, cut at ``most``."""
    got, n = np.zeros(len(a), np.int64), len(text)
    for width, rank in zip((64, 32, 16, 8), levels[::-1], strict=True):
        x, y = a + got, b + got
        fits = (x + width <= n) & (y + width <= n)
        same = fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        got += width * same
    for _ in range(8):
        x, y = a + got, b + got
        fits = (x < n) & (y < n)
        got += (fits & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])) & (got < most)
    return np.minimum(got, most)


SPAN = "ord bigint, tie bigint, start bigint, end bigint"
_SPAN = pa.schema([("ord", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of the strings in contexts ``(anchor, ord, tie, start, place, content)`` that some earlier context holds."""
    rows = _sharing(sorted(set(rows), key=lambda r: (r[1], r[2], r[3])))
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=_SPAN)
    sizes = np.array([len(r[5]) for r in rows])
    firsts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    starts = np.concatenate([np.arange(f, f + s - LENGTH + 1) for f, s in zip(firsts, sizes, strict=True)])
    copied = starts[previous_factor(text, starts) >= LENGTH]
    owner = np.searchsorted(firsts, copied, side="right") - 1
    new = np.ones(len(copied), bool)
    new[1:] = (copied[1:] != copied[:-1] + 1) | (owner[1:] != owner[:-1])
    at = np.nonzero(new)[0]
    last = np.append(at[1:], len(copied)) - 1
    of = owner[at]
    base = np.array([r[3] for r in rows])[of] - firsts[of]
    columns = [np.array([r[k] for r in rows], np.int64)[of] for k in (1, 2)] + [copied[at] + base, copied[last] + base + LENGTH]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_SPAN)


def _sharing(rows: list[tuple]) -> list[tuple]:
    """Contexts that share their anchor's bytes and another 34 before or behind with a second one: all others can hold no common string."""
    more = LENGTH - GRAM >> 1
    seen: dict[tuple, int] = {}
    keys = []
    for anchor, _, _, _, place, content in rows:
        own = [(anchor, 1, content[place : place + GRAM + more])]
        if place >= more:
            own.append((anchor, 0, content[place - more : place + GRAM]))
        for key in own:
            seen[key] = seen.get(key, 0) + 1
        keys.append(own)
    return [r for r, own in zip(rows, keys, strict=True) if any(seen[k] > 1 for k in own)]


def edge_spans(found: DataFrame) -> DataFrame:
    """Copied spans inside edge contexts, anchors kept whole and sorted together in bounded portions."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED_BYTES and row[0] != last:
                    yield _spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield _spans(held)

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, SPAN)


def hot_spans(found: DataFrame) -> DataFrame:
    """The same for anchors with too many contexts for one task: their strings, grouped by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), *_SPAN][:4])
        for batch in batches:
            out: list[tuple] = []
            for _, place, tie, start, _, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(hashlib.md5(content[k : k + LENGTH]).digest(), place, tie, start + k) for k in range(len(content) - LENGTH + 1)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    rows = found.mapInArrow(strings, "key binary, ord bigint, tie bigint, start bigint")
    where = F.struct("ord", "tie", "start")
    first = rows.groupBy("key").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last")
    later = rows.join(first, "key").where(where != F.col("first"))
    return later.select("ord", "tie", "start", (F.col("start") + LENGTH).alias("end"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_bytes(content: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``content``, and the number of maximal removed runs."""
    if not spans:
        return content, 0
    start, end = merged(*(np.array(c, np.int64) for c in zip(*spans, strict=True)))
    edges = [0, *np.column_stack([start, end]).reshape(-1).tolist(), len(content)]
    return b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(start)


def earlier_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ord, tie, start, end``: byte spans to remove, by place of the document in the corpus."""
    texts = ordered_texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialize(copies_and_edges(bucketed_runs(texts, max(1, -(-total // BUCKET_BYTES)))), "runs")
    edges = materialize(contexts(texts, found.where("anchor IS NOT NULL")), "contexts")
    hot = materialize(edges.groupBy("anchor").count().where(F.col("count") > HOT_RUNS).select("anchor"), "hot")
    spans = found.where("anchor IS NULL").select("ord", "tie", "start", "end")
    cold = edge_spans(edges.join(hot, "anchor", "left_anti"))
    return spans.unionByName(cold).unionByName(hot_spans(edges.join(hot, "anchor", "left_semi")))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, removed bytes and runs, and the digest of the remaining bytes of each document."""
    spans = materialize(earlier_copies(docs, id_col, text_col), "spans")
    each = spans.groupBy("ord", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = ordered_texts(docs, id_col, text_col).join(each, ["ord", "tie"], "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = text.encode()
                kept, n = cut_bytes(content, [(s["start"], s["end"]) for s in own or ()])
                out.append((doc_id, len(content), len(content) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return joined.mapInArrow(remove, RESULT)
