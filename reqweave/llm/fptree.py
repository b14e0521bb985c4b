"""Ranked lexical search over a tree of documents that shares their frequent terms.

One pass cuts every text into terms and keeps, per document, its length and the frequencies of those terms that
some item asks for (a restricted vector). Counts over all documents give weights and length norms. A second pass
builds trees over groups of documents: their terms stand in order of document frequency, so paths begin with what
many documents share. Every node knows the largest frequency of each term and the smallest norm ``m`` below it;
both bound the score of all its documents. Each item then descends depth first, best child first, and leaves out
what cannot reach its list of best documents. The lists of all groups are merged by rank.

Edge cases: a null or empty text has no term and is never found; an item without terms gets no rows. Items are told
apart by row, so repeated ids get a ranking each. Repeated documents are ranked as often as they occur, next to each
other; a null document id comes last among equal scores. Empty tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqweave.llm.common import texts_of
from reqweave.storage import materialize

TOP = 20
#: Items that are searched together; more are searched in blocks, each with its own pass over the restricted vectors.
ITEMS = 512
#: Cells (documents times terms) of one tree at most, and documents of a leaf.
TREE_CELLS, LEAF = 8 << 20, 32
#: Parts of the length norm m = NORM - SLOPE + SLOPE * n / mean length, and of the term score.
NORM, SLOPE, SATURATION, UNIT = 100, 25, 12, 1_000_000_000
#: Place of a document without an id among equal scores.
LAST = np.iinfo(np.int64).max

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Items:
    """A block of items: terms by number, and for each item its terms with how often it asks for them."""

    keys: list[int]
    words: dict[bytes, int]
    asks: list[tuple[np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[tuple[list, Items]]:
    """Blocks of ``size`` items with their ids, read one after the other; an item's key is its place."""
    rows, key = [], 0
    texts = texts_of(items, id_col, text_col).orderBy("doc_id", "text")
    for row in texts.toLocalIterator():
        found = Counter(terms_of(row["text"]))
        if found:
            rows.append((key, row["doc_id"], found))
            key += 1
        if len(rows) == size:
            yield _block(rows)
            rows = []
    if rows:
        yield _block(rows)


def _block(rows: list) -> tuple[list, Items]:
    words = {w: k for k, w in enumerate(sorted(set().union(*(r[2] for r in rows))))}
    asks = [(np.array([words[w] for w in found], np.int64), np.array(list(found.values()), np.int64)) for _, _, found in rows]
    return [(k, i) for k, i, _ in rows], Items([k for k, _, _ in rows], words, asks)


def restricted(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` per document: its length, and number and frequency of the terms that are asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(items.words)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                own = Counter(map(known.get, found))
                own.pop(None, None)
                ns.append(len(found))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, schema.field(2).type), pa.array(tfs, schema.field(3).type)], schema=schema)

    return texts_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """Documents of one group, ordered by their terms from frequent to rare, and the nodes above them.

    Nodes are numbered as a depth-first walk meets them. ``span`` holds the documents of a node and ``children``
    the nodes next below; a node without children is a leaf. ``peak`` and ``floor`` are its bounds.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, place: np.ndarray):
        width, owner = len(place), np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((place[terms], owner))
        ranks, kind = place[terms][order], ">u4"
        paths = [ranks[a:b].astype(kind).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        walk = sorted(range(len(ids)), key=paths.__getitem__)
        self.paths = [np.frombuffer(paths[k], kind) for k in walk]
        row = np.empty(len(ids), np.int64)
        row[walk] = np.arange(len(ids))
        self.tf = np.zeros((len(ids), width), np.int32)
        self.tf[row[owner], terms] = tfs
        self.ids, self.m = ids[walk], m[walk]
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow()
        self.peak = np.zeros((len(self.span), width), np.int32)
        self.floor, self.first = np.zeros(len(self.span), np.int64), np.zeros(len(self.span), np.int64)
        for node in reversed(range(len(self.span))):  # children come after their parent
            a, b = self.span[node]
            below = self.children[node]
            self.peak[node] = self.peak[below].max(axis=0) if below else self.tf[a:b].max(axis=0)
            self.floor[node], self.first[node] = self.m[a:b].min(), self.ids[a:b].min()

    def _grow(self) -> None:
        todo = [(0, len(self.paths), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.span)
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > LEAF:
                todo += [(x, y, node) for x, y in reversed(self._parts(a, b))]

    def _parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Stretches of documents that go on with the same term after their common path; small neighbours stay together."""
        one, two = self.paths[a], self.paths[b - 1]
        least = min(len(one), len(two))
        apart = np.nonzero(one[:least] != two[:least])[0]
        depth = int(apart[0]) if len(apart) else least
        steps = np.array([int(p[depth]) if len(p) > depth else -1 for p in self.paths[a:b]])
        edges = [a, *(a + 1 + np.nonzero(np.diff(steps))[0]).tolist(), b]
        if len(edges) == 2:  # equal paths
            edges = [*range(a, b, LEAF), b]
        parts, start = [], a
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - start > LEAF and x > start:
                parts.append((start, x))
                start = x
        return [*parts, (start, b)]

    def search(self, asked: np.ndarray, gain: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The ``top`` best of ``best`` and this tree's documents: (-score, id) in rising order."""

        def scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
            many = tf.astype(np.int64)
            return ((UNIT * many) // (1000 * many + SATURATION * m[:, None]) * gain).sum(axis=1)

        bounds = scores(self.peak[:, asked], self.floor)
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] <= 0 or (len(best) == top and (-int(bounds[node]), int(self.first[node])) > best[-1]):
                continue
            below = self.children[node]
            if below:
                todo += sorted(below, key=lambda c: (bounds[c], -self.first[c]))
                continue
            a, b = self.span[node]
            found = scores(self.tf[a:b, asked], self.m[a:b])
            here = [(-s, i) for s, i in zip(found.tolist(), self.ids[a:b].tolist(), strict=True) if s > 0]
            best = sorted(best + here)[:top]
        return best


def trees(batches: Iterator[pa.RecordBatch], place: np.ndarray, n_docs: int, length: int) -> Iterator[Tree]:
    """Trees over the restricted vectors of a task, each of a bounded number of cells."""
    most = max(LEAF, TREE_CELLS // max(1, len(place)))
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            piece = batch.slice(start, most)
            if held and sum(b.num_rows for b in held) + piece.num_rows > most:
                yield _tree(held, place, n_docs, length)
                held = []
            held.append(piece)
    if held:
        yield _tree(held, place, n_docs, length)


def _tree(held: list[pa.RecordBatch], place: np.ndarray, n_docs: int, length: int) -> Tree:
    rows = pa.Table.from_batches(held).combine_chunks()
    ids = rows["doc_id"].fill_null(LAST).to_numpy()
    lists = rows["terms"].combine_chunks() if isinstance(rows["terms"], pa.ChunkedArray) else rows["terms"]
    counts = np.array([len(x) for x in lists])
    m = NORM - SLOPE + SLOPE * rows["n"].to_numpy() * n_docs // length
    flat = lambda name: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows[name].chunks])
    return Tree(ids, m, np.concatenate([[0], np.cumsum(counts)]), flat("terms").astype(np.int64), flat("tfs"), place)


def weights(found: list, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each term, and its place in the order of document frequency (most frequent first)."""
    df = np.zeros(width, np.int64)
    for term, count in found:
        df[term] = count
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    place = np.empty(width, np.int64)
    place[np.lexsort((np.arange(width), -df))] = np.arange(width)
    return weight, place


def _search_block(docs: DataFrame, names: list, items: Items, top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vectors = materialize(restricted(docs, items, id_col, text_col).where("n > 0"), "restricted")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight, place = weights([tuple(r) for r in counted.collect()], n_docs, len(items.words))
    shared = spark.sparkContext.broadcast((items, weight, place))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, place = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items.keys]
        for tree in trees(batches, place, n_docs, length):
            for k, (asked, times) in enumerate(items.asks):
                best[k] = tree.search(asked, weight[asked] * times, best[k], top)
        out = [(key, None if i == LAST else i, -s) for key, found in zip(items.keys, best, strict=True) for s, i in found]
        yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=schema)

    found = vectors.where(F.size("terms") > 0).mapInArrow(search, "key long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = spark.createDataFrame(names, "key long, item_id long")
    return ranked.join(named, "key").select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above zero for each item."""
    out = None
    for names, block in item_blocks(items, item_col, item_text_col, ITEMS):
        found = _search_block(docs, names, block, top, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
