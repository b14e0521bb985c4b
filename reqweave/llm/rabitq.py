"""Near-duplicate embeddings by binary codes of randomly rotated residuals.

Vectors of one label (and one length) are compared. Equal vectors form one class. Labels with
many classes are cut into cells around centroids, which are vectors of a bounded sample. Two vectors
of cosine ``THRESHOLD`` are unit vectors at most ``REACH`` apart, so a vector also visits every other
cell whose bisecting plane with its own cell is no farther away than that: no pair is lost.

In its cell a class stores the signs of its randomly rotated residual to the centroid, the
residual's length and the code's inner product with it. These give an unbiased estimate of
the inner product with any other vector of the cell, and a bound that the true value stays under with
``SIGMAS`` standard deviations. Only pairs whose bound reaches the threshold are computed exactly, in
double precision. Big cells are compared in tiles of at most ``BLOCK`` by ``BLOCK`` rows. A tile gives per
row the number of links and one link to the smallest row of its group there, never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, link with nothing. Vectors of different length do not link. Equal vectors link
with each other; repeated rows are vectors of their own. Null ids take part; a component with no
other ids has a null id. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqweave.llm.components import components
from reqweave.storage import materialize

THRESHOLD = 0.98
REACH = float(np.sqrt(2 - 2 * THRESHOLD)) + 1e-9
SIGMAS = 5.0
BLOCK = 1024
#: Classes per cell aimed at, centroids in all at most, sampled vectors per centroid, least distance of centroids.
CELL_ROWS, MAX_CENTROIDS, SAMPLED, APART = 1024, 1024, 4, 0.6


@functools.cache
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(packed signs, lengths, correction)`` of residuals: correction is the code's inner product with the unit residual."""
    dim = residuals.shape[1]
    lengths = np.linalg.norm(residuals, axis=1)
    turned = residuals @ rotation(dim) / np.where(lengths > 0, lengths, 1)[:, None]
    correction = np.where(lengths > 0, np.abs(turned).sum(axis=1) / np.sqrt(dim), 1.0)
    return np.packbits(turned > 0, axis=1), lengths, correction


def upper_cosines(codes: np.ndarray, lengths: np.ndarray, correction: np.ndarray, centroid: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine, and its upper bound, of unit ``queries`` (rows) with the coded unit vectors (columns)."""
    dim = queries.shape[1]
    residuals = queries - centroid
    own = np.linalg.norm(residuals, axis=1)
    turned = residuals @ rotation(dim) / np.where(own > 0, own, 1)[:, None]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = (turned.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(dim) / correction
    error = SIGMAS * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(dim - 1) if dim > 1 else np.full(len(lengths), 2.0)
    base = own[:, None] ** 2 + lengths**2
    cosine = lambda part: 1 - (base - 2 * own[:, None] * lengths * part) / 2
    return cosine(inner), cosine(np.minimum(1.0, inner + error)) + 1e-5


def tile_links(queries: np.ndarray, targets: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the likely pairs (query, target), those whose cosine in double precision reaches the threshold."""
    i, j = np.nonzero(likely)
    keep = []
    norms_q, norms_t = np.linalg.norm(queries, axis=1), np.linalg.norm(targets, axis=1)
    for part in range(0, len(i), 200_000):
        a, b = i[part : part + 200_000], j[part : part + 200_000]
        keep.append(np.einsum("ij,ij->i", queries[a], targets[b]) / (norms_q[a] * norms_t[b]) >= THRESHOLD)
    kept = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[kept], j[kept]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's group under the links ``a``-``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_VECTOR = [("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("key1", pa.int64()), ("key2", pa.int64()), ("vector", pa.binary())]
VECTOR = "row bigint, vec_id bigint, label string, dim int, key1 bigint, key2 bigint, vector binary"


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows with their vector as doubles; ``dim`` 0 marks a vector that links with nothing."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & ~F.exists("v", lambda x: x.isNull()), F.col("v")))
    schema = pa.schema(_VECTOR)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for k in range(batch.num_rows):
                item = batch.column(2)[k]
                v = item.values.to_numpy(zero_copy_only=False).astype("<f8") if item.is_valid else np.zeros(0)
                with np.errstate(over="ignore"):
                    good = len(v) and np.isfinite(v).all() and 0 < float(v @ v) < np.inf
                content = (v + 0.0).tobytes() if good else b""
                for column, value in zip(out, (len(v) if good else 0, xxhash.xxh64_intdigest(content) - 2**63, xxhash.xxh64_intdigest(content, 1) - 2**63, content), strict=True):
                    column.append(value)
            columns = [list(range(row, row + batch.num_rows)), batch.column(0), batch.column(1), *out]
            row += batch.num_rows
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(read, VECTOR)


def unit(content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(content), "<f8").reshape(len(content), -1)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def centroids(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of the labels with more than ``CELL_ROWS`` classes, largest labels first, from a bounded sample."""
    counts = classes.groupBy("label", "dim").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "label", "dim").limit(MAX_CENTROIDS // 2).collect()
    total = sum(r["count"] for r in counts)
    share = {(r["label"], r["dim"]): max(2, min(-(-r["count"] // CELL_ROWS), MAX_CENTROIDS * r["count"] // total)) for r in counts}
    if not share:
        return {}
    wanted = classes.sparkSession.createDataFrame([(label, dim, SAMPLED * k) for (label, dim), k in share.items()], "label string, dim int, most int")
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("row"))
    most = SAMPLED * max(share.values())
    picked = classes.join(wanted, ["label", "dim"]).withColumn("r", F.row_number().over(order)).where(f"r <= {most}").where("r <= most")
    sampled: dict[tuple[str, int], list[bytes]] = {}
    for r in picked.orderBy("label", "dim", "r").select("label", "dim", "vector").collect():
        sampled.setdefault((r["label"], r["dim"]), []).append(bytes(r["vector"]))
    out = {}
    for key, content in sampled.items():
        _, units = unit(content)
        chosen = [units[0]]
        for u in units[1:]:  # centroids inside one tight cluster would only copy it to each other's cells
            if len(chosen) < share[key] and np.linalg.norm(np.array(chosen) - u, axis=1).min() >= APART:
                chosen.append(u)
        if len(chosen) > 1:
            out[key] = np.array(chosen)
    return out


PLACED = "label string, dim int, cell int, target boolean, visitor boolean, row bigint, copies bigint, vector binary, code binary, length double, correction double"


def in_cells(classes: DataFrame, centres: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """Each class coded in its own cell, and as a query there and in every later cell within reach."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema(
        [("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("target", pa.bool_()), ("visitor", pa.bool_()), ("row", pa.int64()), ("copies", pa.int64())]
        + [("vector", pa.binary()), ("code", pa.binary()), ("length", pa.float64()), ("correction", pa.float64())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            groups: dict[tuple[str, int], list] = {}
            for r in rows:
                groups.setdefault((r[0], r[1]), []).append(r)
            out: list[tuple] = []
            for key, own in groups.items():
                _, units = unit([r[4] for r in own])
                centre = shared.value.get(key, np.zeros((1, key[1])))
                far = ((units[:, None, :] - centre[None]) ** 2).sum(axis=2) if len(centre) < 16 else np.maximum(0, (units**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1) - 2 * units @ centre.T)
                home = far.argmin(axis=1)
                code, length, correction = encode(units - centre[home])
                gaps = np.linalg.norm(centre[:, None] - centre[None], axis=2)[home]
                near = (far - far[np.arange(len(own)), home][:, None]) <= 2 * gaps * REACH + 1e-9
                near &= np.arange(len(centre))[None] >= home[:, None]
                for k, r in enumerate(own):
                    out.append((*key, int(home[k]), True, False, r[2], r[3], r[4], code[k].tobytes(), float(length[k]), float(correction[k])))
                    out += [(*key, int(c), False, bool(c != home[k]), r[2], r[3], r[4], None, None, None) for c in np.nonzero(near[k])[0]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return classes.select("label", "dim", "row", "copies", "vector").mapInArrow(place, PLACED)


def tiled(placed: DataFrame) -> DataFrame:
    """Rows of each cell dealt over tiles (query block, target block)."""
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(side) / BLOCK)).cast("int").alias(name) for side, name in ((F.col("target"), "nt"), (~F.col("target"), "nq"))])
    sizes = materialize(sizes, "cells")
    sized = placed.join(sizes, cell)
    mine = F.pmod(F.xxhash64("row"), F.when(F.col("target"), F.col("nt")).otherwise(F.col("nq"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("target"), F.col("nq")).otherwise(F.col("nt")) - 1))
    dealt = sized.withColumn("mine", mine).withColumn("other", others)
    q, t = F.when(F.col("target"), F.col("other")).otherwise(F.col("mine")), F.when(F.col("target"), F.col("mine")).otherwise(F.col("other"))
    return dealt.withColumn("q", q).withColumn("t", t).drop("mine", "other", "nt", "nq")


FOUND = "row bigint, links bigint, root bigint"


def linked(placed: DataFrame, centres: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """Per tile and row: number of linked vectors and the smallest row of its group."""
    shared = placed.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(key: tuple, tile: pa.Table) -> pa.Table:
        label, dim, cell = (k.as_py() for k in key[:3])
        centre = shared.value.get((label, dim), np.zeros((1, dim)))[cell]
        mask = tile.column("target").combine_chunks()
        sides = [tile.filter(mask), tile.filter(pa.array(~np.array(mask.to_pylist(), bool)))]
        if not sides[0].num_rows or not sides[1].num_rows:
            return schema.empty_table()
        (t, t_unit), (q, q_unit) = (unit(s.column("vector").to_pylist()) for s in sides)
        t_row, q_row = (s.column("row").to_numpy() for s in sides)
        t_copies, q_copies = (s.column("copies").to_numpy() for s in sides)
        codes = np.frombuffer(b"".join(sides[0].column("code").to_pylist()), np.uint8).reshape(len(t_row), -1)
        _, upper = upper_cosines(codes, sides[0].column("length").to_numpy(), sides[0].column("correction").to_numpy(), centre, q_unit)
        likely = upper >= THRESHOLD
        visitor = np.array(sides[1].column("visitor").to_pylist(), bool)
        likely &= visitor[:, None] | (q_row[:, None] < t_row[None])  # in its own cell a pair meets twice
        return links_of(q, t, likely, q_row, t_row, q_copies, t_copies, schema)

    return placed.groupBy("label", "dim", "cell", "q", "t").applyInArrow(compare, FOUND)


def links_of(q, t, likely, q_row, t_row, q_copies, t_copies, schema: pa.Schema) -> pa.Table:
    i, j = tile_links(q, t, likely)
    nodes, places = np.unique(np.concatenate([q_row[i], t_row[j]]), return_inverse=True)
    a, b = places[: len(i)], places[len(i) :]
    counts = np.bincount(a, t_copies[j], len(nodes)) + np.bincount(b, q_copies[i], len(nodes))
    return pa.table([pa.array(nodes, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(nodes[roots(a, b, len(nodes))] if len(nodes) else nodes, pa.int64())], schema=schema)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector."""
    rows = materialize(vectors(df, id_col, vector_col, label_col), "vectors")
    key = ["label", "dim", "key1", "key2"]
    classes = rows.where("dim > 0").groupBy(*key).agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = materialize(classes, "classes")
    full = materialize(rows.where("dim > 0").select("row", "label", "dim", "vector").join(classes.select("row", "copies"), "row"), "representatives")
    centres = centroids(full)
    found = materialize(linked(tiled(materialize(in_cells(full, centres), "placed")), centres), "tiles")
    groups = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    named = classes.join(links, "row", "left").join(groups.withColumnRenamed("node", "row"), "row", "left")
    named = named.withColumn("component", F.coalesce("component", "row"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(least, "component").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id"), "named")
    out = rows.select("vec_id", *key).join(named, key, "left")
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
