"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and components.

A document's set holds the 64-bit hashes of its distinct shingles of ``SHINGLE`` words. The
signature takes, per slot, the least (step, rank) over all elements, where an element visits the
slots in the order of a random permutation of its own; a document stops as soon as no later
step can lower a slot. All elements of many documents take a step together.

Documents with equal sets form one class; everything after works on classes. Candidates:

1. Every class is paired with the smallest classes of its buckets, ``FIRST_PIVOTS`` of them at most. Pairs
   whose signatures and sizes allow the similarity are verified on the full sets, and
   the links joined into components.
2. Buckets whose members fell into one component are done. While the others are large, members outside a
   bucket's largest component are verified with drawn members of it, turn by turn, and components join.
3. In the buckets that are left, members outside the largest component are paired with every member of another
   component, if the signatures allow it, and verified. So a group of n near copies costs n pairs a turn and not n*n,
   and no link between two components is left out.

At similarity 0.75 a pair shares none of the ``BANDS`` buckets with probability 2e-5, and misses the signature
test, ``SIGMAS`` standard errors of the estimate wide, with 3e-5. Links are decided on full sets alone (elements cut to 48 bits).

Edge cases: a text of fewer words than a shingle has its whole word sequence as its only
element; null, empty and wordless texts have the empty set, link with nothing and are kept.
Rows with equal ids share ``kept`` in the report; null ids take part, and a component with no other
ids has a null id and keeps its rows. ``first_of_groups`` decides by row and keeps one row of each group. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.common import only, remembers, texts_of
from reqweave.llm.components import components
from reqweave.storage import materialize

SHINGLE = 5
#: Links have 100 * shared >= PERCENT * joint.
PERCENT = 75
SLOTS, BANDS, ROWS = 384, 40, 5
WORDS = -(-SLOTS // 7)
#: Standard errors by which the estimate of a verified pair may fall short.
SIGMAS = 4.0
#: Smallest classes that a class is paired with at first; what that leaves apart in a bucket is paired in the second step.
FIRST_PIVOTS = 6
#: Turns of drawn pairs at most, and the others per member of a bucket from which a turn is worth it.
MOST_TURNS, FEW_OTHERS = 8, 8
#: Representatives that are sent to every task instead of shuffling all texts; beyond it texts and ids are both shuffled.
BROADCAST_ROWS = 500_000
#: Elements that take their steps together: bounds the permutations held (2 bytes a slot each).
TOGETHER = 20_000

#: Bytes of a text that are hashed at once.
PART_BYTES = 1 << 18
_SPACES = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@functools.cache
def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """Hash of each byte with A-Z lowered, and which bytes part words."""
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    return mix((codes + np.uint64(1)) * _A), space


@functools.lru_cache(maxsize=2)
def _kept_powers(base: int) -> np.ndarray:
    return _powers(PART_BYTES + 1, base)


remembers("shingles", _kept_powers.cache_clear)


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _word_parts(raw: bytes) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about ``PART_BYTES`` that end between words; a longer word stays whole."""
    at = 0
    while at < len(raw):
        stop = at + PART_BYTES
        if stop < len(raw):
            cut = max(raw.rfind(c, at, stop) for c in _SPACES)
            if cut <= at:
                ends = [e for c in _SPACES if (e := raw.find(c, stop)) >= 0]
                cut = min(ends, default=len(raw))
            stop = cut
        yield np.frombuffer(raw, np.uint8, min(stop, len(raw)) - at, at)
        at = stop


def word_hashes(text: str) -> np.ndarray:
    """Hashes of all words in order; long texts are read part by part."""
    table, space = _bytes_table()
    found = []
    for part in _word_parts(text.encode()):
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~space[part]
        edges = np.diff(inside)
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        powers = _kept_powers if len(part) <= PART_BYTES else functools.partial(_powers, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers(_BASE)[: len(part)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * powers(_INVERSE)[starts] + (ends - starts).astype(np.uint64) * _A))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(words), SHINGLE)), np.uint64)
    for j in range(min(SHINGLE, len(words))):
        out *= np.uint64(_BASE)
        out += words[j : j + n]
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SLOTS`` values (step, rank) per set; sets must not be empty."""
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(sets):
        stop, held = start + 1, len(sets[start])
        while stop < len(sets) and held + len(sets[stop]) <= TOGETHER:
            held += len(sets[stop])
            stop += 1
        if held <= TOGETHER:
            _steps(sets[start:stop], out[start:stop])
        else:  # one long document: parts of its set, the least of each slot
            for part in np.array_split(sets[start], -(-held // TOGETHER)):
                one = np.full((1, SLOTS), np.iinfo(np.uint64).max, np.uint64)
                _steps([part], one)
                np.minimum(out[start], one[0], out=out[start])
        start = stop
    return out


def _steps(sets: list[np.ndarray], out: np.ndarray) -> None:
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(SLOTS, dtype=np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    flat = out.reshape(-1)
    for step in range(SLOTS):
        drawn = mix(elements + np.uint64((step + 1) * int(_A) % (1 << 64)))
        swap = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - step) >> np.uint64(32)).astype(np.int64)
        slot = order[rows, swap]
        order[rows, swap] = order[rows, step]
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(step << 32) | (drawn >> np.uint64(32)))
        done = out.max(axis=1) < np.uint64((step + 1) << 32)
        if done.any():
            going = ~done[owner]
            if not going.any():
                return
            elements, owner, rows = elements[going], owner[going], rows[going]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and set."""
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for row in range(ROWS):
        keys = mix(keys * _A + signature[:, row : BANDS * ROWS : ROWS])
    return keys.astype(np.int64)


def codes(signature: np.ndarray) -> np.ndarray:
    """Eight bits per slot, seven slots a word; the highest byte stays empty, so sums of bytes fit."""
    padded = np.zeros((len(signature), WORDS * 7), np.uint64)
    padded[:, :SLOTS] = mix(signature) & np.uint64(255)
    small = padded.reshape(len(signature), WORDS, 7)
    return (small << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64).astype(np.int64)


SETS = "row bigint, doc_id bigint, n bigint, key1 bigint, key2 bigint, bands array<bigint>, codes array<bigint>"
_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64())]
    + [("bands", pa.list_(pa.int64())), ("codes", pa.list_(pa.int64()))]
)


def six_bytes(elements: np.ndarray) -> bytes:
    """Sorted elements cut to 48 bits; mixed hashes keep their order under the cut."""
    return (elements >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(content, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, class key, band keys and signature codes of every document's set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [shingles(text) for text in batch.column(1).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            signature = signatures([sets[k] for k in full])
            bands: list = [None] * len(sets)
            code: list = [None] * len(sets)
            for k, b, c in zip(full, band_keys(signature), codes(signature), strict=True):
                bands[k], code[k] = b, c
            keys = [[int(f(mix(s * m)).astype(np.int64)) for s in sets] for f, m in ((np.add.reduce, _A), (np.bitwise_xor.reduce, _B))]
            columns = [list(range(row, row + len(sets))), batch.column(0), [len(s) for s in sets], *keys, bands, code]
            row += len(sets)
            yield pa.record_batch([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return texts_of(docs, id_col, text_col).mapInArrow(describe, SETS)


def agreement(one: str, two: str) -> F.Column:
    """Estimated similarity from two arrays of codes."""
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)

    def unequal(a: F.Column, b: F.Column) -> F.Column:
        """Bytes that differ: the top bit of each byte of the difference that is not zero."""
        x = a.bitwiseXOR(b)
        return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))

    differing = F.aggregate(F.zip_with(one, two, unequal), F.lit(0), lambda total, n: total + n)
    return ((SLOTS - differing) / F.lit(float(SLOTS)) - 1 / 256) / (255 / 256)


def variance_factor(joint: int, slots: int = SLOTS) -> float:
    """Variance of the estimate relative to independent hashes, for ``joint`` elements in both sets together."""
    l = np.arange(1, slots, dtype=float)  # noqa: E741
    log = lambda x: joint * np.log(np.maximum(x, 1e-300))
    scale = (joint - 1) * math.log(slots - 1) + joint * math.log(slots) + math.log(joint - 1)
    terms = np.exp(log(l) + log(l + 1) - scale) + np.where(l > 1, np.exp(log(l) + log(l - 1) - scale), 0) - 2 * np.exp(2 * log(l) - scale)
    return 1 - float(terms.sum())


def least_estimate(n_one: str, n_two: str) -> F.Column:
    """Estimate from which a pair is verified: the smaller the sets, the better the estimate. Sizes count up to a power of two."""
    p, joint = PERCENT / 100, F.col(n_one) + F.col(n_two)
    margin = lambda factor: SIGMAS * math.sqrt(p * (1 - p) / SLOTS * factor)
    out = F.when(joint <= 16, p - margin(variance_factor(16)))
    for k in range(5, 14):
        out = out.when(joint <= 1 << k, p - margin(variance_factor(1 << k)))
    return out.otherwise(p - margin(1))


def likely(one: str = "codes_a", two: str = "codes_b", n_one: str = "n_a", n_two: str = "n_b") -> F.Column:
    small, large = F.least(n_one, n_two), F.greatest(n_one, n_two)
    return (small * 100 >= large * PERCENT) & (agreement(one, two) >= least_estimate(n_one, n_two))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are links, decided on their full sets."""
    side = lambda name: sets.select(F.col("row").alias(name), F.col("elements").alias(f"elements_{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "elements_a", "elements_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = from_six_bytes(one.as_py()), from_six_bytes(two.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], schema=schema)

    return joined.mapInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document."""
    described = materialize(document_sets(docs, id_col, text_col), "sets")
    key = ["n", "key1", "key2"]
    classes = materialize(described.groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id")), "classes")
    reps = described.where("n > 0").join(classes.select("rep"), F.col("row") == F.col("rep"), "left_semi")
    reps = materialize(reps.select("row", "doc_id", "n", "bands", "codes"), "representatives")
    members = reps.select(F.explode("bands").alias("bucket"), "row")
    pivots = members.groupBy("bucket").agg(F.min("row").alias("a"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(members.join(pivots.select("bucket", "a"), "bucket").select("bucket", "row", "a"), "buckets")

    side = lambda name: reps.select(F.col("row").alias(name), F.col("n").alias(f"n_{name}"), F.col("codes").alias(f"codes_{name}"))
    pivots = F.slice(F.sort_array(F.collect_set("a")), 1, FIRST_PIVOTS)
    stars = shared.where("row <> a").groupBy(F.col("row").alias("b")).agg(pivots.alias("pivots"))
    stars = stars.select(F.explode("pivots").alias("a"), "b")
    stars = materialize(stars.join(side("a"), "a").join(side("b"), "b").where(likely()).select("a", "b"), "pairs")
    texts = materialize(class_texts(docs, described, stars.select(F.explode(F.array("a", "b")).alias("row")).distinct(), id_col, text_col), "elements")
    first = materialize(verified(stars, texts), "verified")

    tried, links, found = stars, first, components(first)
    inside, held, pairs_before = mixed_buckets(shared.select("bucket", "row"), found), None, math.inf
    for turn in range(1, MOST_TURNS + 1):
        # what the rest would cost: a turn is worth it if members have many others to be compared with, and while turns help
        members, pairs = inside.select(F.count("*"), F.coalesce(F.sum("others"), F.lit(0))).first()
        if pairs <= FEW_OTHERS * members or pairs > 0.9 * pairs_before:
            break
        pairs_before = pairs
        if held is None:
            held = materialize(class_texts(docs, described, inside.select("row").distinct(), id_col, text_col), "elements")
        drawn = drawn_pairs(inside, turn).join(side("a"), "a").join(side("b"), "b").where(likely()).select("a", "b")
        drawn = materialize(drawn.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialize(verified(drawn, held), "verified")
        tried, links = tried.unionByName(drawn), links.unionByName(more)
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        inside = mixed_buckets(inside.select("bucket", "row"), found)

    inside = inside.join(reps.select("row", "n", "codes", "bands"), "row")
    inside = materialize(inside.select("bucket", "row", "component", "main", "n", "codes", "bands"), "mixed")
    rename = lambda df, s: df.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("row", "component", "main", "n", "codes", "bands")])
    left, right = rename(inside.where("component <> main"), "a"), rename(inside, "b")
    # two members outside the main component meet once, and a pair in the first bucket it shares
    once = (F.col("component_b") == F.col("main_b")) | (F.col("row_a") < F.col("row_b"))
    first_bucket = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == left["bucket"]
    apart = (F.col("component_a") != F.col("component_b")) & once & first_bucket & likely()
    cross = left.join(right, (left["bucket"] == right["bucket"]) & apart).select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()
    cross = materialize(cross.join(tried, ["a", "b"], "left_anti"), "pairs")
    if held is None:
        held = materialize(class_texts(docs, described, cross.select(F.explode(F.array("a", "b")).alias("row")).distinct(), id_col, text_col), "elements")
    second = materialize(verified(cross, held), "verified")
    final = components(links.unionByName(second))

    named = with_component(classes.select(*key, "first_id", F.col("rep").alias("row")), final)
    least = named.where("n > 0").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(least, "component", "left").select(*key, "component_id"), "named")
    out = described.select("doc_id", *key).join(named, key)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """``bucket, row, component, main, others`` of the buckets whose members are in several components.

    ``main`` is the component with most members there, ``others`` how many a member outside it may have to be compared with.
    """
    placed = materialize(with_component(members, found), "placed")
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("bucket").agg(F.max_by("component", "c").alias("main"), F.sum("c").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    inside = placed.join(mixed.drop("kinds"), "bucket")
    others = F.when(F.col("component") == F.col("main"), 0).otherwise(F.col("size"))
    return materialize(inside.select("bucket", "row", "component", "main", others.alias("others")), "inside")


def drawn_pairs(inside: DataFrame, turn: int) -> DataFrame:
    """``a, b``: each row outside the main component with one drawn member of it per bucket, ``FIRST_PIVOTS`` of them at most."""
    drawn = inside.where("component = main").groupBy("bucket").agg(F.min_by("row", F.xxhash64("row", F.lit(turn))).alias("pivot"))
    met = inside.where("component <> main").join(drawn, "bucket")
    # by a hash of both, so that a row's pivots are not the smallest ones of all its buckets
    pivots = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("row", "pivot").alias("h"), "pivot"))), 1, FIRST_PIVOTS)
    chosen = met.groupBy("row").agg(pivots.alias("p")).select("row", F.explode("p.pivot").alias("pivot"))
    return chosen.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")).distinct()


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with their component; a row without links is its own."""
    return rows.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))


def class_texts(docs: DataFrame, described: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, elements`` of the wanted classes, made again from the texts of their documents.

    A row is found by id and class: ids that repeat give several texts, of which the right one has the class's key.
    """
    ids = described.join(wanted, "row", "left_semi").select("row", "doc_id", F.col("key1").alias("k1"))
    ids = materialize(ids, "wanted")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = texts_of(docs, id_col, text_col)
    found = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"])).select("row", "k1", "text")
    schema = pa.schema([("row", pa.int64()), ("elements", pa.binary())])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = shingles(text)
                if int(np.add.reduce(mix(own * _A)).astype(np.int64)) == key:
                    rows.append(row)
                    out.append(six_bytes(own))
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return found.mapInArrow(elements, "row bigint, elements binary").dropDuplicates(["row"])


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each group of near copies the one with the smallest id (null last).

    Rows are told apart by a key of their own, written with them, so that of rows with equal or null ids one stays too.
    """
    key = "_near_copy_row"
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    judged = near_duplicates(keyed, key, text_col).where("n_shingles > 0").select(F.col("doc_id").alias(key), "component_id")
    grouped = judged.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1").select("component_id")
    copies = materialize(judged.join(grouped, "component_id").join(keyed.select(key, F.col(id_col).cast("long").alias("doc_id")), key), "copies")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    first = copies.groupBy("component_id").agg(F.min(place)[key].alias(key))
    gone = materialize(copies.select(key).join(first.select(key), key, "left_anti"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
