"""Language of words and of whole texts by a linear-chain conditional random field.

Words (stretches of letters, in lower case) carry hashed features: the word itself, its
prefixes and suffixes of up to three letters, its letter 1-, 2- and 3-grams, and the lexicons of the
languages it belongs to. Transition weights are learned with them. Training sequences are
made from a bounded sample of labelled texts whose stretches follow each other as in
code-switched text; forward-backward over them gives the gradient.

Prediction runs forward-backward over every word of every text. Words stand in rows of
``CHUNK``; the transfer matrix of each row carries the state exactly from row to row, so all
rows of a batch move together and a text of any length is one chain.

Edge cases: a text that is null, empty or without letters is ``und`` with score 0. Rows
without a label, or with a null one, never train. With no labelled row at all every text is
``und``. Repeated rows get equal answers; an empty table gives an empty table; extra columns
are not read. Equal scores go to the label that sorts first.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqweave.llm.common import arrow_schema, batch_of, only, remembers
from reqweave.storage import materialize

#: Labelled texts per language that the model is fitted on at most (smallest hashes). Every language that occurs is
#: learned; a table of more languages than ``MAX_LABELS``, whose weights would not fit a task, is an error.
SAMPLE_TEXTS = 400
MAX_LABELS = 1024
#: Training sequences and their length in words.
SEQUENCES, LENGTH = 4096, 64
#: Words of the sample that a language's lexicon holds at most.
LEXICON = 2000
DIMENSIONS = 1 << 16
EPOCHS, SEQUENCES_A_STEP, RATE, DECAY = 3, 256, 0.5, 1e-5
#: One text in so many is held back to see how many trigrams of an unseen text are known; a text is familiar from
#: ``FAMILIAR`` times the share that all but ``FAMILIAR_SHARE`` of them reach.
RESERVED, FAMILIAR, FAMILIAR_SHARE = 5, 0.7, 0.02
CHUNK = 256
#: Steps after which running state probabilities are scaled anew.
SCALED = 8
#: Distinct words whose scores a worker remembers.
MEMORY_WORDS = 150_000
UNKNOWN = "und"



def _word(last: int) -> re.Pattern:
    """A letter, then letters and combining marks, of code points up to ``last``; numbers of any script are no letters."""

    def ranges(kinds: str) -> str:
        out, start = [], None
        for point in range(last + 2):
            inside = point <= last and unicodedata.category(chr(point))[0] in kinds
            if inside and start is None:
                start = point
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
                start = None
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


#: Words of texts within the first plane, where a class of letters is one table look-up, and of all others.
WORD = _word(0xFFFF)
BEYOND = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _word_of_all_planes() -> re.Pattern:
    return _word(sys.maxunicode)


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (_word_of_all_planes() if BEYOND.search(text) else WORD).findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one list, and where each word's begin."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    firsts = np.cumsum(lengths + 2) - (lengths + 2)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    place = np.arange(len(points)) - firsts[word]
    left = lengths[word] + 2 - place  # code points from here to the end mark, both included
    found, owner = [], []

    def add(salt: int, codes: np.ndarray, of: np.ndarray) -> None:
        mixed = (codes + np.uint64(salt)) * _PRIME
        found.append(((mixed ^ (mixed >> np.uint64(29))) * _PRIME) >> np.uint64(64 - DIMENSIONS.bit_length() + 1))
        owner.append(of)

    grams = points.copy()
    for size in (1, 2, 3):
        if size > 1:
            grams = grams[:-1] * np.uint64(1_000_003) + points[size - 1 :]
        here = left[: len(grams)] >= size
        add(size, grams[here], word[: len(grams)][here])
    code = np.zeros(len(words), np.uint64)
    for size in (1, 2, 3):  # prefixes
        here = lengths >= size
        code[here] = code[here] * np.uint64(1_000_003) + points[firsts[here] + size]
        add(10 + size, code[here], np.nonzero(here)[0])
    code[:] = 0
    lasts = firsts + lengths
    for size in (1, 2, 3):  # suffixes
        here = lengths >= size
        code[here] = code[here] * np.uint64(1_000_003) + points[lasts[here] - size + 1]
        add(20 + size, code[here], np.nonzero(here)[0])
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 2, 6_364_136_223_846_793_005, np.uint64))
    add(30, np.add.reduceat(points * powers[place], firsts) if len(words) else np.zeros(0, np.uint64), np.arange(len(words)))
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(words)))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of all words, their ends marked, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    codes = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    inside = np.ones(len(codes), bool)
    ends = (starts + lengths)[:-1]
    inside[ends] = inside[ends + 1] = False
    return codes[inside], np.cumsum(lengths) - lengths


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label
    lexicon: dict[str, int]  # word -> label
    trust: np.ndarray  # label: weight of a lexicon entry
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # codes of the letter trigrams of the sample, sorted
    familiar: float = 0.0  # least share of known trigrams that a text needs to be recognised
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def known_trigrams(self, words: list[str]) -> np.ndarray:
        """Per word: how many of its letter trigrams (with its ends) the sample holds, and how many it has."""
        if not words:
            return np.zeros((0, 2), np.int32)
        codes, starts = trigrams(words)
        at = np.minimum(np.searchsorted(self.grams, codes), max(0, len(self.grams) - 1))
        here = (self.grams[at] == codes).astype(np.int32) if len(self.grams) else np.zeros(len(codes), np.int32)
        return np.stack([np.add.reduceat(here, starts), np.diff(np.append(starts, len(codes)))], axis=1).astype(np.int32)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and known trigrams of running words, through the worker's memory of distinct words."""
        return _MEMORY.scores(self, words)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        ids, starts = features(words)
        out = np.add.reduceat(self.weights[ids], starts, axis=0)
        known = np.array([self.lexicon.get(w, -1) for w in words])
        here = np.nonzero(known >= 0)[0]
        out[here, known[here]] += self.trust[known[here]]
        return out


class _Memory:
    """Scores of the distinct words of one model: ``MEMORY_WORDS`` and those of one call at most.

    It belongs to the worker and not to the model, so models of earlier runs hold nothing.
    """

    def __init__(self) -> None:
        self.model, self.index, self.known, self.seen = "", {}, np.zeros((0, 0), np.float32), np.zeros((0, 2), np.int32)

    def scores(self, model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.model != model.name or len(self.index) > MEMORY_WORDS:
            self.model, self.index, self.known, self.seen = model.name, {}, np.zeros((0, len(model.labels)), np.float32), np.zeros((0, 2), np.int32)
        index, before = self.index, len(self.index)
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        new = list(islice(reversed(index), len(index) - before))[::-1]
        if new:
            if len(index) > len(self.known):
                rows = max(len(index), 2 * len(self.known))
                known, seen = np.zeros((rows, len(model.labels)), np.float32), np.zeros((rows, 2), np.int32)
                known[: len(self.known)], seen[: len(self.seen)] = self.known, self.seen
                self.known, self.seen = known, seen
            self.known[before : len(index)] = model.emissions(new)
            self.seen[before : len(index)] = model.known_trigrams(new)
        return self.known[ids], self.seen[ids]


_MEMORY = _Memory()
remembers("languages", _MEMORY.__init__)


def posteriors(scores: np.ndarray, moves: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Label probabilities of every word of chains laid end to end, by forward-backward.

    Chains are cut into rows of ``CHUNK`` words. Rows are first multiplied out side by side
    into transfer matrices, which are chained per text, then walked again from their true
    start and end states.
    """
    labels, total = scores.shape[1], len(scores)
    if not total:
        return np.zeros((0, labels))
    emit = np.maximum(np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64)), 1e-30)  # products of SCALED steps stay in range
    step = np.exp(moves - moves.max()).astype(np.float64)
    lengths_ = np.array([n for n in lengths if n], np.int64)
    rows_of = -(-lengths_ // CHUNK)
    chain = np.repeat(np.arange(len(lengths_)), rows_of)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of)
    first = np.repeat(np.cumsum(lengths_) - lengths_, rows_of) + number * CHUNK
    size = np.minimum(CHUNK, lengths_[chain] - number * CHUNK)
    deal = np.argsort(-size, kind="stable")  # full rows first: at step t only the first rows are still open
    first, size, chain, number = first[deal], size[deal], chain[deal], number[deal]
    open_at = np.searchsorted(-size, -np.arange(1, int(size.max()) + 1), side="right")
    n = len(size)

    longest = int(size.max())
    inside = np.arange(longest)[:, None] < size[None]
    where_ = first[None] + np.arange(longest)[:, None]
    laid = np.ones((longest, n, labels))  # step, row, label: every step reads one stretch of memory
    laid[inside] = emit[where_[inside]]
    scale = lambda t: t % SCALED == SCALED - 1

    transfer = np.tile(np.eye(labels), (n, 1, 1))
    many = rows_of[chain] > 1
    if many.any():  # only texts of several rows need them
        back = np.nonzero(many)[0]
        part, limit = laid[:, many], size[many]
        product = np.tile(np.eye(labels), (len(back), 1, 1))
        for t in range(int(limit.max())):
            k = int(np.searchsorted(-limit, -(t + 1), side="right"))
            product[:k] = (product[:k] @ step) * part[t, :k, None]
            if scale(t):
                product[:k] /= product[:k].max(axis=(1, 2), keepdims=True)
        transfer[back] = product / product.max(axis=(1, 2), keepdims=True)
    into, out_of = np.full((n, labels), 1.0 / labels), np.ones((n, labels))
    where = np.empty(n, np.int64)
    where[np.lexsort((number, chain))] = np.arange(n)
    place = np.argsort(where)  # rows in order of text and number
    heads = np.cumsum(rows_of) - rows_of
    for k in range(1, int(rows_of.max())):
        c = np.nonzero(rows_of > k)[0]
        now, before = place[heads[c] + k], place[heads[c] + k - 1]
        moved = np.einsum("ni,nij->nj", into[before], transfer[before])
        into[now] = moved / moved.sum(axis=1, keepdims=True)
    for k in range(int(rows_of.max()) - 2, -1, -1):
        c = np.nonzero(rows_of > k + 1)[0]
        now, after = place[heads[c] + k], place[heads[c] + k + 1]
        moved = np.einsum("nij,nj->ni", transfer[after], out_of[after])
        out_of[now] = moved / moved.max(axis=1, keepdims=True)

    state, kept = into, np.empty_like(laid)
    for t in range(longest):
        m = open_at[t]
        state[:m] = (state[:m] @ step) * laid[t, :m]
        if scale(t):
            state[:m] /= state[:m].sum(axis=1, keepdims=True)
        kept[t, :m] = state[:m]
    state = out_of
    for t in range(longest - 1, -1, -1):
        m = open_at[t]
        kept[t, :m] *= state[:m]
        state[:m] = (laid[t, :m] * state[:m]) @ step.T
        if scale(t):
            state[:m] /= state[:m].max(axis=1, keepdims=True)
    found = np.empty((total, labels))
    found[where_[inside]] = kept[inside]
    return found / found.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit the field on labelled texts; None without any labelled word.

    Every ``RESERVED``-th text is fitted on too, but its trigrams only set what is familiar: they are not in ``grams``.
    """
    texts = [(words, lang) for words, lang in ((words_of(text), lang) for text, lang in sorted(sample)) if words]
    labels = sorted({lang for _, lang in texts})
    if not labels:
        return None
    code = {lang: k for k, lang in enumerate(labels)}
    counts = [Counter() for _ in labels]
    for words, lang in texts:
        counts[code[lang]].update(words)
    total = sum(counts, Counter())
    lexicon = {}
    for k, own in enumerate(counts):
        kept = [w for w, c in own.items() if c >= 3 and c >= 0.9 * total[w]]
        lexicon |= dict.fromkeys(sorted(kept, key=lambda w: (-own[w], w))[:LEXICON], k)
    model = Model(labels, np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros((len(labels), len(labels))), lexicon, np.zeros(len(labels), np.float32))

    fitted_on = sorted({w for k, (words, _) in enumerate(texts) if k % RESERVED for w in words})
    reserved = [" ".join(words) for words, _ in texts[::RESERVED]]
    if fitted_on:
        model.grams = np.unique(trigrams(fitted_on)[0])
        found = [model.known_trigrams(words_of(t)).sum(axis=0) for t in reserved]
        model.familiar = FAMILIAR * float(np.quantile([hits / size for hits, size in found], FAMILIAR_SHARE))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    coded = [(np.array([index.setdefault(w, len(index)) for w in words]), code[lang]) for words, lang in texts]
    vocabulary = list(index)
    by_label = [[k for k, (_, lang) in enumerate(coded) if lang == c] for c in range(len(labels))]
    grid, truth = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for row in range(SEQUENCES):
        at = 0
        while at < LENGTH:
            words, lang = coded[rng.choice(by_label[rng.integers(len(labels))])]
            start = int(rng.integers(len(words)))
            part = words[start : start + min(LENGTH - at, 4 + int(rng.geometric(0.05)))]
            grid[row, at : at + len(part)], truth[row, at : at + len(part)] = part, lang
            at += len(part)
    used, grid = np.unique(grid, return_inverse=True)  # words that no sequence took are not needed any more
    grid, vocabulary = grid.reshape(SEQUENCES, LENGTH), [vocabulary[u] for u in used]
    del coded, index, texts
    parts = [features(vocabulary[k : k + 20_000]) for k in range(0, len(vocabulary), 20_000)]
    ids = np.concatenate([i.astype(np.int32) for i, _ in parts])
    sizes = np.cumsum([0] + [len(i) for i, _ in parts])
    starts = np.concatenate([s + at for (_, s), at in zip(parts, sizes[:-1], strict=True)])
    ends = np.append(starts[1:], len(ids))
    del parts
    known = np.array([lexicon.get(w, -1) for w in vocabulary])
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.moves, model.trust)]
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(SEQUENCES), SEQUENCES // SEQUENCES_A_STEP):
            unique, inverse = np.unique(grid[rows], return_inverse=True)
            gold = truth[rows].reshape(-1)
            scores = model.emissions([vocabulary[u] for u in unique])[inverse.reshape(-1)]
            found = posteriors(scores, model.moves, [LENGTH] * len(rows))
            slope = found.copy()
            slope[np.arange(len(gold)), gold] -= 1
            per_word = np.zeros((len(unique), len(labels)))
            np.add.at(per_word, inverse.reshape(-1), slope)
            per_word /= len(rows)
            take = np.concatenate([ids[starts[u] : ends[u]] for u in unique])
            spread = np.repeat(per_word, ends[unique] - starts[unique], axis=0)
            wslope = np.stack([np.bincount(take, spread[:, c], DIMENSIONS) for c in range(len(labels))], axis=1) + DECAY * model.weights
            # pairs of neighbours: expected (by the chain's conditional) minus observed moves
            emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(len(rows), LENGTH, -1)
            post, step = found.reshape(len(rows), LENGTH, -1), np.exp(model.moves)
            forward = _forward(emit, step)
            pair = forward[:, :-1, :, None] * step * (post[:, 1:] / np.maximum(np.einsum("bti,ij->btj", forward[:, :-1], step), 1e-300))[:, :, None, :]
            observed = np.zeros_like(model.moves)
            np.add.at(observed, (truth[rows][:, :-1].reshape(-1), truth[rows][:, 1:].reshape(-1)), 1)
            mslope = (pair.sum(axis=(0, 1)) - observed) / len(rows)
            here = known[unique] >= 0
            tslope = np.bincount(known[unique][here], per_word[here, known[unique][here]], len(labels))
            for value, gradient, square in zip((model.weights, model.moves, model.trust), (wslope, mslope, tslope), squares, strict=True):
                square += gradient**2
                value -= (RATE * gradient / np.sqrt(square)).astype(value.dtype)
    return model


def _forward(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Filtered state probabilities of equally long chains."""
    out, state = np.empty_like(emit), np.full((len(emit), emit.shape[2]), 1.0 / emit.shape[2])
    for t in range(emit.shape[1]):
        state = (state @ step) * emit[:, t]
        state /= state.sum(axis=1, keepdims=True)
        out[:, t] = state
    return out


def sample_texts(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``SAMPLE_TEXTS`` different labelled texts of each language, those with the smallest hashes.

    Hashes are ranked without texts, and only near the front; ``SAMPLE_TEXTS`` rows a language come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    usable = rows.where(train_rows & F.col("label").isNotNull() & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    counts = usable.groupBy("label").agg(F.approx_count_distinct("hash").alias("count")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not counts:
        return []
    # about eight times as many texts as wanted are looked at, so that the ranking of a label is small however many rows it has
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, 8 * SAMPLE_TEXTS / r["count"])) for r in counts], "label string, share double")
    place = F.pmod(F.xxhash64("hash"), F.lit(1 << 32)) / float(1 << 32)
    near = usable.select("label", "hash").join(F.broadcast(shares), "label").where(place < F.col("share")).select("label", "hash").distinct()
    rank = Window.partitionBy("label").orderBy(place, "hash")
    chosen = materialize(near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE_TEXTS).select("label", "hash"), "sampled")
    picked = usable.join(F.broadcast(chosen), ["label", "hash"]).groupBy("label", "hash").agg(F.min("text").alias("text"))
    return sorted((r["text"], r["label"]) for r in picked.collect())


def judged_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """``(label, score, known)`` per text: the label with the highest mean probability over all words, and the share of known trigrams."""
    words, lengths = [], []
    for text in texts:
        own = words_of(text)
        words += own
        lengths.append(len(own))
    scores, seen = model.scores(words)
    found = posteriors(scores, model.moves, lengths)
    starts = np.cumsum(lengths) - lengths
    out = []
    for start, n in zip(starts.tolist(), lengths, strict=True):
        if not n:
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        mean = found[start : start + n].mean(axis=0)
        hits, size = seen[start : start + n].sum(axis=0).tolist()
        best = int(np.argmax(mean))
        out.append((model.labels[best], float(min(1.0, mean[best])), hits / size))
    return out


def text_answers(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """``(label, score)`` per text."""
    return [(label, score) for label, score, _ in judged_texts(model, texts)]


def word_labels(model: Model, text: str | None) -> list[tuple[str, str, float]]:
    """``(word, label, probability)`` of each word: the code-switched view of a text."""
    words = words_of(text)
    found = posteriors(model.emissions(words), model.moves, [len(words)])
    return [(w, model.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, found, strict=True)]


ANSWER = "doc_id long, held_out boolean, lang_pred string, score double"
#: Texts that forward-backward runs over together end when they hold this many characters.
CHARS_TOGETHER = 500_000


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def groups_by_size(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHARS_TOGETHER:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """The field fitted on the rows that are not held out."""
    return train(sample_texts(docs, ~held_out("doc_id"), id_col, text_col, label_col))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicted language of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema, shared = arrow_schema(ANSWER), docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("languages")
        fit = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [x for part in groups_by_size(texts) for x in text_answers(fit, texts[part])] if fit else [(UNKNOWN, 0.0)] * len(texts)
            yield batch_of(schema, {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return rows.mapInArrow(answer, ANSWER)


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` in a recognised language, with the predicted language as their label; ``und`` texts go.

    Recognised is a text whose letter trigrams are as well known to the sample as those of labelled texts that the
    model was not fitted on (``Model.familiar``); this does not depend on how many languages there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, known double")
    def answer(texts):
        import pandas as pd

        only("languages")
        values, fit = [t if isinstance(t, str) else None for t in texts], shared.value
        found = [x for part in groups_by_size(values) for x in judged_texts(fit, values[part])] if fit else [(UNKNOWN, 0.0, 0.0)] * len(values)
        return pd.DataFrame({"label": [label for label, _, _ in found], "known": [known for _, _, known in found]})

    # not deterministic, as Spark is told: else it would answer twice, for the filter and for the label
    judged = docs.withColumn("_crf_answer", answer.asNondeterministic()(text_col))
    kept = judged.where((F.col("_crf_answer.label") != UNKNOWN) & (F.col("_crf_answer.known") >= (model.familiar if model else 0.0)))
    return kept.withColumn(label_col, F.col("_crf_answer.label")).select(*docs.columns)
