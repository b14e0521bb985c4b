"""Secrets in whole texts: fixed patterns, and formats learned by grammar inference.

Fixed patterns (``assign``, ``access``, ``hex``) give the base spans. Their values are the
labelled credentials: a bounded sample of each kind is turned into a prefix tree over
character classes whose states are merged while their outgoing frequencies are
statistically compatible (Hoeffding's bound), which leaves a small probabilistic
automaton per kind; what all values of a kind begin with is taken letter by letter. Every other token of ``LEAST_CHARS`` characters or more is then scored by the
likelihood of its format, its end included, under these automata against an automaton of ordinary tokens: what stops
where the format does not, or goes on where it stops, is no credential. Of a token that touches a base
span the parts outside it are scored.

Texts are read twice: for the base spans and a bounded sample of tokens, and, with the automata, for all spans.

Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind.
Edge cases: a null text is an empty one and has no spans; repeated rows are scanned
each; an empty table, or one with fewer than ``MIN_LABELLED`` credentials of a kind,
gives no automaton (of that kind) and so no learned spans. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.common import texts_of
from reqweave.storage import materialize

#: Kinds in their order (fixed values); ``learned`` is what the automata add.
KINDS = ("assign", "access", "hex", "learned")
#: The fixed patterns, as given.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORD = re.compile("password|passwd|secret|token|api_?key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Least characters of a scored token, as of a labelled value.
LEAST_CHARS = 8
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Probability of a step, or an end, that an automaton has not seen.
UNSEEN = 1e-4
#: Tokens up to this length are scored side by side, longer ones one by one.
SIDE_BY_SIDE = 256

#: Credentials of a kind, and ordinary tokens, that automata are fitted on at most (smallest hashes first).
SAMPLE = 600
#: Longer values are left out of fitting (not out of scoring).
SAMPLE_CHARS = 200
MIN_LABELLED = 20
#: Confidence of the merge test.
ALPHA = 0.05
#: Share of held-back credentials whose likelihood a candidate must reach.
FLOOR_SHARE = 0.02
#: Least advantage over ordinary tokens, in nats per character.
MARGIN = 0.5


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind index, end, start of the value)`` of the fixed patterns."""
    found = []
    if KEYWORD.search(text.lower()):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Tokens, or their parts that no base span covers, of ``LEAST_CHARS`` characters or more."""
    if not base:
        return [m.span() for m in TOKEN.finditer(text)]
    out, taken, k, reach = [], sorted((s, e) for s, _, e, _ in base), 0, 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        at = max(at, reach)
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] - at >= LEAST_CHARS:
                out.append((at, taken[k][0]))
            reach, k = max(reach, taken[k][1]), k + 1
            at = max(at, reach)
        if end - at >= LEAST_CHARS:
            out.append((at, end))
    return out


_CLASSES = {**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
_SIZES = {"9": 10, "a": 6, "g": 20, "A": 6, "G": 20}


@dataclass
class Automaton:
    """A deterministic probabilistic automaton over character classes."""

    ends: list[int] = field(default_factory=lambda: [0])
    totals: list[int] = field(default_factory=lambda: [0])
    arcs: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])  # symbol -> [count, target]
    least: float = -math.inf
    literal: str = ""  # what every value begins with; the states describe the rest
    _tables: tuple | None = None

    def add(self, word: str) -> None:
        state = 0
        for symbol in word:
            self.totals[state] += 1
            arc = self.arcs[state].setdefault(symbol, [0, -1])
            if arc[1] < 0:
                arc[1] = len(self.arcs)
                self.arcs.append({})
                self.ends.append(0)
                self.totals.append(0)
            arc[0] += 1
            state = arc[1]
        self.totals[state] += 1
        self.ends[state] += 1

    def likelihood(self, text: str) -> float:
        """Log-likelihood per character. The end counts against the automaton's likeliest end, so formats of any length compare.

        Behind a step that the automaton has not seen nothing is known any more.
        """
        state, total = (0, 0.0) if text.startswith(self.literal) else (-1, len(self.literal) * math.log(UNSEEN))
        for char in text[len(self.literal) :]:
            symbol = _CLASSES.get(char, char)
            arc = self.arcs[state].get(symbol) if state >= 0 else None
            total += math.log(UNSEEN if arc is None else arc[0] / self.totals[state]) - math.log(_SIZES.get(symbol, 1))
            state = -1 if arc is None else arc[1]
        return (total + self.tables()[2][state]) / max(1, len(text))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Target and log probability of each state and byte, and the end's against the likeliest end; the last state knows nothing."""
        if self._tables is None:
            n = len(self.arcs)
            target, gain = np.full((n + 1, 128), n, np.int32), np.full((n + 1, 128), math.log(UNSEEN))
            for byte in range(128):
                symbol = _CLASSES.get(chr(byte), chr(byte))
                for state, arcs in enumerate(self.arcs):
                    if symbol in arcs:
                        target[state, byte], gain[state, byte] = arcs[symbol][1], math.log(arcs[symbol][0] / self.totals[state])
                gain[:, byte] -= math.log(_SIZES.get(symbol, 1))
            stops = [e / t if t else 0.0 for e, t in zip(self.ends, self.totals, strict=True)] + [0.0]
            self._tables = target, gain, np.log(np.maximum(np.array(stops) / max(max(stops), UNSEEN), UNSEEN))
        return self._tables

    def likelihoods(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``likelihood`` of many tokens: bytes by place and token, the longest tokens first."""
        target, gain, stop = self.tables()
        fixed = len(self.literal)
        same = (grid[:fixed] == np.frombuffer(self.literal.encode(), np.uint8)[:, None][: len(grid)]).all(axis=0) & (lengths >= fixed)
        state, total = np.where(same, 0, len(target) - 1).astype(np.int32), np.where(same, 0.0, fixed * math.log(UNSEEN))
        grid, going = grid[fixed:], np.searchsorted(-lengths, -np.arange(fixed + 1, len(grid) + 1), side="right")
        for bytes_, n in zip(grid, going.tolist(), strict=True):
            now = state[:n]
            total[:n] += gain[now, bytes_[:n]]
            state[:n] = target[now, bytes_[:n]]
        return (total + stop[state]) / np.maximum(lengths, 1)


def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) >= bound


def _compatible(a: Automaton, one: int, two: int) -> bool:
    pending = [(one, two)]
    while pending:
        x, y = pending.pop()
        if not a.totals[x] or not a.totals[y]:
            continue
        if _differ(a.ends[x], a.totals[x], a.ends[y], a.totals[y]):
            return False
        for symbol in a.arcs[x].keys() | a.arcs[y].keys():
            left, right = a.arcs[x].get(symbol, (0, -1)), a.arcs[y].get(symbol, (0, -1))
            if _differ(left[0], a.totals[x], right[0], a.totals[y]):
                return False
            if left[1] >= 0 and right[1] >= 0:
                pending.append((left[1], right[1]))
    return True


def _fold(a: Automaton, into: int, tree: int) -> None:
    """Add the counts of the tree below ``tree`` to the states that its words reach from ``into``."""
    pending = [(into, tree)]
    while pending:
        x, y = pending.pop()
        a.ends[x] += a.ends[y]
        a.totals[x] += a.totals[y]
        for symbol, (count, target) in a.arcs[y].items():
            arc = a.arcs[x].get(symbol)
            if arc is None:
                a.arcs[x][symbol] = [count, target]
            else:
                arc[0] += count
                pending.append((arc[1], target))


def infer(words: list[str]) -> Automaton:
    """Prefix tree of ``words``, its compatible states merged, nearest the root first."""
    a = Automaton()
    for word in sorted(words):
        a.add("".join(_CLASSES.get(c, c) for c in word))
    settled = [0]
    while True:
        fringe = [(s, symbol, t) for s in settled for symbol, (_, t) in a.arcs[s].items() if t not in settled]
        if not fringe:
            return _reachable(a)
        source, symbol, state = max(fringe, key=lambda f: (a.totals[f[2]], -f[2]))
        for other in settled:
            if _compatible(a, other, state):
                a.arcs[source][symbol][1] = other
                _fold(a, other, state)
                break
        else:
            settled.append(state)


def _reachable(a: Automaton) -> Automaton:
    """The automaton without the merged states."""
    number, pending = {0: 0}, [0]
    while pending:
        for _, target in a.arcs[pending.pop()].values():
            if target not in number:
                number[target] = len(number)
                pending.append(target)
    arcs = [{symbol: [count, number[target]] for symbol, (count, target) in a.arcs[s].items()} for s in number]
    return Automaton([a.ends[s] for s in number], [a.totals[s] for s in number], arcs)


@dataclass
class Grammar:
    kinds: list[Automaton]
    ordinary: Automaton | None

    def is_secret(self, token: str) -> bool:
        if not self.kinds:
            return False
        plain = self.ordinary.likelihood(token) if self.ordinary else -math.inf
        for automaton in self.kinds:
            found = automaton.likelihood(token)
            if found >= automaton.least and found - plain >= MARGIN:
                return True
        return False

    def secrets(self, tokens: Iterable[str]) -> set[str]:
        """Those of ``tokens`` that are secrets; equal tokens are scored once."""
        if not self.kinds:
            return set()
        distinct = sorted(set(tokens), key=len, reverse=True)
        long = sum(len(t) > SIDE_BY_SIDE for t in distinct)
        out, short = {t for t in distinct[:long] if self.is_secret(t)}, distinct[long:]
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            lengths = np.array([len(t) for t in part])
            cells = "".join(t.ljust(int(lengths[0]), "\0") for t in part).encode()
            grid = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(len(part), -1).T)
            plain = self.ordinary.likelihoods(grid, lengths) if self.ordinary else np.full(len(part), -np.inf)
            good = np.zeros(len(part), bool)
            for automaton in self.kinds:
                found = automaton.likelihoods(grid, lengths)
                good |= (found >= automaton.least) & (found - plain >= MARGIN)
            out.update(part[k] for k in np.nonzero(good)[0])
        return out


def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Grammar:
    """One automaton per kind; every fifth credential is held back to set the least likelihood."""
    kinds = []
    for values in labelled.values():
        if len(values) < MIN_LABELLED:
            continue
        values = sorted(values, key=lambda v: hashlib.md5(v.encode()).digest())
        literal = os.path.commonprefix(values)
        automaton = infer([v[len(literal) :] for i, v in enumerate(values) if i % 5])
        automaton.literal = literal
        scores = sorted(automaton.likelihood(v) for v in values[::5])
        automaton.least = scores[int(FLOOR_SHARE * len(scores))]
        kinds.append(automaton)
    return Grammar(kinds, infer(ordinary) if ordinary else None)


def labelled_values(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, value``: values of the base spans, and of ordinary tokens those of each task with the smallest hashes."""
    schema = pa.schema([("kind", pa.int32()), ("value", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, int] = {}
        for batch in batches:
            kinds, values, tokens = [], [], set()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                kinds += [k for _, k, _, _ in base]
                values += [text[v:e] for _, _, e, v in base]
                tokens.update(text[s:e] for s, e in candidates(text, base) if e - s <= SAMPLE_CHARS)
            bound = max(least.values()) if len(least) >= SAMPLE else 1 << 32
            least.update((t, h) for t in tokens if (h := zlib.crc32(t.encode())) < bound)
            least = dict(sorted(least.items(), key=lambda x: (x[1], x[0]))[:SAMPLE])
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], schema=schema)
        yield pa.record_batch([pa.array([3] * len(least), pa.int32()), pa.array(list(least), pa.string())], schema=schema)

    return docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(find, "kind int, value string")


def learn(docs: DataFrame, text_col: str = "text") -> Grammar:
    """Automata from a bounded sample: the ``SAMPLE`` distinct values of each kind with the smallest hashes."""
    found = materialize(labelled_values(docs, text_col), "credentials").where(F.length("value") <= SAMPLE_CHARS).distinct()

    def sample(kind: int) -> list[str]:
        order = F.crc32(F.col("value").cast("binary")) if kind == 3 else F.xxhash64("value")
        return [r[0] for r in found.where(F.col("kind") == kind).select("value").orderBy(order, "value").limit(SAMPLE).collect()]

    return fit({KINDS[k]: sample(k) for k in range(3)}, sample(3))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def all_spans(texts: list[str], grammar: Grammar) -> list[tuple[list, list]]:
    """Base spans and learned spans of each text."""
    bases = [base_spans(t) for t in texts]
    spans = [candidates(t, b) for t, b in zip(texts, bases, strict=True)]
    good = grammar.secrets(t[s:e] for t, own in zip(texts, spans, strict=True) for s, e in own)
    return [(b, [(s, e) for s, e in own if t[s:e] in good] if good else []) for t, b, own in zip(texts, bases, spans, strict=True)]


def _joined(spans: str) -> F.Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts and digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("learned", span)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            found = all_spans(batch.column(1).to_pylist(), grammar)
            bases = [[{"start": s, "kind": k, "end": e} for s, k, e, _ in base] for base, _ in found]
            learned = [[{"start": s, "kind": 3, "end": e} for s, e in own] for _, own in found]
            yield pa.record_batch([batch.column(0), pa.array(bases, span), pa.array(learned, span)], schema=schema)

    both = texts_of(docs, id_col, text_col).mapInArrow(find, f"doc_id bigint, base {_SPANS}, learned {_SPANS}")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return both.withColumn("every", F.array_sort(F.concat("base", "learned"))).select(
        "doc_id", *[count(k) for k in range(3)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("every").alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with the value of every span replaced by ``mark``; other columns and null texts stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))

    def clean(text: str, base: list, learned: list) -> str:
        out, at = [], 0
        for s, e in sorted([(v, e) for _, _, e, v in base] + learned):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts):
        given = [t if isinstance(t, str) else None for t in texts]
        found = all_spans([t or "" for t in given], shared.value)
        return pd.Series([None if t is None else clean(t, *spans) for t, spans in zip(given, found, strict=True)], dtype=object)

    return docs.withColumn(text_col, cleaned(text_col))
