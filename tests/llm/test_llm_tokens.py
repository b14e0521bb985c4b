"""Packed token files and packing."""

import zlib

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from reqweave.llm import packing, simple8b, tokens
from reqweave.llm.common import start
from reqweave.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 1 << 33, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_streams_come_back(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True) >> rng.integers(0, 64, n).astype(np.uint64)
    content = b"head" + simple8b.stream_bytes(values)
    found, end = simple8b.read_stream(content, 4)
    assert end == len(content) and found.tolist() == values.tolist()


def test_one_block_is_found_by_its_offset_and_wide_values_escape():
    values = np.arange(1000, dtype=np.uint64)
    values[[3, 700]] = (1 << 64) - 1, 1 << 60
    words, offsets, escaped = simple8b.pack(values)
    assert escaped.tolist() == [(1 << 64) - 1, 1 << 60]
    assert simple8b.unpack_block(words, offsets, escaped, 1000, 2).tolist() == values[512:768].tolist()


def test_small_values_take_little_room():
    words, _, _ = simple8b.pack(np.ones(2560, np.uint64))
    assert len(words) == 10 * 5  # 60, 60, 60, 60 and 16 of a block


def test_word_memory_gives_the_library_s_ids(tokenizer):
    import random

    encode, rng = tokens.encoder(word_tokenizer()), random.Random(5)
    letters = " \n\t.,'ABcdéÉßÿ×÷µªºİıſK\xa0\x1c\x85Σσς中한🎉١9_-<|" + "'s'll"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", " <|endoftext|>a", "<|ENDofTEXT|>"])
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def expected(tokenizer, data, end_id):
    out = []
    for doc_id, text, *_ in data:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_files_hold_every_document_in_order(spark, tokenizer, monkeypatch):
    start(spark)
    got = tokens.token_files(frame(spark), word_tokenizer(), 1).orderBy("start").collect()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(expected(tokenizer, rows(), 1), key=str)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows()), key=lambda d: (d is not None, d))
    place = 0
    for r in got:
        assert r["start"] == place
        place += r["n_tokens"]


def test_empty_tables(spark):
    start(spark)
    assert tokens.token_files(empty(spark), word_tokenizer(), 1).count() == 0
    assert packing.pack(empty(spark), word_tokenizer()).count() == 0


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]


def test_best_fit_equals_a_plain_search():
    import random

    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    room, want = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        want.append(min(fits) if fits else 64)
        if fits:
            room.remove(min(fits))
        room.append(want[-1] - n)
    assert [64 - offset for _, offset in packing.best_fit(lengths, 64)] == want


@pytest.mark.parametrize("group", [8192, 10])
def test_packing_places_every_id_once(spark, tokenizer, group):
    start(spark)
    got = packing.pack(frame(spark), word_tokenizer(), 2, size=256, group_pieces=group).toPandas()
    assert got["length"].max() <= 256
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    want = {}
    for doc_id, text, *_ in rows():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for a in range(0, len(ids), 256):
            key = (-1 if doc_id is None else doc_id, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    found = got.fillna({"doc_id": -1}).groupby(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).size().to_dict()
    assert found == want


def test_batches_of_long_texts_are_short(spark):
    import pyarrow as pa

    from reqweave.llm.common import BATCH_BYTES

    start(spark)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    long = spark.range(400).selectExpr("repeat('x', 100000) AS t").coalesce(1).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in long) == 400 and max(r["bytes"] for r in long) <= BATCH_BYTES + 200_000
