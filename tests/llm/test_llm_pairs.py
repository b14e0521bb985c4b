"""Near-duplicate vectors and documents, components, and byte copies."""

import hashlib
import random

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from reqweave.llm import components, lpf, rabitq, superminhash
from reqweave.llm.common import start


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for p in links for n in p if p[0] != p[1]}
    assert got == groups(nodes, [p for p in links if p[0] != p[1]])


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_frame(spark):
    rng = np.random.default_rng(4)
    data, k = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 9))):
                data.append((k, (centre + rng.normal(size=16) * 0.08).tolist(), label))
                k += 1
    data += [(k, data[0][1], 0), (k + 1, data[0][1], 1), (k + 2, [x * 3 for x in data[0][1]], 0), (k + 3, data[0][1], None), (k + 4, None, 0), (k + 5, [0.0] * 16, 0)]
    data += [(k + 6, [float("nan")] * 16, 0), (k + 7, [1.0, None], 0), (k + 8, [], 0), (k + 9, [1.0, 2.0], 0), (k + 10, [2.0, 4.0], 0), (3, data[3][1], 0)]
    return data, spark.createDataFrame([(*r, 5, "x", 2) for r in data], "vec_id long, embedding array<double>, label int, row long, dim string, copies int").repartition(3)


@pytest.mark.parametrize("cell", [1024, 8])
def test_vectors_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(rabitq, "CELL_ROWS", cell)
    monkeypatch.setattr(rabitq, "BLOCK", 16)
    start(spark)
    data, df = vectors_frame(spark)
    good = [k for k, (_, v, label) in enumerate(data) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for i in good:
        for j in good:
            a, b = data[i], data[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98:
                links.append((i, j))
    root = groups(range(len(data)), links)
    least = {c: min(data[k][0] for k in root if root[k] == c) for c in root.values()}
    want = sorted((data[k][0], sum(k in p for p in links), least[root[k]], least[root[k]] == data[k][0]) for k in root)
    assert len(links) > 40
    assert sorted(tuple(r) for r in rabitq.near_duplicate_vectors(df).collect()) == want


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(400, 64)), rng.normal(size=(200, 64))))
    centre = x[:20].mean(axis=0)
    codes, length, correction = rabitq.encode(x - centre)
    found, upper = rabitq.upper_cosines(codes, length, correction, centre, q)
    true = q @ x.T
    assert abs((found - true).mean()) < 0.005 and np.abs(found - true).mean() < 0.15
    assert (upper >= true).all()


def test_no_vectors(spark):
    start(spark)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rabitq.near_duplicate_vectors(none).count() == 0


def word_set(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_documents_against_all_pairs(spark):
    start(spark)
    data = rows()
    sets = [word_set(r[1]) for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = groups(range(len(data)), links)
    ids = lambda c: [data[k][0] for k in root if root[k] == c and data[k][0] is not None]
    want = []
    for k, r in enumerate(data):
        least = min(ids(root[k]), default=None)
        want.append((r[0], len(sets[k]), least, least == r[0]))
    assert len(links) > 90
    assert sorted(map(str, map(tuple, superminhash.near_duplicates(frame(spark)).collect()))) == sorted(map(str, want))
    assert superminhash.near_duplicates(empty(spark)).count() == 0


def test_a_large_group_of_near_copies_keeps_its_outliers(spark):
    """Members far from most of the group link through a few others only."""
    start(spark)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    data = []
    for k in range(150):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([2, 4, 6, 9])):
            copy[at] = f"x{k}_{at}"
        data.append((k, " ".join(copy), "en", "s"))
    sets = [word_set(r[1]) for r in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = groups(range(len(data)), links)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(frame(spark, data)).collect()}
    assert got == root and len(set(root.values())) > 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = superminhash.mix(np.arange(4000, dtype=np.uint64))
    errors = []
    for _ in range(30):
        a, b = rng.choice(pool, 300, replace=False), rng.choice(pool, 100, replace=False)
        b = np.union1d(a[:200], b)
        one, two = superminhash.signatures([np.unique(a), b])
        errors.append((one == two).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_agreement_counts_equal_slots(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 60, (2, 40, superminhash.SLOTS), dtype=np.uint64)
    for k in range(40):
        b[k, : 9 * k] = a[k, : 9 * k]
    df = spark.createDataFrame(list(zip(superminhash.codes(a).tolist(), superminhash.codes(b).tolist(), strict=True)), "codes_a array<long>, codes_b array<long>")
    got = [r[0] for r in df.select(superminhash.agreement("codes_a", "codes_b")).collect()]
    same = ((superminhash.mix(a) & np.uint64(255)) == (superminhash.mix(b) & np.uint64(255))).sum(axis=1)
    assert np.allclose(got, (same / superminhash.SLOTS - 1 / 256) / (255 / 256))


def test_a_long_set_has_the_signature_of_its_parts(monkeypatch):
    elements = np.unique(superminhash.mix(np.arange(5000, dtype=np.uint64)))
    whole = superminhash.signatures([elements])
    monkeypatch.setattr(superminhash, "TOGETHER", 700)
    assert (superminhash.signatures([elements]) == whole).all()


def byte_rows():
    rng = random.Random(11)
    line = "This line, with ä and ö, stands in many documents and is longer than a hundred bytes so that all its copies go away."
    short = "only sixty-six or so bytes of this are the same everywhere, not more"
    out = []
    for k in range(40):
        own = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 400)))
        out.append((k, own + (line if k % 3 == 0 else short if k % 3 == 1 else "") + own[::-1], "en", "s"))
    out += [(50, out[3][1], "en", "s"), (51, "ab" * 300, "en", "s"), (52, "x" * 150 + "ab" * 60, "en", "s"), (53, None, None, None), (54, "", None, None)]
    out += [(None, out[4][1], "en", "s"), (2, out[9][1], "en", "s"), (60, out[5][1], "en", "s"), (60, out[5][1], "en", "s")]
    return out


@pytest.mark.parametrize("hot,part,task,texts", [(20_000, 1 << 19, 48 << 20, 64), (2, 1 << 19, 3000, 1), (20_000, 150, 1000, 64), (20_000, 1 << 19, 6000, 2)])
def test_bytes_against_every_string(spark, monkeypatch, hot, part, task, texts):
    monkeypatch.setattr(lpf, "HOT_RUNS", hot)
    monkeypatch.setattr(lpf, "TASK_TEXTS", texts)
    monkeypatch.setattr(lpf, "PART", part)
    monkeypatch.setattr(lpf, "TASK_BYTES", task)
    monkeypatch.setattr(lpf, "BUCKET_BYTES", 4000)
    start(spark)
    df = frame(spark, byte_rows())
    placed = sorted({(r["ord"], r["tie"], r["text"]) for r in lpf.ordered_texts(df).collect()})
    seen, want = set(), {}
    for place, tie, text in placed:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(None if place == 2**63 - 1 else place), text] = (len(b), sum(gone), n, hashlib.sha256(kept).hexdigest())
    expected = [(r[0], *want[r[0], r[1] or ""]) for r in byte_rows()]
    assert sum(e[2] for e in expected) > 1500
    assert sorted(map(str, map(tuple, lpf.without_copies(df).collect()))) == sorted(map(str, expected))


def test_previous_factors_against_search():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[300:440] = text[20:160]
    got = lpf.previous_factor(text, np.arange(600), 100)
    raw = text.tobytes()
    for i in range(0, 600, 7):
        best = 0
        for j in range(i):
            k = 0
            while k < 100 and i + k < 600 and raw[i + k] == raw[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_no_documents_have_no_copies(spark):
    start(spark)
    assert lpf.without_copies(empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Ids may repeat or be null: rows are judged, not ids."""
    start(spark)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60))
    copied, other, third, fourth = text(), text(), text(), text()
    data = [(5, copied), (7, copied + " tail"), (7, other), (None, copied), (None, third), (None, third), (9, fourth), (9, fourth), (12, None), (12, None), (13, ""), (None, None)]
    kept = superminhash.first_of_groups(frame(spark, [(*r, "en", "s") for r in data]))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(5, copied), (7, other), (None, third), (9, fourth), (12, None), (12, None), (13, ""), (None, None)]))
    assert kept.columns == frame(spark).columns
    assert superminhash.first_of_groups(empty(spark)).count() == 0


def plain_shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\n", " ").split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("part", [8, 64, 1 << 18])
def test_long_texts_are_hashed_part_by_part(monkeypatch, part):
    rng = random.Random(part)
    superminhash._kept_powers.cache_clear()
    monkeypatch.setattr(superminhash, "PART_BYTES", part)
    for n in (0, 1, 3, 40, 700):
        text = " ".join(rng.choice(["Ab", "ab", "é", "x" * 100, "cd\n", ""]) for _ in range(n))
        assert len(superminhash.shingles(text)) == len(plain_shingles(text))
    superminhash._kept_powers.cache_clear()


def test_a_very_long_text_needs_little_memory():
    import tracemalloc

    text = "word and another %d " * 2_600_000  # 50 MB
    tracemalloc.start()
    superminhash.shingles(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6


def test_near_copies_just_above_and_below_the_threshold_cost_few_pairs(spark, monkeypatch):
    # two replaced words each: most pairs lie just below the threshold, those with a place in common above it
    rng, plain = random.Random(5), [f"w{k}" for k in range(120)]
    docs = []
    for k in range(600):
        words = list(plain)
        for place in rng.sample(range(2, 118, 2), 2):
            words[place] = f"x{k}p{place}"
        docs.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = {k: k for k in sets}
    before = None
    while before != component:
        before = dict(component)
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    compared = []
    judge = superminhash.verified
    monkeypatch.setattr(superminhash, "verified", lambda pairs, texts: compared.append(pairs.count()) or judge(pairs, texts))
    found = superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert len(links) > 10_000 and sum(compared) < 20 * len(docs), compared
