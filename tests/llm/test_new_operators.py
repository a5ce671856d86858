"""b-bit MinHash, filter audit and whitening against plain Python and numpy: nulls, ties, copies, odd lengths, empty tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit, minhash, whitening
from ledgerlens.llm.common import U64

from .test_operators import CLASHING, SPACE, TEXTS, odd_table, sets_of, table


def near_copies(seed=3):
    """Groups of texts at many similarities around the threshold, and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 30, 120, 400]))]
        for k in range(8):
            words = list(base)
            for _ in range(r.randrange(0, 1 + k * max(1, len(base) // 60))):
                words[r.randrange(len(words))] = word()
            texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join(base).upper()
    return texts


def components_by_hand(texts, width, percent):
    sets = sets_of(texts, width)
    least = {i: i for i in texts}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i], least[i] == i) for i in texts}


@pytest.mark.parametrize("limits", [{}, {"chunk": 2, "heavy": 3}])
def test_minhash_links_equal_brute_force(spark, limits):
    for texts in (TEXTS, near_copies()):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.link(table(spark, texts), **limits).collect()}
        assert got == components_by_hand(texts, 5, 85)
    assert minhash.link(table(spark, {}), **limits).count() == 0


def test_minhash_estimates_similarity():
    r = np.random.Generator(np.random.PCG64(5))
    apart = []
    for share in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        for _ in range(20):
            both = r.integers(0, 1 << 63, round(1000 * share), dtype=np.uint64)
            own = [r.integers(0, 1 << 63, 1000 - len(both), dtype=np.uint64) for _ in range(2)]
            x, y = (np.sort(np.concatenate([both, o])) for o in own)
            jaccard = len(both) / (2000 - len(both))
            least = minhash.minima(np.concatenate([x, y]), np.array([0, 1000, 2000]))
            a, b = minhash.signatures(least)
            lanes = sum(int(a[k // 32] >> U64(2 * (k % 32)) & U64(3)) != int(b[k // 32] >> U64(2 * (k % 32)) & U64(3)) for k in range(128))
            assert int(minhash.unequal(a, b)) == lanes == int(((least[0] ^ least[1]) & 3 != 0).sum())
            estimate = float(minhash.similarity(minhash.unequal(a, b)))
            apart.append(estimate - jaccard)
            assert abs(estimate - jaccard) < 0.3
            assert jaccard < 0.85 or estimate >= minhash.least_estimate(85)
    assert abs(np.mean(apart)) < 0.02
    assert 0.5 < minhash.least_estimate(85) < 0.7 and minhash.least_estimate(100) == 1.0


def test_minima_of_sets_longer_than_a_step(monkeypatch):
    r = np.random.Generator(np.random.PCG64(6))
    first = np.array([0, 1, 50, 51, 400, 1000])
    sets = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    whole = minhash.minima(sets, first)
    monkeypatch.setattr(minhash, "_AT_ONCE", 37)
    assert (minhash.minima(sets, first) == whole).all()
    assert (minhash.minima(sets[51:400], np.array([0, 349])) == whole[3]).all()
    assert minhash.minima(np.empty(0, np.uint64), np.zeros(1, np.int64)).shape == (0, minhash.HASHES)


def test_differences_to_a_hub_give_exact_links():
    """All pairs of a chunk by differences equal the sets themselves, whatever the width of the products."""
    import pyarrow as pa

    r = np.random.Generator(np.random.PCG64(4))
    hub = np.unique(r.integers(0, 1 << 63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([r.choice(hub, len(hub) - r.integers(0, 30), replace=False), r.choice(np.arange(50, dtype=np.uint64), r.integers(0, 12), replace=False)])) for _ in range(40)]
    apart = [np.setxor1d(hub, x).tobytes() for x in sets]
    both = np.arange(40)
    for columns in (7, 1 << 12):
        old, minhash._COLUMNS = minhash._COLUMNS, columns
        shared = minhash._shared_elements(apart, both, both)
        minhash._COLUMNS = old
        assert all(shared[i, j] == len(np.intersect1d(np.frombuffer(apart[i], np.uint64), np.frombuffer(apart[j], np.uint64))) for i in both for j in both if i != j)
    least = minhash.minima(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    lanes = [x.tobytes() for x in minhash.signatures(least)]
    table = pa.table({"print": np.arange(40), "part": np.arange(40), "n_shingles": [len(x) for x in sets], "side": np.zeros(40, int), "lanes": pa.array(lanes, pa.binary()), "apart": pa.array([x if k % 7 else None for k, x in enumerate(apart)], pa.binary())})
    got = minhash._compare(85, table).to_pylist()
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    sure = [(x["a"], x["b"]) for x in got if x["sure"]]
    assert all(linked(*x) for x in sure) and len(sure) < 40
    assert all(i % 7 == 0 or j % 7 == 0 for i, j in ((x["a"], x["b"]) for x in got if not x["sure"]))
    told = [(i, j) for i in both for j in both if i < j and i % 7 and j % 7 and linked(i, j)]
    assert told and groups_of(sure, told) == groups_of(told, told)
    assert {(int(i), int(j)) for i in both for j in both if i < j and (i % 7 == 0 or j % 7 == 0) and linked(i, j)} <= {(x["a"], x["b"]) for x in got if not x["sure"]}


def groups_of(links, nodes):
    least = {int(x): int(x) for pair in nodes for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_minhash_odd_rows(spark):
    docs = odd_table(spark)
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in minhash.link(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 1, False)]
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(x.doc_id or 0 for x in left.collect()) == [0, 0, 1, 1, 2, 3, 4, 5]
    assert minhash.keep_one(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.link(docs, percent=60)


def masks_by_hand(rows):
    out = []
    for i, text, lang in rows:
        text = text or ""
        w = re.findall(SPACE, text)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)]
        out.append((i, lang or "", {k for k, f in zip("ABCDE", fails, strict=True) if f}))
    return out


def audit_by_hand(rows, good, toxic):
    out = {}
    masks = masks_by_hand(rows)
    for part in {p for _, p, _ in masks}:
        mine = [(i, f) for i, p, f in masks if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                sums[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for key, held in out.items():
            if key[0] == part:
                held[-1] = sums[held[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in df.collect()}


def test_filter_audit_equals_running_every_order(spark):
    r = random.Random(8)
    rows = []
    for i in range(160):
        w = ["".join(r.choice("abcdeABß") for _ in range(3)) for _ in range(r.choice([5, 99, 100, 180]))]
        w = w if i % 3 else [x.lower() for x in w]
        w = w if i % 4 else (w[: max(1, len(w) // 2)] * 2)[: len(w)]
        rows.append((i, (" \n".join(w) + ("" if i % 5 else " #1")), ["en", "de", None, ""][i % 4]))
    rows += [(200 + k, rows[k * 7][1], "en") for k in range(20)] + [(300, None, "en"), (301, "", None), (302, "\t ", "fr"), (None, rows[0][1], "en"), (5, rows[5][1], "en"), (-1, rows[9][1], "de")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 230, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, lang string, mask string, held int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3)
    got = audited(filter_audit.audit_documents(docs, known))
    assert got == audit_by_hand(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    assert len(got) == 4 * 600


def test_filter_audit_odd_rows(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(1, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    rows = [(x.doc_id, x.text, x.lang) for x in docs.collect()]
    assert audited(filter_audit.audit_documents(docs, labels)) == audit_by_hand(rows, {1}, {1})
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert audited(filter_audit.audit_documents(docs, labels.limit(0))) == audit_by_hand(rows, set(), set())


def test_subset_zeta_transform_and_filters_of_ones_own(spark):
    r = np.random.Generator(np.random.PCG64(2))
    counts = r.integers(0, 50, (3, 16))
    alive = filter_audit.survivors(counts)
    assert all(alive[p, s] == sum(counts[p, m] for m in range(16) if not m & s) for p in range(3) for s in range(16))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x"), (3, "c", "x")], "doc_id long, text string, lang string")
    own = filter_audit.failures(docs, lambda text, held: {"S": F.size(held) < 2})
    got = audited(filter_audit.audit(filter_audit.count_masks(own, spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), 2), "SR"))
    assert got == {("x", "SR", 1): (1, 2, 0, 1, 1, 0, 3), ("x", "SR", 2): (1, 0, 1, 0, 0, 0, 1), ("x", "RS", 1): (2, 1, 0, 0, 1, 0, 1), ("x", "RS", 2): (1, 1, 1, 1, 0, 0, 3)}
    for letters in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            filter_audit.audit(own, letters)


def whitened_by_hand(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    fit = np.array(sorted(set(map(tuple, x.tolist()))))
    n, sums = len(fit), fit.sum(0)
    z = fit - sums / n
    v = z.T @ z / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return n, deviation, values, basis, (x - sums / n) @ basis, np.trace(v)


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "row_block": 70}])
def test_whitening_equals_numpy(spark, sizes):
    r = np.random.Generator(np.random.PCG64(9))
    vectors = (r.normal(size=(300, 23)) @ r.normal(size=(23, 23))).astype(np.float32)
    vectors[200:260] = vectors[7]  # copies count once in the fit
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(vectors)]
    odd = [(None, vectors[3].tolist(), 1, "x"), (5, vectors[4].tolist(), 1, "x"), (900, None, 1, "x"), (901, [None, *vectors[0][1:].tolist()], 1, "x"), (902, [float("nan"), *vectors[0][1:].tolist()], 1, "x"), (903, [float("-inf"), *vectors[0][1:].tolist()], 1, "x"), (904, [], 1, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, dims string").repartition(4)
    got = whitening.whiten(table, 16, **sizes).collect()
    n, deviation, values, basis, projected, trace = whitened_by_hand(vectors)
    assert n == 240 and len(got) == 302 * 16 and {x.n for x in got} == {n}
    by = {(x.vec_id, x.component): x for x in got if x.vec_id is not None and x.vec_id != 5}
    assert len(by) == 299 * 16 and {x.component for x in got} == set(range(1, 17))
    for c in range(16):
        mine = np.array([by[k, c + 1].whitened for k in range(300) if k != 5])
        want = np.delete(projected[:, c], 5) / np.sqrt(values[c])
        assert np.allclose(mine, want if mine @ want > 0 else -want, rtol=1e-7, atol=1e-9)
    assert all(by[k, 1].deviation == deviation[k] for k in range(300) if k != 5)
    assert all(math.isclose(by[0, c].explained, values[c - 1] / trace, rel_tol=1e-9) for c in range(1, 17))
    (error,) = {x.identity_error for x in got}
    assert 0 <= error < 1e-8
    assert sorted(x.component for x in got if x.vec_id is None) == list(range(1, 17))
    assert whitening.whiten(table.limit(0), 16).count() == 0


def test_whitening_of_few_and_unlike_vectors(spark):
    """Each length has a fit of its own; what has no variance can't be scaled."""
    rows = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0]), (3, [0.5, 0.5]), (4, [0.25, 1e30]), (5, [7.0]), (6, [7.0]), (7, [0.1, -0.1])]
    got = {(x.vec_id, x.component): x for x in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 16).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (6, 1), (7, 1), (7, 2)]
    assert {abs(got[k, 1].whitened) for k in (1, 2)} == {1.0} and got[1, 1].explained == 1.0 and got[1, 2].whitened is None and got[1, 1].deviation == 64**2 and got[1, 1].identity_error < 1e-12
    assert (got[5, 1].n, got[5, 1].deviation, got[5, 1].whitened, got[5, 1].explained, got[5, 1].identity_error) == (1, 0, None, None, None)
    assert got[3, 1].n == 3 and got[4, 1].deviation is None and got[3, 1].deviation is None


def test_deviations_are_exact():
    m = np.array([[1_000_001, 999_900], [1_000_000, 1_000_000]])
    held = whitening.deviations(m, 3, np.array([3_000_000, 3_000_001]))
    assert held.tolist() == [9 + 301**2, 1]
    far = whitening.deviations(m, 30_000_000, np.array([30_000_000 * 1_000_000, 30_000_000 * 1_000_000 - 1]))
    assert far.tolist() == [30_000_000**2 + (30_000_000 * -100 + 1) ** 2 if 30_000_000**2 + (30_000_000 * -100 + 1) ** 2 < 1 << 63 else None, 1]
    big = whitening.deviations(np.array([[1_000_000 + (1 << 31)]]), 1 << 20, np.array([5]))
    assert big.tolist() == [None]


@pytest.mark.parametrize("name", ["n_words", "part", "mask", "its"])
def test_clashing_names(spark, name):
    assert "items" in CLASHING
    docs = spark.createDataFrame([(1, "a b c", "en", "q"), (2, "a b c", "en", "q")], f"doc_id long, text string, lang string, {name} string")
    labels = spark.createDataFrame([(1, 1, 0, "q")], f"doc_id long, quality int, toxic int, {name} string")
    assert filter_audit.audit_documents(docs, labels).count() == 600 and minhash.link(docs).count() == 2
