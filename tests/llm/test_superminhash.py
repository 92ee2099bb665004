from collections import Counter

import cases
import numpy as np
import pytest
from conftest import SF
from test_near_copies import planted

from contestry.llm import superminhash
from contestry.llm.superminhash import SLOTS, shingles, signature


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set()


def expected(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs; rows are (doc_id, text)."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return Counter((doc, len(s), low.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def found(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in superminhash.classes(docs).collect())


def slow_signature(hashes):
    """One shingle after the other, each with its whole permutation."""
    best = [(1 << 64) - 1] * SLOTS
    for h in hashes.tolist():
        order = list(range(SLOTS))
        for j in range(SLOTS):
            x = int(superminhash.mixed(np.array([(h + (j + 1) * superminhash.GOLDEN) % (1 << 64)], np.uint64))[0])
            k = j + ((x >> 32) * (SLOTS - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << 32 | x & 0xFFFFFFFF)
    return best


@pytest.mark.parametrize("n, chunk", [(1, 4096), (3, 4096), (60, 4096), (700, 64)])
def test_signature_equals_whole_permutations(monkeypatch, n, chunk):
    monkeypatch.setattr(superminhash, "CHUNK", chunk)
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    assert signature(hashes).tolist() == slow_signature(hashes)


def test_estimates_vary_less_than_independent_hashes():
    rng, errors = np.random.default_rng(7), []
    for _ in range(150):
        a = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        b = np.concatenate([a[:48], rng.integers(0, 1 << 63, 12).astype(np.uint64)])
        errors.append((signature(a) == signature(b)).mean() - 48 / 72)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * (2 / 3) * (1 / 3) / SLOTS


def test_shingles_are_distinct_sets():
    for text in ("", " \n", "a", "A b", "a b c", "a b c a b c a", "Ä b \x0b c d"):
        assert len(shingles(text.encode(), 3)) == len(grams(text))
    assert (shingles(b"x Y z q", 3) == shingles(b"X y\tZ  q", 3)).all()


@pytest.mark.parametrize("tile, picked", [(1024, 500_000), (4, 0)])
def test_classes_equal_all_pairs(spark, monkeypatch, tile, picked):
    monkeypatch.setattr(superminhash, "TILE", tile)
    monkeypatch.setattr(superminhash, "PICKED", picked)
    rows = planted()
    rows += [(10_000 + i, rows[i % 7][1]) for i in range(30)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = superminhash.op11_superminhash(spark, SF).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected([tuple(r) for r in docs])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(not r.kept for r in got) > 0


def test_odd_and_empty_documents(spark):
    assert found(cases.odd(spark)) == expected([r[:2] for r in cases.ROWS])
    assert found(cases.empty(spark)) == Counter()
