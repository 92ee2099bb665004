import cases
import numpy as np
import pytest
from conftest import SF

from contestry.llm import near_copies, superminhash


def shingles(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def kept(rows):
    """Ids that stay, by comparing all pairs; rows are (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if b < a and 5 * common >= 4 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def planted():
    """Texts with copies of likeness 0.6 to 0.97, edited at one place or at several, and a passage many texts share."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, rows = word(40), []
    for size in (6, 12, 40, 90, 300):
        for _ in range(8):
            base = word(size) + (passage if rng.random() < 0.5 else [])
            rows.append(base)
            for share in (0.01, 0.03, 0.06, 0.1, 0.15, 0.25):
                copy, at = list(base), int(rng.integers(0, len(base)))
                for k in range(max(1, round(share * len(base)))):
                    copy[(at + k) % len(base) if rng.random() < 0.8 else int(rng.integers(0, len(base)))] = f"edit{rng.integers(0, 1 << 30)}"
                rows.append(copy)
    near = word(120)  # a large group: a chain of copies and copies of one text
    for i in range(60):
        near = near[:i] + [f"chain{i}"] + near[i + 1:]
        rows += [near, [*near, f"end{i}"]]
    order = rng.permutation(len(rows))
    return [(int(i), " ".join(rows[j]).title()) for i, j in enumerate(order)]


@pytest.mark.parametrize("tile, picked", [(1024, 500_000), (5, 1)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, tile, picked):
    monkeypatch.setattr(superminhash, "TILE", tile)
    monkeypatch.setattr(superminhash, "PICKED", picked)
    rows = planted()
    got = [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == len(set(got)) < len(rows) and set(got) == kept(rows)


def test_pipeline_stage_drops_copies_of_likeness_0_8(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()} == kept(planted())


def test_near_copies_odd_and_empty(spark):
    docs = cases.odd(spark)
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert ids == [(False, i) for i in (1, 3, 6, 7, 8, 9, 10, 10)] + [(True, 0)]
    assert near_copies.keep_one(cases.empty(spark)).count() == 0
