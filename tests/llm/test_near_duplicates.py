from collections import Counter

import cases
import numpy as np
import pytest
import xxhash
from conftest import SF

from contestry.llm import simhash, sketch


def fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    """Class representative of every value, by comparing all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    of = classes(p for _, p in prints)
    low = {}
    for doc, p in prints:
        if doc is not None:
            low[of[p]] = min(doc, low.get(of[p], doc))
    return Counter((doc, f"{p:016x}", low.get(of[p])) for doc, p in prints)


def found(docs):
    return Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.classes(docs).collect())


def test_classes_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == expected(docs.collect())


def test_odd_documents(spark):
    docs = cases.odd(spark)
    assert found(docs) == expected(docs.collect())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(6) == 1 and len(ids) == len({x[1] for x in expected(docs.collect())})


def test_empty_table(spark):
    assert simhash.classes(cases.empty(spark)).count() == 0 and simhash.keep_one(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [2, 7, 2048])
def test_links_connect_what_is_close(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.integers(0, 1 << 63, 6)
    values = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(40):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False)))
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    pairs = [(r.a, r.b) for r in simhash.links(frame, "v").collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = classes(values)
    labels = {r.node: r.label for r in simhash.components(simhash.links(frame, "v"), "a", "b").collect()}
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(labels.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({labels.get(v, v) for v in values})


def test_sketch_likeness_follows_shingles():
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"a{i}" for i in range(2000)) + " " + " ".join(f"b{i}" for i in range(2000))
    x, y = sketch.sketch(a), sketch.sketch(b)
    assert abs(sketch.likeness(x, y) - 1996 / (2 * 3996 - 1996)) < 0.06
    part = sketch.sketch(" ".join(f"a{i}" for i in range(500)))
    assert sketch.containment(part, x) == 1.0 and sketch.likeness(x, x) == 1.0
    left, right = sketch.sketch(" ".join(a.split()[:2004])), sketch.sketch(" ".join(a.split()[2000:]))
    assert np.array_equal(sketch.merged(left, right), x)


def compare_next(rows):
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    out = Counter()
    import hashlib

    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own = sketch.sketch(text)
        out[(r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.written(own), sketch.written(sketch.sketch(edited)),
             sketch.likeness(own, sketch.sketch(edited)), sketch.likeness(own, sketch.sketch(after)))] += 1
    return out


@pytest.mark.parametrize("rows_per_bucket", [30, 4000])
def test_compared_equals_brute_force(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", rows_per_bucket)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, sketch.compared(docs).collect())) == compare_next(docs.collect())


def test_compared_odd_and_empty(spark):
    docs = cases.odd(spark)
    got = sketch.compared(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1 and {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert sketch.compared(cases.empty(spark)).count() == 0
    one = sketch.compared(spark.createDataFrame(cases.ROWS[:1], cases.SCHEMA)).first()
    assert one.near_next == 1.0
