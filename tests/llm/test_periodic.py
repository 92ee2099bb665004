import hashlib
import re
import zlib

import cases
import numpy as np
import pytest
from conftest import SF

from contestry.llm import periodic


def brute(words):
    """All runs, by trying every period at every place."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out)


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def expected(doc_id, text):
    words = changed(doc_id, split(text))
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, n, q = best or (None, None, None)
    return (doc_id, len(found), s, n, q, 1000 * n // q if best else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            base = [b"w%d" % x for x in rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 30)))]
            parts += (base * 12)[:int(rng.integers(1, 120))] if rng.random() < 0.7 else [b"x%d" % x for x in rng.integers(0, 3, int(rng.integers(0, 40)))]
        assert [tuple(r) for r in periodic.runs(parts).tolist()] == brute(parts)


def test_runs_of_nested_periods():
    inner = [b"a", b"b"] * 13 + [b"c"]
    for words in (inner * 4, [b"a"] * 100, [b"a"] * 23, [b"a"] * 24, inner * 3 + inner[:5], [b"x", *inner * 3, b"y"]):
        assert [tuple(r) for r in periodic.runs(words).tolist()] == brute(words)


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 300, 1025):
        values = rng.integers(0, 50, n).astype(np.int32)
        lo, hi = np.sort(rng.integers(0, n, (2, 400)), axis=0)
        assert periodic.Minima(values)(lo, hi).tolist() == [values[a:b + 1].min() for a, b in zip(lo, hi)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len(split(r.text)) <= 600}
    got = {r.doc_id: tuple(r) for r in periodic.op13_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    assert sum(r[1] > 0 for r in got.values()) > 5
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)


def test_odd_documents(spark):
    docs = cases.odd(spark)
    rows = periodic.periodic(docs).collect()
    assert len(rows) == len(cases.ROWS)
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 977)] and long.collapsed.split() == cases.LONG.split()[:977]
    for r in rows:
        if r.doc_id != 6 and not r.runs:
            assert r.collapsed in {" ".join(split(t)) for i, t, *_ in cases.ROWS if i == r.doc_id}
    edited = periodic.with_periods(docs)
    assert edited.columns == docs.columns
    want = sorted((str(i), " ".join(changed(i, split(t)))) for i, t, *_ in cases.ROWS)
    assert sorted((str(r.doc_id), " ".join(split(r.text))) for r in edited.collect()) == want
    assert periodic.periodic(cases.empty(spark)).count() == 0
