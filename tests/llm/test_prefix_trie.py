import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from contestry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def rebuilt(rows):
    of = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in of.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = Counter()
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = lambda p: [q for q in below if len(q) == len(p) + 1 and q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(conversations[c]) == len(path)))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out[min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids(path)), sum(not kids(p) for p in below), saved,
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def query(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(prefix_trie, "table", lambda *_: df)
    return Counter(tuple(r) for r in prefix_trie.op12_trie(spark, "").collect())


@pytest.fixture
def parted(spark):
    """Many small partitions, which are not put together."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, kinds, convs", [(0, 1, 60), (1, 2, 90), (2, 3, 40), (3, 40, 30), (4, 1, 5)])
def test_trie_equals_brute_force(spark, monkeypatch, parted, seed, kinds, convs):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for turn in range(int(rng.integers(1, 14))):
            x = int(rng.integers(0, kinds))
            rows.append((c, turn, ("user", "assistant")[turn % 2], "é" * x + f"text {x}", "n"))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    monkeypatch.setattr(prefix_trie, "SPINES", 200_000 if seed % 2 else 0)
    assert query(spark, monkeypatch, rows) == brute(rebuilt(rows))


def test_copies_fill_several_partitions(spark, monkeypatch, parted):
    rows = [(c, t, "user", f"same {t}", "n") for c in range(0, 300) for t in range(3 if c % 7 else 5)]
    assert query(spark, monkeypatch, rows) == brute(rebuilt(rows))


def test_odd_rows(spark, monkeypatch, parted):
    rows = [(1, None, None, None, "x"), (1, None, "user", None, "x"), (1, 2, None, "b", "x"), (1, 2, None, "b", "x"), (None, 1, "user", "lost", "x"), (13, 0, "user", "only", "x"),
            (5, 1, "user", "", "x"), (6, 1, "user", "é" * 100_000, "x"), (1_000_000_007, 0, "u", "ser", "x"), (1_000_000_008, 0, "us", "er", "x"), (-3, 0, "user", "neg", "x"), (-4, 0, "user", "neg", "x")]
    mine = [r for r in rows if r[0] is None or r[0] >= 0]
    assert query(spark, monkeypatch, mine) == brute(rebuilt(mine))
    assert sum(query(spark, monkeypatch, rows).values()) > 0
    assert query(spark, monkeypatch, []) == Counter()


def test_long_copies(spark, monkeypatch, parted):
    turns = [(c, t, "user", f"t{t}", "n") for c in range(0, 40, 5) for t in range(60 + c % 3)]
    assert query(spark, monkeypatch, turns) == brute(rebuilt(turns))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in prefix_trie.op12_trie(spark, SF).collect()) == brute(rebuilt(rows))
