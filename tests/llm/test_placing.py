import math
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
from conftest import SF

from contestry.llm import lbl, sharding


def test_sharding_odd(spark):
    docs = cases.odd(spark)
    rows = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharding.shard(cases.empty(spark)).count() == 0


def test_slots_and_growth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = sharding.shard(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_weights_share_and_confine(spark):
    keys = spark.range(60_000).withColumnRenamed("id", "k")
    tree = [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (2, 0, 1, 2.0), (3, 1, 2, 6.0)]
    heavier = [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (2, 0, 1, 4.0), (3, 1, 2, 6.0)]
    both = sharding.assign(sharding.assign(keys, "k", tree, "a"), "k", heavier, "b").groupBy("a", "b").count().collect()
    share = Counter()
    for r in both:
        share[r.a] += r["count"] / 60_000
    assert all(abs(share[s] - w / 12) < 0.01 for s, _, _, w in tree)
    # rows leave region 1 only for region 0, and inside region 0 only rack 1 gains from rack 0
    assert {(r.a, r.b) for r in both if r.a != r.b} <= {(3, 0), (3, 1), (3, 2), (0, 2), (1, 2)}
    grown = sharding.grown(sharding.regular_tree())
    moved = sharding.assign(sharding.assign(keys, "k", sharding.regular_tree(), "a"), "k", grown, "b").where("a <> b").select("b").distinct().collect()
    assert [r.b for r in moved] == [24]


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base(rows):
    train = Counter(t for r in rows if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 10 for t in tokens(r.text))
    total, distinct = sum(train.values()), len(train)
    out = []
    for r in rows:
        own = tokens(r.text)
        score = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        out.append(((r.doc_id is None, r.doc_id or 0), len(own), sum(train[t] > 0 for t in own), total, round(score, 6)))
    return sorted(out)


def rounded(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_model_beats_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lbl.scores(docs).collect()
    assert rounded(rows) == base(docs.collect())
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in rows)


def test_rare_words_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(lbl, "FREQUENT", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    wide = spark.createDataFrame(docs.collect(), docs.schema)
    want = {r.doc_id: r for r in lbl.scores(wide).collect()}
    assert rounded(want.values()) == base(docs.collect())


def test_odd_and_empty(spark):
    docs = cases.odd(spark)
    rows = lbl.scores(docs).collect()
    assert rounded(rows) == base(docs.collect()) and all(math.isfinite(r.score) for r in rows)
    assert lbl.scores(cases.empty(spark)).count() == 0
    alone = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert len({r.score for r in alone}) == 1


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    weights = lbl.Weights.shaped(rng.normal(0, 0.5, 2 * lbl.SYMBOLS * lbl.DIM + lbl.SYMBOLS + 2 * lbl.DIM ** 2))
    scorer = lbl.Scorer(weights)
    every = np.arange(lbl.SYMBOLS)
    for w2, w1 in ((0, 0), (5, 900), (lbl.SYMBOLS - 1, 3)):
        total = (10 ** scorer(np.full(lbl.SYMBOLS, w2), np.full(lbl.SYMBOLS, w1), every)).sum()
        assert abs(total - 1) < 1e-4
