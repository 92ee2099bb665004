import math
import re
from itertools import combinations

import cases
import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from contestry.llm import licenses, quality, risk_rules, url_filter


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def counts_of(row):
    return tuple(row._q[c] for c in (*risk_rules.BASE, "base_failed"))


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: counts_of(r) for r in risk_rules.measured(docs).select("doc_id", "_q").collect()} == {d: base_counts(t) for d, t in texts.items()}


def test_rules_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    docs = cases.odd(spark)
    rows = risk_rules.judge(docs, labels).collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0), base_counts(r.text)) for r in docs.collect())
    assert sorted(((r.doc_id is None, r.doc_id or 0), counts_of(r)) for r in rows) == want
    assert all(r._kept == (not r._q.base_failed) for r in rows)
    kept = risk_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r._kept for r in rows)
    assert risk_rules.judge(cases.empty(spark), labels).count() == 0
    assert risk_rules.keep_good(docs, labels.where("false")).count() == kept.count()


def test_tail_is_exact(spark):
    points = [(n, k, p) for n in (1, 50, 2000) for k in (0, 1, n // 50, n // 4) for p in (0.0125, 0.3)]
    frame = spark.createDataFrame(points, "n long, k long, p double")
    for r in frame.withColumn("tail", risk_rules._tail(F.col("n"), F.col("k"), F.col("p"))).collect():
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(r.p) + (r.n - i) * math.log1p(-r.p)) for i in range(r.k + 1))
        assert math.isclose(r.tail, exact, rel_tol=1e-8, abs_tol=1e-300)


def test_certified_cutoffs_hold_their_risk(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x), float(u), 0.0, 0.0) for x, u in zip(rng.exponential(0.15, 4000), rng.uniform(0, 0.5, 4000))] + [("b", 0.0, 0.0, 0.0, 0.0)] * 20
    good = spark.createDataFrame(rows, "stratum string, symbol_rate double, upper_rate double, repeat_rate double, dup_line_rate double")
    cuts = {r.stratum: r.cuts for r in risk_rules.certified(good, 2).collect()}
    assert "b" not in cuts  # too few labels certify nothing
    values = np.array([r[1] for r in rows[:4000]])
    assert (values > cuts["a"].symbol_rate).mean() <= 0.0125 < (values > 0.5).mean() and cuts["a"].upper_rate == 0.5 and cuts["a"].repeat_rate == 0.1


def test_quality_learns_and_calibrates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    ranks = np.mean([(g > b) + 0.5 * (g == b) for b in bad for g in good])
    assert ranks > 0.8 and np.mean(np.array(good) >= quality.LEVEL) > 0.97
    assert abs(np.mean([r.score for r in rows]) - len(good) / len(rows)) < 0.06


def test_isotonic_equals_best_monotone_fit():
    x, n, hits = np.arange(6.0), np.array([1, 2, 1, 3, 1, 1.0]), np.array([0, 2, 0, 1, 1, 0.0])
    knots, values = quality.isotonic(x, n, hits)
    best = min((sum(w * (h / w - v) ** 2 for w, h, v in zip(n, hits, levels)), levels) for levels in monotone(hits / n, n))[1]
    assert np.allclose(np.unique(values), np.unique(best)) and np.all(np.diff(knots) > 0)


def monotone(y, w):
    for k in range(len(y)):
        for cuts in combinations(range(1, len(y)), k):
            blocks = list(zip((0, *cuts), (*cuts, len(y))))
            levels = [np.average(y[a:b], weights=w[a:b]) for a, b in blocks]
            if all(p <= q + 1e-12 for p, q in zip(levels, levels[1:])):
                yield np.repeat(levels, [b - a for a, b in blocks]).tolist()


def test_quality_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (10, None), (None, 1), (8, 1)], "doc_id long, quality int")
    docs = cases.odd(spark)
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.scores(cases.empty(spark), labels).count() == 0
    assert {r.score for r in quality.scores(docs, labels.where("false")).collect()} == {1.0}


def test_segmenter_finds_the_cheapest_split():
    model = url_filter.Segmenter({"free": 50, "bets": 5, "be": 80, "ts": 2, "car": 30, "pet": 20, "carpet": 10, "s": 3})
    price = lambda words: sum(model.cost.get(w, model.unknown[len(w)]) for w in words)
    for text in ("freebets", "carpets", "xfreecar", "petsbe"):
        splits = [[text[a:b] for a, b in zip((0, *c), (*c, len(text)))] for k in range(len(text)) for c in combinations(range(1, len(text)), k)]
        assert math.isclose(price(model.split(text)), min(map(price, splits)))
    assert model.split("freebets") == ("free", "bets") and "".join(model.split("a" * 500)) == "a" * 500


URLS = [("https://Sub.Example.COM/en/1?x", "sub.example.com", "/en/1", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.net/es/2", "a.net", "/es/2", "net/es/", "block"), ("http://a.net/en/2", "a.net", "/en/2", None, None), ("http://shop.com", "shop.com", "", None, None),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("x://", "", "", None, None),
        ("http://h?x=http://y/z", "h", "", None, None), ("http://deep.www.example.com/en/a", "deep.www.example.com", "/en/a", "www.example.com/en/", "allow")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>free words here</p>") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ((verdict,) if verdict else ("allow", "block"))
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_model_blocks_unwanted_hosts(spark):
    from contestry.llm.common import QUERIES

    rows = QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.01").where("rule is null and host <> ''").collect()
    seeded = [r for r in rows if any(s in re.split(r"[^a-z]+", r.host) for s in url_filter.SEEDS)]
    assert seeded and all(r.verdict == "block" for r in seeded)
    others = [r for r in rows if r not in seeded]
    assert np.mean([r.verdict == "allow" for r in others]) > 0.95


MIT = "\n".join(["Copyright (c) 2020 A. Person", "", licenses.SENTENCES["mit-grant"] + ":", "", licenses.SENTENCES["mit-keep"] + ".", "", licenses.SENTENCES["mit-as-is"].replace("IMPLIED, ", "IMPLIED,\n") + "."])


@pytest.mark.parametrize("text, want", [
    ("", []), ("nothing here", []), ("Released under the MIT License.", ["MIT"]), ("Text.\nLicensed under CC BY-NC 4.0.\nMore text", ["CC-BY-NC-4.0"]), (MIT, ["MIT"]),
    ("# SPDX-License-Identifier: Apache-2.0", []), ("All rights reserved. All rights reserved.", ["All-rights-reserved"] * 2)])
def test_licence_sentences(text, want):
    if "SPDX" in text:
        want = ["Apache-2.0"]
    assert licenses.scan(text)[1] == want


def test_rules_are_reached_and_hinted():
    assert len(licenses.KNOWN) == len(licenses.SENTENCES)
    assert all(any(h in s.lower() for h in licenses.HINTS) for s in licenses.SENTENCES.values())
    for licence, rule in licenses.RULES:
        assert licenses.scan("\n\n".join(licenses.SENTENCES[r] + "." for r in rule))[1] == [licence]


def test_licences_odd_and_empty(spark):
    rows = licenses.licences(cases.odd(spark)).collect()
    assert len(rows) == len(cases.ROWS) and not any(r.licences for r in rows)
    assert licenses.licences(cases.empty(spark)).count() == 0


def test_pipeline_stages_compose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, [set(r.doc_id for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
        kept.append({r.doc_id for r in at.collect()})
        assert kept[-1] <= kept[-2]
    judged = {r.doc_id for r in risk_rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("_kept").collect()}
    assert kept[1] == judged and {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept[-1]
