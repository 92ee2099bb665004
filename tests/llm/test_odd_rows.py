"""Odd rows: urls, licences, sketches, names with dots, and every pipeline stage."""

import cases
import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F

from contestry.llm import licenses, simhash, sketch, url_filter

PAGES = [
    (1, "http://redcasino.org/a", "<p>red casino</p>"), (1, "http://redcasino.org/a", "<p>red casino</p>"), (None, "http://greenhouse.org/b", "<p>green house</p>"),
    (2, None, "<p>green</p>"), (3, "", None), (4, "no scheme", "house"), (5, "http://" + "a" * 20_000 + ".org/" + "p/" * 20_000, "x"),
    (6, "HTTP://News.NET/fr/x", "w " * 50_000), (7, "://?q", "<script>casino</script>"), (8, "http://ñ世.org/\n/é", "\x00"),
]
DDL = "page_id long, url string, html string"


def test_pages_of_every_kind(spark):
    clash = ("host", "path", "n", "odds", "word", "key", "rule", "verdict", "tokens", "hot", "part")
    rows = spark.createDataFrame(PAGES, DDL).repartition(3)
    got = url_filter.judge(rows.withColumns({c: F.lit(c) for c in clash})).collect()
    assert sorted(map(str, got)) == sorted(map(str, url_filter.judge(rows).collect())) and len(got) == len(PAGES)
    by_id = {r.page_id: r for r in got}
    assert (by_id[None].host, by_id[None].path) == ("greenhouse.org", "/b") and sum(r.page_id == 1 for r in got) == 2
    assert all((by_id[i].host, by_id[i].path, by_id[i].rule) == ("", "", None) for i in (2, 3, 4)) and by_id[7].host == ""
    assert len(by_id[5].host) == 20_004 and len(by_id[5].path) == 40_001
    assert (by_id[6].host, by_id[6].rule, by_id[6].verdict) == ("news.net", "net/fr/", "block")
    assert all(r.verdict in ("allow", "block") and r.odds is not None for r in got) and by_id[1].verdict == "block"
    assert url_filter.judge(spark.createDataFrame([], DDL)).count() == 0


def test_licences_of_odd_texts(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [(1, None), (2, ""), (None, f"{notice}.\n"), (3, "word " * 200_000 + f"\n{notice}.\n"), (3, "word"), (4, f"{notice}.\n"), (4, f"{notice}.\n")]
    got = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, *r.licences) for r in got) == [(0, "Apache-2.0"), (1,), (2,), (3,), (3, "Apache-2.0"), (4, "Apache-2.0"), (4, "Apache-2.0")]
    assert licenses.licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_containment_without_a_hash_below_the_threshold():
    short = next(t for t in (f"one two three four five {i}" for i in range(99)) if sketch.stands_in(sketch.sketch(t)))
    whole = sketch.sketch(" ".join(f"a{i}" for i in range(900)) + " " + short)
    assert sketch.containment(sketch.sketch(short), whole) is None and sketch.containment(sketch.sketch(short), sketch.sketch(short)) == 1.0
    assert sketch.containment(whole, sketch.sketch(short)) == 0.0 and not sketch.stands_in(whole) and not sketch.stands_in(sketch.sketch(""))


def test_simhash_of_names_with_dots(spark):
    docs = cases.odd(spark).withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"})
    got = simhash.classes(docs, "doc.id", "the.text").select("doc_id", "fp", "component_id")
    want = simhash.classes(cases.odd(spark)).select("doc_id", "fp", "component_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    docs = cases.odd(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, cases.empty(spark), SF).count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == {r[0] for r in cases.ROWS} and all(r.length > 0 for r in rows)
        return
    assert out.columns == docs.columns and len(rows) <= len(cases.ROWS)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    assert all((r.doc_id, r.text) in given and r.fp == "fp" for r in rows)
    if name == "near_duplicates":
        assert len(rows) == len({" ".join((t or "").lower().split()) for _, t, *_ in cases.ROWS})
