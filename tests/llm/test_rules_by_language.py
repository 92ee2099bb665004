from contestry.llm import risk_rules


def test_every_language_keeps_its_own_cutoffs(spark):
    """80 languages of 200 clean labelled texts; one of 5 labelled texts, and one without labels, have many symbols."""
    plain, marked = (" ".join(f"word{i}{end}" for i in range(12)) for end in ("", "##"))
    rows = [(80 * i + k, plain, f"l{k:02}") for i in range(200) for k in range(80)]
    rows += [(20_000 + i, marked, "zz") for i in range(40)] + [(30_000 + i, marked, "unlabelled") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(16_000), *range(20_000, 20_005)]], "doc_id long, quality int")
    judged = risk_rules.judge(docs, labels).where("lang in ('zz', 'unlabelled')").collect()
    assert len(judged) == 45 and all(r._kept for r in judged)
    assert risk_rules.keep_good(docs, labels).count() == len(rows)
