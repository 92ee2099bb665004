import pytest
from conftest import SF, by_key, close
from pyspark.sql import functions as F

from contestry.catalog import registry, streams  # noqa: F401 - registers the stream queries
from contestry.operators import chronology as ch, ratings
from contestry.sources.ledger import BucketTable, Ledger
from contestry.streaming import jobs
from oracle_check import compare


@pytest.mark.parametrize("name", ["q_stream_upsert", "q_incremental_index", "q_stream_stop", "q_stream_counts", "q_stream_entity_state", "q_stream_late_rows"])
def test_stream_equals_batch(spark, name):
    ok, note = compare(spark, SF, name, registry.QUERIES[name], registry.ORACLES[name])
    assert ok, note


def test_bucket_table_rewrites_touched_buckets_only(spark, tmp_path):
    table, ledger = BucketTable(spark, f"{tmp_path}/t", "k long, v long", ["k"], 16), Ledger(spark, f"{tmp_path}")
    most = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    first = table.stage({}, spark.range(500).selectExpr("id AS k", "id AS v"), most)
    ledger.commit(0, files=first)
    one = spark.createDataFrame([(7, 70), (None, 1)], "k long, v long")
    second = table.stage(first, one, most)
    assert {b for b in second if second[b] != first.get(b)} == set(table.touched(one)) and len(table.touched(one)) == 2
    assert ledger.read()["files"] == first and table.read(first).where("k = 7").first().v == 7
    ledger.commit(1, files=second)
    table.vacuum(second)
    assert table.read(ledger.read()["files"]).count() == 501 and table.read(second).where("k = 7").first().v == 70
    held = {p.parent for p in tmp_path.rglob("*.parquet")}
    assert len(held) == len(second)
    assert table.stage(second, one.where("k = 0"), most) == second
    assert BucketTable(spark, f"{tmp_path}/none", "k long", ["k"]).read({}).count() == 0


def test_upsert_applies_a_batch_once(spark, tmp_path):
    landing, base = f"{tmp_path}/in", f"{tmp_path}/run"
    sums = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v"))
    spark.createDataFrame([(1, 5), (2, 6)], "k long, v long").write.parquet(landing)
    run = lambda: {r.k: r.v for r in jobs.upsert(jobs.read_landed(spark, landing), base, ["k"], sums).collect()}
    assert run() == {1: 5, 2: 6}
    spark.createDataFrame([(2, 1), (3, 4)], "k long, v long").write.mode("append").parquet(landing)
    assert run() == {1: 5, 2: 7, 3: 4} == run()
    for name in ("1", ".1.crc"):
        (tmp_path / "run" / "checkpoint" / "commits" / name).unlink()  # as if the driver had died between the table's commit and the stream's: the batch is delivered again
    assert run() == {1: 5, 2: 7, 3: 4}


def test_counts_keep_few_folders(spark, tmp_path):
    landing, base = f"{tmp_path}/in", f"{tmp_path}/run"
    for n in range(4):
        spark.range(100).selectExpr("id % 3 AS k", "0 AS v").write.mode("append").parquet(landing)
        got = {r.k: r.n for r in jobs.stream_counts(jobs.read_landed(spark, landing), base, ["k"]).collect()}
        assert got == {0: 34 * (n + 1), 1: 33 * (n + 1), 2: 33 * (n + 1)}
    assert len(list((tmp_path / "run" / "table").glob("v-*"))) <= 4


def test_a_batch_writes_what_it_brings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "MERGE_RUNS", 4)
    landing, base = f"{tmp_path}/in", f"{tmp_path}/run"
    sums = lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v"))
    written, seen = 0, set()
    for n in range(9):
        spark.range(40).selectExpr(f"CASE WHEN id = 0 THEN 0 ELSE id + {n * 40} END AS k", "id + 1 AS v").coalesce(1).write.mode("append").parquet(landing)
        got = {r.k: r.v for r in jobs.upsert(jobs.read_landed(spark, landing), base, ["k"], sums, 4).collect()}
        assert got == {0: n + 1} | {i + m * 40: i + 1 for m in range(n + 1) for i in range(1, 40)}
        for folder in (tmp_path / "run" / "table").glob("v-*"):
            if folder.name not in seen:
                seen.add(folder.name)
                written += spark.read.parquet(str(folder)).count()
    assert written <= 9 * 40 * 2 and len(Ledger(spark, base).read()["runs"]) == 3


def form(out):
    return by_key(out.select("contest_id", "side", "games", "ema", "streak", "rest_days"), "contest_id", "side")


def test_entity_state_repairs_late_rows(spark, contests):
    valid = ch.valid_contests(contests)
    middle = valid.approxQuantile("ts", [0.5], 0.0)[0]
    late_id = valid.where(F.col("ts") < middle - 86_400 * 400).agg(F.max("contest_id")).first()[0]
    base, landing = jobs.fresh_base(spark, "state"), jobs.fresh_base(spark, "landing")
    run = lambda: jobs.stream_entity_state(ch.side_long(jobs.read_landed(spark, landing)), base)
    columns = ["contest_id", "ts", "a_id", "b_id", "a_win"]
    batch = ch.entity_form(valid).select("contest_id", "side", F.col("games_before").alias("games"), F.col("ema_form").alias("ema"), "streak", "rest_days")
    valid.where((F.col("ts") < middle) & (F.col("contest_id") != late_id)).select(*columns).write.parquet(landing)
    run()
    valid.where((F.col("ts") >= middle) | (F.col("contest_id") == late_id)).select(*columns).write.mode("append").parquet(landing)
    out = run()
    assert {r.contest_id for r in out.where("late = 1").collect()} == {late_id}
    close(form(out), form(batch))
    rated = spark.read.parquet(f"{base}/log").groupBy("batch").count().collect()
    valid.where(F.col("ts") >= middle).limit(20).select(*columns).write.mode("append").parquet(landing)  # delivered again
    close(form(run()), form(batch))
    assert len(rated) == 2 and spark.read.parquet(f"{base}/log").where("batch = 1").count() < 2 * valid.count()


def test_period_rating_continues_from_stored_state(spark, contests):
    columns = ["contest_id", "ts", "pool", "a_id", "b_id", "a_win"]
    rows = ch.valid_contests(contests).select(*columns)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    base, landing = jobs.fresh_base(spark, "rating"), jobs.fresh_base(spark, "landing")
    day = F.floor(F.col("ts") / 86_400)
    cuts, seen = [low + (high - low) * k // 3 for k in range(4)], 0
    for n in range(3):
        part = rows.where((F.col("ts") >= cuts[n]) & ((F.col("ts") < cuts[n + 1]) | F.lit(n == 2)))
        part.write.mode("append").parquet(landing)
        out = jobs.stream_period_rating(jobs.read_landed(spark, landing), base)
        rated = spark.read.parquet(f"{base}/history").groupBy("batch").count().collect()
        assert len(rated) == n + 1  # what was rated before is not rated again
    closed = Ledger(spark, base).read()["closed"]
    keys = ("day", "entity_id", "rating_before")
    batch = ratings.glicko_history(ratings.glicko_timeline(rows.where(day <= closed)))
    close(by_key(out, "day", "entity_id"), by_key(batch, "day", "entity_id"))
    assert closed == high // 86_400 - 1 and set(keys) <= set(out.columns)
    late = rows.limit(3)
    late.write.mode("append").parquet(landing)
    assert jobs.stream_period_rating(jobs.read_landed(spark, landing), base).count() == out.count()
    assert jobs.late_contests(spark, base).count() == 3 == Ledger(spark, base).read()["late"]
