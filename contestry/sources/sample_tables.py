"""Shape the order / line-item / event sample tables as contests, members and snapshots.

Every contest is one order, every member row one order line, so the facts need no
shuffle of their own: pools are runs of ten neighbouring customers and both sides of a
contest come from the same pool. The expressions are plain SQL text that Spark and the
oracle engine both understand; only day arithmetic differs (``{days}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SPARK_DAYS = "CAST(datediff(CAST({0} AS DATE), DATE '1970-01-01') AS BIGINT)"
DUCK_DAYS = "date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))"

ORDER_COLUMNS = [
    "o_orderkey AS contest_id",
    "{days} * 86400 + (o_orderkey % 8) * 10800 AS ts",
    "CAST(year(o_orderdate) AS BIGINT) AS era",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'premium' WHEN '2-HIGH' THEN 'professional' "
    "WHEN '3-MEDIUM' THEN 'amateur' WHEN '4-NOT SPECIFIED' THEN 'excluded' ELSE 'other' END AS tier",
    "CAST(FLOOR(o_custkey / 10) AS BIGINT) AS pool",
    "o_custkey + 1 AS a_id",
    "CAST(FLOOR(o_custkey / 10) AS BIGINT) * 10 + ((o_custkey * 7 + o_orderkey * 3) % 10) + 1 AS b_id",
    "CAST(FLOOR(o_totalprice) AS BIGINT) AS price",
    "o_orderstatus AS status",
]

CONTEST_COLUMNS = [
    "contest_id", "ts", "era", "tier", "pool",
    "pool % 25 AS league_id",
    "a_id", "b_id",
    "CAST(CASE WHEN (price % 40) * 2 < 40 + 3 * (a_id - b_id) THEN 1 ELSE 0 END AS BIGINT) AS a_win",
    "CASE WHEN contest_id % 50 = 0 THEN NULL ELSE 1200 + price % 2400 END AS duration",
    "CASE WHEN contest_id % 7 = 0 THEN NULL ELSE (price % 9) * 100 END AS first_blood_time",
    "CASE WHEN status = 'P' THEN NULL ELSE (pool * 100 + ((least(a_id, b_id) - 1) % 10) * 10 "
    "+ (greatest(a_id, b_id) - 1) % 10) * 100 + CAST(FLOOR((era - 1990) / 2) AS BIGINT) END AS series_id",
    "(a_id + b_id) % 2 AS series_type",
    "CAST(CASE WHEN status = 'F' THEN 1 ELSE 0 END AS BIGINT) AS detailed",
]

LINE_COLUMNS = [
    "l_orderkey AS contest_id",
    "CAST((l_linenumber + 1) % 2 AS BIGINT) AS side",
    "CAST(CASE WHEN l_linenumber % 2 = 1 THEN FLOOR(l_linenumber / 2) ELSE 127 + l_linenumber / 2 END AS BIGINT) + 256 * ord AS slot",
    "l_suppkey % 5 + 5 * ((l_linenumber + 1) % 2) + 1 AS seat",
    "l_partkey % 40 + 1 AS item_id",
    "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS BIGINT) AS is_pick",
    "CAST(l_quantity AS BIGINT) AS q",
    "CAST(FLOOR(l_extendedprice) AS BIGINT) AS p",
    "CAST(ROUND(l_discount * 100) AS BIGINT) AS d",
    "CAST(ROUND(l_tax * 100) AS BIGINT) AS x",
]

MEMBER_COLUMNS = [
    "contest_id", "ts", "era", "pool", "tier", "series_id", "duration", "a_win", "side", "slot",
    "CASE WHEN side = 0 THEN a_id ELSE b_id END AS entity_id",
    "CASE WHEN side = 0 THEN a_win ELSE 1 - a_win END AS won",
    "pool * 10 + seat AS member_id",
    "item_id", "is_pick",
    "q % 15 AS kills", "d AS deaths", "p % 20 AS assists", "p % 600 AS last_hits",
    "CASE WHEN q % 11 = 0 THEN NULL ELSE q % 12 END AS denies",
    "250 + p % 500 AS gold_per_min", "300 + p % 450 AS xp_per_min",
    "q % 4 AS tower_kills", "x % 2 AS roshan_kills",
    "(d * 10 + 5) / 100.0E0 AS teamfight", "x AS wards", "p % 6 AS camps_stacked", "q % 9 AS runes",
    "CAST(CASE WHEN q % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS first_blood",
    "(p % 1000) / 10.0E0 AS stuns", "x % 3 AS smokes", "q % 7 AS madstones",
    "CASE WHEN q % 5 = 0 THEN NULL ELSE x % 4 END AS watchers",
    "d % 3 AS lotuses", "(q + x) % 2 AS tormentors", "p % 2 AS courier_kills",
    "1 + p % 3 AS lane_role",
]

SECONDS_SPARK = SPARK_DAYS + " * 86400 + hour({0}) * 3600 + minute({0}) * 60 + second({0})"
SECONDS_DUCK = DUCK_DAYS + " * 86400 + hour({0}) * 3600 + minute({0}) * 60 + second({0})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests_from_orders(orders: DataFrame) -> DataFrame:
    days = SPARK_DAYS.format("o_orderdate")
    return orders.selectExpr(*[c.format(days=days) for c in ORDER_COLUMNS]).selectExpr(*CONTEST_COLUMNS)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contests_from_orders(table(spark, sf_dir, "orders"))


#: Order lines of a task at most, on average, and what is worth a task of its own.
TASK_LINES, LEAST_LINES = 200_000, 20_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the order lines, by their number.

    The lines are sorted by contest for windows, joins and groups. Wide rows of small numbers compress well, so partitions
    that are put together by their compressed bytes would take memory many times that.
    """
    rows = table(spark, sf_dir, "lineitem").count()
    return max(1, -(-rows // TASK_LINES), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_LINES)))


LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


def lines(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """Every order line, keyed by (contest_id, slot): repeats of a line number are told apart by an ordinal.

    Only lines that are equal in every column can swap ordinals, so the result does not depend on the reading.
    The lines of a contest are in one of ``tasks`` partitions.
    """
    again = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.desc(c) for c in LINE_ORDER])
    return table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey").withColumn("ord", (F.row_number().over(again) - 1).cast("long")).selectExpr(*LINE_COLUMNS)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its contest, both dealt by contest once for all steps that follow by contest."""
    tasks = line_tasks(spark, sf_dir)
    dealt = contests_from_orders(table(spark, sf_dir, "orders").repartition(tasks, "o_orderkey"))
    return lines(spark, sf_dir, tasks).join(dealt, "contest_id").selectExpr(*MEMBER_COLUMNS)


def picks_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select(
        "contest_id", "era", "side", "slot", "entity_id", "won", "item_id", "is_pick")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = SPARK_DAYS.format("ts") + " * 86400"
    k = F.from_json("props", "k LONG")["k"]
    return (
        table(spark, sf_dir, "events")
        .select(F.expr(day).alias("collected_at"), (k % 20 + 1).alias("item_id"),
                (F.col("user_id") % 8 + 1).alias("bracket"),
                F.col("event_type").isin("purchase", "signup").cast("long").alias("w"))
        .groupBy("collected_at", "item_id", "bracket")
        .agg(F.count("*").alias("picks"), F.sum("w").alias("wins"))
    )


def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated-style rows ``(canonical_key, source_ids)`` with ids joined by ``|``, at most three each."""
    seat = F.floor((F.col("c_custkey") % 10) / 3)
    grouped = table(spark, sf_dir, "customer").groupBy(
        F.floor(F.col("c_custkey") / 10).alias("g"), seat.alias("s")
    ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("c_custkey") + 1)),
                                   lambda v: v.cast("string")), "|").alias("source_ids"))
    return grouped.select(F.concat_ws("-", F.lit("e"), "g", "s").alias("canonical_key"), "source_ids")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        contests(spark, sf_dir).select("league_id", "era").distinct()
        .select("league_id", "era",
                F.concat(F.col("era").cast("string"), F.lit("-07-01")).alias("event_start"),
                F.concat(F.col("era").cast("string"), F.lit("-08-31")).alias("event_end"))
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    z = F.log1p(F.col("n_chars").cast("double"))
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("y"),
        (1 / (1 + F.exp(-(z - 4.0)))).alias("p1"),
        (1 / (1 + F.exp(-(z - 5.0 - F.col("toxic"))))).alias("p2"))


def _duck(columns: list[str], source: str, days: str = "") -> str:
    return "SELECT " + ", ".join(c.format(days=days) if "{days}" in c else c for c in columns) + " FROM " + source


SQL_CONTESTS = (
    "o0 AS (" + _duck(ORDER_COLUMNS, "orders", DUCK_DAYS.format("o_orderdate")) + "),\n"
    "contests AS (" + _duck(CONTEST_COLUMNS, "o0") + ")"
)
SQL_VALID = SQL_CONTESTS + ",\nvalid AS (SELECT * FROM contests WHERE a_id > 0 AND b_id > 0 AND a_id <> b_id)"
SQL_MEMBERS = (
    SQL_CONTESTS + ",\nl0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(f"{c} DESC" for c in LINE_ORDER) + ") - 1 AS ord FROM lineitem),\n"
    "lines AS (" + _duck(LINE_COLUMNS, "l0") + "),\n"
    "members AS (" + _duck(MEMBER_COLUMNS, "lines JOIN contests USING (contest_id)") + ")"
)
SQL_SNAPSHOTS = (
    "snapshots AS (SELECT " + DUCK_DAYS.format("ts") + " * 86400 AS collected_at, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 + 1 AS item_id, user_id % 8 + 1 AS bracket, "
    "count(*) AS picks, CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS wins "
    "FROM events GROUP BY 1, 2, 3)"
)
SQL_ALIASES = (
    "alias_of AS (SELECT c_custkey + 1 AS id, min(c_custkey + 1) OVER (PARTITION BY CAST(FLOOR(c_custkey / 10) AS BIGINT), "
    "CAST(FLOOR((c_custkey % 10) / 3) AS BIGINT)) AS canonical FROM customer)"
)
SQL_PROBABILITIES = (
    "probs AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, 1 / (1 + exp(-(ln(1 + n_chars) - 4.0))) AS p1, "
    "1 / (1 + exp(-(ln(1 + n_chars) - 5.0 - toxic))) AS p2 FROM labels JOIN documents USING (doc_id))"
)
