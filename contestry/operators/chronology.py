"""Leak-free chronological features: every value describes the state before the contest.

Input ``contests``: contest_id, ts (epoch seconds), era, series_id, a_id, b_id, a_win. The event
order is (ts, contest_id) throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestry.functions.rates import smoothed_rate
from contestry.operators import hot

DAY = 86_400
ORDER = ["ts", "contest_id"]
EMA_STEP = 0.15
EMA_CHUNK = 128


def valid_contests(contests: DataFrame, since: int | None = None) -> DataFrame:
    kept = contests.where("a_id IS NOT NULL AND b_id IS NOT NULL AND a_id > 0 AND b_id > 0 AND a_id <> b_id")
    return kept if since is None else kept.where(F.col("ts") >= since)


def side_long(contests: DataFrame, *keep: str) -> DataFrame:
    """Two rows per contest, one from each side's point of view."""
    def view(side, own, other, won):
        return F.struct(F.lit(side).cast("long").alias("side"), F.col(own).alias("entity_id"),
                        F.col(other).alias("opponent_id"), won.cast("long").alias("won"))

    both = F.array(view(0, "a_id", "b_id", F.col("a_win")), view(1, "b_id", "a_id", 1 - F.col("a_win")))
    carried = ["contest_id", "ts", *[k for k in keep if k not in ("contest_id", "ts")]]
    return contests.select(*carried, F.explode(both).alias("v")).select(*carried, "v.*")


def entity_form(contests: DataFrame, hot_rows: int | None = hot.HOT_ROWS) -> DataFrame:
    """Per (contest, side): games_before, recent_5, recent_10, ema_form, streak, rest_days.

    One shuffle by entity serves all of them. Running frames only: no frame is longer than ten
    rows and no per-row array is built. Hot entities are sliced and their earlier slices carried.
    """
    rows = side_long(contests)
    s = sliced = hot.slice_hot_keys(rows, ["entity_id"], ORDER, hot_rows)
    part = ["entity_id", hot.SLICE]
    w = Window.partitionBy(*part).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rn", F.row_number().over(w))
    s = s.select(
        "*",
        (F.col("rn") - 1).alias("g"),
        F.coalesce(F.sum("won").over(w.rowsBetween(-5, -1)), F.lit(0)).alias("w5"),
        F.coalesce(F.sum("won").over(w.rowsBetween(-10, -1)), F.lit(0)).alias("w10"),
        F.lag("won").over(w).alias("prev"),
        F.lag("ts").over(w).alias("prev_ts"),
        F.last(F.when(F.col("won") == 0, F.col("rn")), True).over(so_far).alias("loss_at"),
        F.last(F.when(F.col("won") == 1, F.col("rn")), True).over(so_far).alias("win_at"),
        F.floor((F.col("rn") - 1) / EMA_CHUNK).alias("chunk"),
        ((F.col("rn") - 1) % EMA_CHUNK).alias("pos"),
    )
    # Exponential average in chunks of EMA_CHUNK rows: inside a chunk a running sum of scaled
    # terms; between chunks the end value of the last chunk (two levels reach 0.85 ** 256).
    decay = 1.0 - EMA_STEP
    chunk_w = Window.partitionBy(*part, "chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("scaled", F.sum(F.lit(EMA_STEP) * F.col("won") * F.pow(F.lit(decay), -F.col("pos"))).over(chunk_w))
    ends = F.when(F.col("pos") == EMA_CHUNK - 1, F.col("scaled") * F.pow(F.lit(decay), F.col("pos")))
    s = s.withColumn("prev_end", F.coalesce(F.last(ends, True).over(so_far), F.lit(0.0)))
    full = F.when(F.col("pos") == EMA_CHUNK - 1,
                  F.col("scaled") * F.pow(F.lit(decay), F.col("pos")) + F.lit(decay ** EMA_CHUNK) * F.col("prev_end"))
    s = s.withColumn("start", F.coalesce(F.last(full, True).over(so_far), F.lit(0.0)))
    own = F.lit(EMA_STEP) * F.col("won") * F.pow(F.lit(decay), -F.col("pos"))
    s = s.withColumn("ema_local", (F.col("scaled") - own) * F.pow(F.lit(decay), F.col("pos") - 1)
                     + F.col("start") * F.pow(F.lit(decay), F.col("pos")))

    carry = _form_carry(hot.hot_slices(sliced))
    j = hot.attach_carry(s, carry, ["entity_id"])
    before = F.coalesce(F.col("c_games"), F.lit(0))
    games = F.col("g") + before

    def recent(size: int, local: Column) -> Column:
        missing = F.least(F.lit(size) - F.col("g"), before)
        older = F.when((F.col("c_games") > 0) & (missing > 0), F.aggregate(
            F.slice("c_last", -missing.cast("int"), missing.cast("int")), F.lit(0).cast("long"), lambda a, v: a + v))
        return smoothed_rate(local + F.coalesce(older, F.lit(0)), F.least(games, F.lit(size)), 6.0)

    last_loss = F.greatest(F.coalesce(F.col("loss_at") + before, F.lit(0)), F.coalesce(F.col("c_loss_at"), F.lit(0)))
    last_win = F.greatest(F.coalesce(F.col("win_at") + before, F.lit(0)), F.coalesce(F.col("c_win_at"), F.lit(0)))
    previous = F.coalesce(F.col("prev"), F.when(F.col("g") == 0, F.element_at("c_last", -1)))
    streak = F.when(games == 0, 0).when(previous == 1, games - last_loss).otherwise(last_win - games)
    prev_ts = F.coalesce(F.col("prev_ts"), F.when(F.col("g") == 0, F.col("c_ts")))
    rest = F.when(prev_ts.isNull(), 30.0).otherwise(
        F.least(F.lit(30.0), F.greatest(F.lit(0.0), (F.col("ts") - prev_ts) / DAY)))
    return j.select(
        "contest_id", "ts", "side", "entity_id",
        games.cast("long").alias("games_before"),
        recent(5, F.col("w5")).alias("recent_5"),
        recent(10, F.col("w10")).alias("recent_10"),
        (F.col("ema_local") + F.pow(F.lit(decay), F.col("g")) * F.coalesce(F.col("c_ema"), F.lit(0.5))).alias("ema_form"),
        streak.cast("long").alias("streak"),
        rest.alias("rest_days"),
    )


def _form_carry(sliced: DataFrame) -> DataFrame:
    """State of a hot entity at the start of each of its slices, from one row per slice.

    The average forgets: rows more than 300 back in a slice, and slices more than 200 back, weigh less than 1e-14
    and are left out of it.
    """
    w = Window.partitionBy("entity_id", hot.SLICE).orderBy(F.desc("ts"), F.desc("contest_id"))
    asc = Window.partitionBy("entity_id", hot.SLICE).orderBy(*ORDER)
    r = sliced.withColumn("back", F.row_number().over(w)).withColumn("rn", F.row_number().over(asc))
    decay = 1.0 - EMA_STEP
    per_slice = r.groupBy("entity_id", hot.SLICE).agg(
        F.count("*").alias("n"),
        F.max("ts").alias("ts"),
        F.reverse(F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= 10, F.struct("back", "won")))),
                              lambda v: v["won"])).alias("tail"),
        F.max(F.when(F.col("won") == 0, F.col("rn"))).alias("loss_at"),
        F.max(F.when(F.col("won") == 1, F.col("rn"))).alias("win_at"),
        F.sum(F.when(F.col("back") <= 300, F.lit(EMA_STEP) * F.col("won") * F.pow(F.lit(decay), F.col("back") - 1))).alias("ema"),
    )
    before = Window.partitionBy("entity_id").orderBy(hot.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    short = Window.partitionBy("entity_id").orderBy(hot.SLICE)
    with_start = per_slice.withColumn("c_games", F.coalesce(F.sum("n").over(before), F.lit(0)))
    fold = F.aggregate(
        F.collect_list(F.struct("n", "ema")).over(short.rowsBetween(-200, -1)), F.lit(0.5),
        lambda acc, v: v["ema"] + F.pow(F.lit(decay), v["n"]) * acc)
    return with_start.select(
        "entity_id", hot.SLICE, "c_games",
        F.flatten(F.collect_list("tail").over(short.rowsBetween(-10, -1))).alias("c_last"),
        F.max("ts").over(before).alias("c_ts"),
        F.max(F.col("loss_at") + F.col("c_games")).over(before).alias("c_loss_at"),
        F.max(F.col("win_at") + F.col("c_games")).over(before).alias("c_win_at"),
        fold.alias("c_ema"),
    )


def activity(contests: DataFrame, days: int = 30, hot_rows: int | None = hot.HOT_ROWS) -> DataFrame:
    """Earlier contests of the entity with ts >= now - days, equal times broken by id.

    Each contest enters as +1 and expires as -1 just after ``ts + days``; a running sum replaces
    the range frame, whose cost per row would grow with the number of rows in it.
    """
    rows = side_long(contests)
    step = F.array(
        F.struct(F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("change")),
        F.struct((F.col("ts") + days * DAY).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("change")))
    steps = rows.select("contest_id", "side", "entity_id", F.explode(step).alias("s")).select(
        "contest_id", "side", "entity_id", "s.*")
    summed = hot.prefix_sums(steps, ["entity_id"], ["at", "kind", "contest_id", "side"],
                             {"activity": F.col("change")}, hot_rows)
    return summed.where("kind = 0").select("contest_id", "side", "entity_id", F.col("activity").cast("long").alias("activity"))


def era_form(contests: DataFrame, hot_rows: int | None = hot.HOT_ROWS) -> DataFrame:
    rows = side_long(contests, "era").withColumn("era", F.coalesce(F.col("era"), F.lit(0)))
    s = hot.prefix_sums(rows, ["entity_id", "era"], ORDER,
                        {"era_games": F.lit(1), "era_wins": F.col("won")}, hot_rows)
    return s.select("contest_id", "side", "entity_id", "era_games",
                    smoothed_rate(F.col("era_wins"), F.col("era_games"), 10.0).alias("era_rate"))


def head_to_head(contests: DataFrame, hot_rows: int | None = hot.HOT_ROWS) -> DataFrame:
    """Earlier results of the unordered pair, read from side a."""
    pairs = contests.select(
        "contest_id", "ts", "a_id", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"),
        F.when(F.col("a_id") <= F.col("b_id"), F.col("a_win")).otherwise(1 - F.col("a_win")).alias("lo_win"))
    s = hot.prefix_sums(pairs, ["lo", "hi"], ORDER,
                        {"pair_games": F.lit(1), "pair_wins": F.col("lo_win")}, hot_rows)
    first = smoothed_rate(F.col("pair_wins"), F.col("pair_games"), 8.0)
    return s.select("contest_id", "pair_games",
                    (F.when(F.col("a_id") == F.col("lo"), first).otherwise(1 - first) - 0.5).alias("h2h_advantage"))


def series_score(contests: DataFrame, hot_rows: int | None = hot.HOT_ROWS) -> DataFrame:
    """Wins of either side so far inside (series, pair); series 0 or null scores nothing."""
    in_series = F.coalesce(F.col("series_id"), F.lit(0)) != 0
    rows = contests.where(in_series).select(
        "contest_id", "ts", "series_id", "a_id", F.least("a_id", "b_id").alias("lo"),
        F.greatest("a_id", "b_id").alias("hi"),
        F.when(F.col("a_id") <= F.col("b_id"), F.col("a_win")).otherwise(1 - F.col("a_win")).alias("lo_win"))
    s = hot.prefix_sums(rows, ["series_id", "lo", "hi"], ORDER,
                        {"n": F.lit(1), "w": F.col("lo_win")}, hot_rows)
    difference = 2 * F.col("w") - F.col("n")
    return s.select("contest_id",
                    F.when(F.col("a_id") == F.col("lo"), difference).otherwise(-difference).cast("long").alias("series_difference"),
                    F.col("n").cast("long").alias("series_played"))


def global_side_rate(contests: DataFrame, size: int = 500, bucket: int = 1_000_000) -> DataFrame:
    """Shrunk win rate of side a over the previous ``size`` contests of everybody."""
    indexed = hot.global_index(contests.select("contest_id", "ts", "a_win"), ORDER)
    step = F.array(
        F.struct(F.col("idx").alias("at"), F.lit(0).alias("kind"), F.col("a_win").alias("w"), F.lit(1).alias("n")),
        F.struct((F.col("idx") + size).alias("at"), F.lit(1).alias("kind"), (-F.col("a_win")).alias("w"), F.lit(-1).alias("n")))
    steps = indexed.select("contest_id", F.explode(step).alias("s")).select("contest_id", "s.*").withColumn(
        "_b", F.floor(F.col("at") / bucket))
    w = Window.partitionBy("_b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.groupBy("_b").agg(F.sum("w").alias("tw"), F.sum("n").alias("tn")).select(
        "_b", F.coalesce(F.sum("tw").over(before), F.lit(0)).alias("ow"), F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("on"))
    local = steps.select("*", F.coalesce(F.sum("w").over(w), F.lit(0)).alias("lw"),
                         F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ln")).where("kind = 0")
    return local.join(offsets, "_b").select(
        "contest_id", smoothed_rate(F.col("lw") + F.col("ow"), F.col("ln") + F.col("on"), 20.0).alias("side_rate"))
