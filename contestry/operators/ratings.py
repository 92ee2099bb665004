"""Rating timelines: Elo for entities and members, Glicko-2 by day, and period variants.

Sequential ratings are a chain of updates, so the parallel unit is a *pool*: a set of entities
that only meet each other (a region, a league system). Pools of ordinary size are folded inside
tasks, one stream of sorted rows per partition with only the current states in memory. A pool
above ``pool_rows`` contests is not left to one task: it is cut along time into blocks of at most
``block_rows`` contests, and the contests of a block into components that share no key; one round per
block folds the components side by side, each from the states its keys brought along. Both give the
same numbers at every size: state belongs to (pool, key), so an entity that occurs in two pools has
a rating in each, and a key on both sides of a contest counts in both means, moves by both deltas
and has played one contest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from contestry.functions import rates
from contestry.operators import hot
from contestry.operators.chronology import DAY, side_long, valid_contests
from contestry.session import materialize, run_dir

POOL_ROWS = 5_000_000
#: Contests of a pool per round: at most so many are held by one task.
BLOCK_ROWS = 500_000

SIDES_SCHEMA = "contest_id long, ts long, pool long, base_k double, a_win long, a_keys array<long>, b_keys array<long>"
FOLD_SCHEMA = (
    "contest_id long, ts long, a_win long, a_keys array<long>, b_keys array<long>, "
    "a_before array<double>, b_before array<double>, a_games array<long>, b_games array<long>, "
    "a_rating double, b_rating double, a_expected double, a_delta double, b_delta double"
)


def _update(rating: dict, games: dict, provisional: bool, k: float, win: int, a: list, b: list) -> tuple:
    """Rate one contest: moves the states and returns what the contest saw and did."""
    limit, factor, start = rates.PROVISIONAL_GAMES, rates.PROVISIONAL_FACTOR, rates.START_RATING
    ra, rb = [rating.get(m, start) for m in a], [rating.get(m, start) for m in b]
    ga, gb = [games.get(m, 0) for m in a], [games.get(m, 0) for m in b]
    mean_a, mean_b = sum(ra) / len(ra), sum(rb) / len(rb)
    expected = 1.0 / (1.0 + 10.0 ** ((mean_b - mean_a) / 400.0))
    ka = k * factor if provisional and ga[0] < limit else k
    kb = k * factor if provisional and gb[0] < limit else k
    da, db = ka * (win - expected), kb * (expected - win)
    for keys, played, delta in ((a, ga, da), (b, gb, db)):
        for m, g in zip(keys, played):
            rating[m], games[m] = rating.get(m, start) + delta, g + 1
    return ra, rb, ga, gb, mean_a, mean_b, expected, da, db


def _fold_batches(provisional: bool):
    """Fold sorted contests pool by pool; the state of a pool is dropped when it ends."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, rating, games = None, {}, {}
        for batch in batches:
            out = []
            for cid, ts, p, k, win, a, b in zip(batch.contest_id, batch.ts, batch.pool, batch.base_k,
                                                batch.a_win, batch.a_keys, batch.b_keys):
                if p != pool:
                    pool, rating, games = p, {}, {}
                out.append((cid, ts, win, a, b, *_update(rating, games, provisional, k, win, a, b)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLD_SCHEMA.split(", ")])

    return fold


def _tasks(df: DataFrame) -> int:
    """A fixed number of tasks: folds are bound by compute, not by bytes, so they are not coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fold_pools(sides: DataFrame, provisional: bool) -> DataFrame:
    ordered = sides.repartition(_tasks(sides), "pool").sortWithinPartitions("pool", "ts", "contest_id")
    return ordered.mapInPandas(_fold_batches(provisional), FOLD_SCHEMA)


def _components(block: pd.DataFrame) -> pd.DataFrame:
    """Add the component of every contest of one block: contests that share a key, directly or over others, share it."""
    lists = [*block["a_keys"], *block["b_keys"]]
    sizes = np.array([len(keys) for keys in lists])
    names, node = np.unique(np.concatenate(lists), return_inverse=True)
    contest = np.repeat(np.tile(np.arange(len(block)), 2), sizes)
    first = node[np.cumsum(sizes)[:len(block)] - sizes[:len(block)]]
    label = np.arange(len(names))
    while True:
        u, v = label[first[contest]], label[node]
        if (u == v).all():
            return block.assign(component=names[label[first]])
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != label[label]).any():
            label = label[label]


def conflict_blocks(sides: DataFrame, block_rows: int = BLOCK_ROWS, block_seconds: int | None = None, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """Contests with ``block``, ascending along time, and ``component``, their independent part of the block.

    A block holds at most ``block_rows`` contests of a pool, and where ``block_seconds`` is given none on both sides of a
    multiple of it. Components need no ratings, so those of all blocks are found in one job.
    """
    placed = hot.prefix_sums(sides, ["pool"], ["ts", "contest_id"], {"_before": F.lit(1)}, hot_rows)
    block = F.floor(F.col("_before") / block_rows).cast("long")
    if block_seconds:
        block = block + F.floor(F.col("ts") / block_seconds).cast("long") * 2 ** 31
    placed = placed.withColumn("block", block).drop("_before")
    return placed.groupBy("pool", "block").applyInPandas(_components, SIDES_SCHEMA + ", block long, component long")


NO_BLOCK = -1
STEP_SCHEMA = f"kind int, pool long, key long, rating double, games long, to_block long, {FOLD_SCHEMA}"
STATE, CONTEST = 0, 1


def _fold_components(provisional: bool):
    """Fold sorted rows component by component: first the states of its keys, then its contests.

    Gives a row per contest, and per key the state it leaves with and the block it is needed in next.
    """
    names = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
    blank = (0, 0, 0, [], [], [], [], [], [], 0.0, 0.0, 0.0, 0.0, 0.0)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, rating, games, needed = None, {}, {}, {}

        def leaving():
            return [(STATE, place[0], m, rating[m], games[m], block, *blank) for m, block in needed.items() if block != NO_BLOCK]

        for batch in batches:
            out = []
            for kind, pool, component, key, held, played, block, cid, ts, k, win, a, b in zip(*[batch[c] for c in (
                    "kind", "pool", "component", "key", "rating", "games", "to_block", "contest_id", "ts", "base_k", "a_win", "a_keys", "b_keys")]):
                if (pool, component) != place:
                    out += leaving()
                    place, rating, games, needed = (pool, component), {}, {}, {}
                if kind == STATE:
                    rating[key], games[key], needed[key] = held, played, block
                else:
                    out.append((CONTEST, pool, 0, 0.0, 0, NO_BLOCK, cid, ts, win, a, b, *_update(rating, games, provisional, k, win, a, b)))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(leaving(), columns=names)

    return fold


def fold_blocks(sides: DataFrame, provisional: bool, block_rows: int = BLOCK_ROWS, block_seconds: int | None = None,
                hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """The fold as one round per block, for a pool too large for one task.

    The rounds follow the number of contests, however busy one key is. A state is written once per block its key plays in,
    to the folder of the next such block, and read there alone: no round reads or rewrites the states of other keys.
    Every round ends in files in the shared folder.
    """
    spark = sides.sparkSession
    base = run_dir(spark, "blocks")
    contests = materialize(conflict_blocks(sides, block_rows, block_seconds, hot_rows), f"{base}/contests", "block")
    keys = contests.select("pool", "block", "component", F.explode(F.array_distinct(F.concat("a_keys", "b_keys"))).alias("key")).distinct()
    following = F.lead("block").over(Window.partitionBy("pool", "key").orderBy("block"))
    # few files per block, whichever task finds a key
    spread = lambda column: (F.col(column), F.pmod(F.xxhash64("key"), F.lit(8)))
    keys = keys.withColumn("to_block", F.coalesce(following, F.lit(NO_BLOCK)).cast("long")).repartition(*spread("block"))
    keys = materialize(keys, f"{base}/keys", "block")
    blocks = [r[0] for r in contests.select("block").distinct().orderBy("block").collect()]
    entered = {r[0] for r in keys.select("to_block").distinct().collect()}  # at most one per block
    for block in blocks:
        playing = keys.where(F.col("block") == block)
        if block in entered:
            held = spark.read.schema("pool long, key long, rating double, games long").parquet(f"{base}/states/to_block={block}")
            playing = playing.join(held, ["pool", "key"], "left")
        else:
            playing = playing.withColumns({"rating": F.lit(None).cast("double"), "games": F.lit(None).cast("long")})
        zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
        states = playing.select(
            F.lit(STATE).alias("kind"), "pool", "component", "key", F.coalesce("rating", F.lit(rates.START_RATING)).alias("rating"),
            F.coalesce("games", zero).alias("games"), "to_block", zero.alias("contest_id"), zero.alias("ts"), F.lit(0.0).alias("base_k"),
            zero.alias("a_win"), none.alias("a_keys"), none.alias("b_keys"))
        today = contests.where(F.col("block") == block).select(
            F.lit(CONTEST).alias("kind"), "pool", "component", zero.alias("key"), F.lit(0.0).alias("rating"), zero.alias("games"),
            F.lit(NO_BLOCK).cast("long").alias("to_block"), "contest_id", "ts", "base_k", "a_win", "a_keys", "b_keys")
        rows = states.unionByName(today).repartition(_tasks(sides), "pool", "component").sortWithinPartitions(
            "pool", "component", "kind", "ts", "contest_id")
        done = materialize(rows.mapInPandas(_fold_components(provisional), STEP_SCHEMA), f"{base}/done/step={block}", "kind")
        left = done.where(F.col("kind") == STATE).select("pool", "key", "rating", "games", "to_block")
        left.repartition(*spread("to_block")).write.partitionBy("to_block").mode("append").parquet(f"{base}/states")
    if not blocks:
        return spark.createDataFrame([], FOLD_SCHEMA)
    return spark.read.schema(STEP_SCHEMA + ", step long").parquet(f"{base}/done").where(F.col("kind") == CONTEST).select(
        *[c.split()[0] for c in FOLD_SCHEMA.split(", ")])


def _by_pool_size(sides: DataFrame, provisional: bool, pool_rows: int, block_seconds: int | None, block_rows: int) -> DataFrame:
    large = sides.groupBy("pool").count().where(F.col("count") > pool_rows).select("pool")
    if large.isEmpty():
        return _fold_pools(sides, provisional)
    small = _fold_pools(sides.join(large, "pool", "left_anti"), provisional)
    return small.unionByName(fold_blocks(sides.join(large, "pool", "left_semi"), provisional, block_rows, block_seconds))


def pool_violations(contests: DataFrame, pool: str = "pool") -> DataFrame:
    """Entities seen in more than one pool: they have a rating in each."""
    return (side_long(contests, pool).groupBy("entity_id").agg(F.min(pool).alias("lo"), F.max(pool).alias("hi"))
            .where(F.col("lo") != F.col("hi")))


def elo_history(contests: DataFrame, pool: str | None = "pool", since: int | None = None,
                pool_rows: int = POOL_ROWS, block_seconds: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per valid contest with both ratings and game counts before it.

    Without a pool column everything is one pool; it is folded only if it is small.
    """
    valid = valid_contests(contests, since)
    sides = valid.select(
        "contest_id", "ts", (F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"),
        rates.tier_k(F.col("tier")).alias("base_k"), "a_win",
        F.array("a_id").alias("a_keys"), F.array("b_id").alias("b_keys"))
    folded = _by_pool_size(sides, True, pool_rows, block_seconds, block_rows)
    return folded.select(
        "contest_id", "ts", F.col("a_keys")[0].alias("a_id"), F.col("b_keys")[0].alias("b_id"),
        "a_rating", "b_rating", F.col("a_games")[0].alias("a_games"), F.col("b_games")[0].alias("b_games"),
        (F.col("a_rating") - F.col("b_rating")).alias("rating_difference"), "a_expected", "a_win",
        (F.col("a_rating") + F.col("a_delta")).alias("a_after"), (F.col("b_rating") + F.col("b_delta")).alias("b_after"))


def elo_side_history(features: DataFrame) -> DataFrame:
    """Two rows per contest: entity, rating before and after, opponent, expected, actual."""
    def view(own, other, expected, actual):
        return F.struct(F.col(f"{own}_id").alias("entity_id"), F.col(f"{own}_rating").alias("before"),
                        F.col(f"{own}_after").alias("after"), F.col(f"{other}_id").alias("opponent_id"),
                        expected.alias("expected"), actual.cast("double").alias("actual"))
    return features.select("contest_id", "ts", F.explode(F.array(
        view("a", "b", F.col("a_expected"), F.col("a_win")),
        view("b", "a", 1 - F.col("a_expected"), 1 - F.col("a_win")))).alias("v")).select("contest_id", "ts", "v.*")


def member_ratings(lineups: DataFrame, k_factor: float = 24.0, pool: str | None = "pool",
                   pool_rows: int = POOL_ROWS, block_seconds: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Member ratings: a side's rating is the mean of its members, all of them move by one delta.

    ``lineups``: contest_id, ts, pool, a_win and the member lists a_keys / b_keys, each without repeats.
    """
    sides = lineups.select(
        "contest_id", "ts", (F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"),
        F.lit(k_factor).alias("base_k"), "a_win", "a_keys", "b_keys")
    return _by_pool_size(sides, False, pool_rows, block_seconds, block_rows)


def member_side_history(folded: DataFrame) -> DataFrame:
    def side(s, expected, actual):
        return F.transform(
            F.arrays_zip(F.col(f"{s}_keys").alias("key"), F.col(f"{s}_before").alias("r"), F.col(f"{s}_games").alias("g")),
            lambda v: F.struct(v["key"].alias("member_id"), v["r"].alias("before"),
                               (v["r"] + F.col(f"{s}_delta")).alias("after"), v["g"].alias("games"),
                               expected.alias("expected"), actual.alias("actual")))
    return folded.select("contest_id", F.explode(F.concat(
        side("a", F.col("a_expected"), F.col("a_win")),
        side("b", 1 - F.col("a_expected"), 1 - F.col("a_win")))).alias("v")).select("contest_id", "v.*")


def elo_period(contests: DataFrame, period: str = "era", since: int | None = None) -> DataFrame:
    """Period-synchronous Elo: every contest of a period uses the ratings at its start.

    Different numbers from ``elo_history`` (no update inside a period), but no pools are needed:
    each period is two joins and one partial aggregation. The loop runs over the calendar.
    """
    spark = contests.sparkSession
    base = run_dir(spark, "elo-period")
    valid = valid_contests(contests, since).select(
        "contest_id", "ts", "a_id", "b_id", "a_win", F.col(period).alias("period"), rates.tier_k(F.col("tier")).alias("k"))
    valid = materialize(valid, f"{base}/contests", "period")
    periods = [r[0] for r in valid.select("period").distinct().orderBy("period").collect()]
    state = materialize(spark.createDataFrame([], "entity_id long, rating double, games long"), f"{base}/state")
    for period_value in periods:
        current = valid.where(F.col("period") == period_value)
        for s in ("a", "b"):
            own = state.select(F.col("entity_id").alias(f"{s}_id"), F.col("rating").alias(f"{s}_rating"),
                               F.col("games").alias(f"{s}_games"))
            current = current.join(own, f"{s}_id", "left")
            current = current.withColumn(f"{s}_rating", F.coalesce(f"{s}_rating", F.lit(rates.START_RATING))).withColumn(
                f"{s}_games", F.coalesce(f"{s}_games", F.lit(0)))
        rated = current.withColumn("a_expected", rates.elo_expected(F.col("a_rating"), F.col("b_rating"))).drop("period")
        path = f"{base}/rated/period={period_value}"
        rated.write.mode("overwrite").parquet(path)
        rated = spark.read.schema(rated.schema).parquet(path)
        young = lambda s: F.when(F.col(f"{s}_games") < rates.PROVISIONAL_GAMES, rates.PROVISIONAL_FACTOR).otherwise(1.0)
        gain = F.col("a_win") - F.col("a_expected")
        moves = rated.select(F.explode(F.array(
            F.struct(F.col("a_id").alias("entity_id"), (F.col("k") * young("a") * gain).alias("move")),
            F.struct(F.col("b_id").alias("entity_id"), (-F.col("k") * young("b") * gain).alias("move")))).alias("v")).select("v.*")
        delta = moves.groupBy("entity_id").agg(F.sum("move").alias("move"), F.count("*").alias("n"))
        merged = state.join(delta, "entity_id", "full").select(
            "entity_id", (F.coalesce("rating", F.lit(rates.START_RATING)) + F.coalesce("move", F.lit(0.0))).alias("rating"),
            (F.coalesce("games", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("games"))
        state = materialize(merged, f"{base}/state-{period_value}")
    schema = valid.drop("period").schema.simpleString()[7:-1].replace(":", " ")
    return spark.read.schema(
        schema + ", a_rating double, a_games long, b_rating double, b_games long, a_expected double").parquet(f"{base}/rated")


# --- Glicko-2 ----------------------------------------------------------------------------------

TAU = 0.5
EPSILON = 1e-6
GLICKO_SCHEMA = (
    "kind int, contest_id long, day long, entity_id long, opponent_id long, rating double, deviation double, "
    "volatility double, other_rating double, other_deviation double, other_volatility double, contests long, wins long, pool long"
)


def volatility_root(delta2: np.ndarray, phi2: np.ndarray, v: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """New volatility for arrays of players (Glickman 2013, step 5), all brackets narrowed together."""
    a = np.log(sigma * sigma)

    def f(x):
        e = np.exp(x)
        return e * (delta2 - phi2 - v - e) / (2.0 * (phi2 + v + e) ** 2) - (x - a) / (TAU * TAU)

    far = delta2 > phi2 + v
    hi = np.where(far, np.log(np.where(far, delta2 - phi2 - v, 1.0)), a - TAU)
    short = ~far & (f(hi) < 0.0)
    while short.any():
        hi = np.where(short, hi - TAU, hi)
        short = ~far & (f(hi) < 0.0)
    lo, f_lo, f_hi = a.copy(), f(a), f(hi)
    active = np.abs(hi - lo) > EPSILON
    while active.any():
        gap = np.where(active, f_hi - f_lo, 1.0)
        c = np.where(active, lo + (lo - hi) * f_lo / gap, hi)
        f_c = f(c)
        crossed = f_c * f_hi <= 0.0
        f_lo = np.where(active, np.where(crossed, f_hi, f_lo / 2.0), f_lo)
        lo = np.where(active & crossed, hi, lo)
        hi, f_hi = np.where(active, c, hi), np.where(active, f_c, f_hi)
        active = np.abs(hi - lo) > EPSILON
    return np.exp(lo / 2.0)


def period_update(rating, deviation, volatility, inverse_variance, improvement):
    """State after a period from the sums over its contests; arrays in, arrays out."""
    phi = deviation / rates.GLICKO_SCALE
    variance = 1.0 / inverse_variance
    sigma = volatility_root((variance * improvement) ** 2, phi * phi, variance, volatility)
    phi_new = 1.0 / np.sqrt(1.0 / (phi * phi + sigma * sigma) + inverse_variance)
    mu = (rating - 1500.0) / rates.GLICKO_SCALE + phi_new * phi_new * improvement
    return mu * rates.GLICKO_SCALE + 1500.0, phi_new * rates.GLICKO_SCALE, sigma


def _glicko_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold the pools of a partition together.

    Rows arrive sorted by ``step``, the rank of the day among the active days of its pool. Pools do
    not meet, so one step rates the n-th active day of every pool in one vectorised update. State is
    kept by (pool, entity), so the result does not depend on which pools share a partition.
    """
    slot_of: dict[tuple[int, int], int] = {}
    state = np.empty((3, 1024))
    last = np.empty(1024, dtype=np.int64)
    pair = np.dtype([("pool", np.int64), ("entity", np.int64)])
    names = [c.split()[0] for c in GLICKO_SCHEMA.split(", ")]

    def rate(contest_id, day, a_id, b_id, a_win, pool):
        nonlocal state, last
        n = len(day)
        own = np.empty(2 * n, dtype=pair)
        own["pool"], own["entity"] = np.concatenate([pool, pool]), np.concatenate([a_id, b_id])
        won = np.concatenate([a_win, 1 - a_win])
        ids, first, pos = np.unique(own, return_index=True, return_inverse=True)
        today = np.concatenate([day, day])[first]
        rival = np.concatenate([pos[n:], pos[:n]])
        fresh = [(i, t) for i, t in zip(ids.tolist(), today.tolist()) if i not in slot_of]
        if fresh:
            known = len(slot_of)
            for i, _ in fresh:
                slot_of[i] = len(slot_of)
            while len(slot_of) > len(last):
                state, last = np.concatenate([state, np.empty_like(state)], axis=1), np.concatenate([last, np.empty_like(last)])
            state[:, known:len(slot_of)] = [[rates.START_RATING], [rates.START_DEVIATION], [rates.START_VOLATILITY]]
            last[known:len(slot_of)] = [t for _, t in fresh]
        slots = np.array([slot_of[i] for i in ids.tolist()])
        r, d, s = state[:, slots]
        idle = np.maximum(0, today - last[slots] - 1)
        grown = np.minimum(350.0, np.sqrt((d / rates.GLICKO_SCALE) ** 2 + idle * s * s) * rates.GLICKO_SCALE)
        d = np.where(idle > 0, grown, d)
        mu, phi = (r - 1500.0) / rates.GLICKO_SCALE, d / rates.GLICKO_SCALE
        g = 1.0 / np.sqrt(1.0 + 3.0 * phi * phi / np.pi ** 2)
        e = 1.0 / (1.0 + np.exp(-g[rival] * (mu[pos] - mu[rival])))
        inverse = np.bincount(pos, weights=g[rival] ** 2 * e * (1.0 - e), minlength=len(ids))
        gain = np.bincount(pos, weights=g[rival] * (won - e), minlength=len(ids))
        r2, d2, s2 = period_update(r, d, s, inverse, gain)
        state[:, slots] = [r2, d2, s2]
        last[slots] = today
        a, b = pos[:n], rival[:n]
        zero = np.zeros(len(ids), dtype=np.int64)
        contests = (np.zeros(n, dtype=np.int32), contest_id, day, a_id, b_id, r[a], d[a], s[a], r[b], d[b], s[b],
                    np.ones(n, dtype=np.int64), a_win, pool)
        periods = (np.ones(len(ids), dtype=np.int32), zero, today, ids["entity"], zero, r, d, s, r2, d2, s2,
                   np.bincount(pos, minlength=len(ids)), np.bincount(pos, weights=won, minlength=len(ids)).astype(np.int64), ids["pool"])
        return contests, periods

    def load(rows: pd.DataFrame) -> None:
        """Stored states, which come before all contests."""
        nonlocal state, last
        known = len(slot_of)
        for p, e in zip(rows["pool"].tolist(), rows["a_id"].tolist()):
            slot_of[p, e] = len(slot_of)
        while len(slot_of) > len(last):
            state, last = np.concatenate([state, np.empty_like(state)], axis=1), np.concatenate([last, np.empty_like(last)])
        state[:, known:len(slot_of)] = rows[["r", "d", "s"]].to_numpy(dtype=float).T
        last[known:len(slot_of)] = rows["last"].to_numpy(dtype=np.int64)

    columns = ["contest_id", "day", "a_id", "b_id", "a_win", "pool"]
    rest = None
    for batch in batches:
        if "r" in batch.columns:
            stored = batch["step"].to_numpy() == 0
            if stored.any():
                load(batch[stored])
                batch = batch[~stored]
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        step = rows["step"].to_numpy()
        cuts = np.flatnonzero(np.diff(step)) + 1
        keep_from = int(cuts[-1]) if len(cuts) else 0
        rest = rows.iloc[keep_from:]
        parts = []
        values = [rows[c].to_numpy(dtype=np.int64) for c in columns]
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            parts.extend(rate(*[v[lo:hi] for v in values]))
        if parts:
            yield pd.DataFrame({name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(names)})
    if rest is not None and len(rest):
        parts = rate(*[rest[c].to_numpy(dtype=np.int64) for c in columns])
        yield pd.DataFrame({name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(names)})


def glicko_timeline(contests: DataFrame, pool: str | None = "pool", since: int | None = None,
                    pool_rows: int = POOL_ROWS, period_days: int = 1, state: DataFrame | None = None) -> DataFrame:
    """Rows of kind 0 (contest, both states before) and kind 1 (entity and day, before and after).

    ``state`` (pool, entity_id, r, d, s, last): where to continue from; ``last`` is the day of an entity's last period.
    """
    valid = valid_contests(contests, since).select(
        "contest_id", F.floor(F.col("ts") / (DAY * period_days)).alias("day"), "a_id", "b_id", "a_win",
        (F.col(pool) if pool else F.lit(0)).cast("long").alias("pool"))
    large = valid.groupBy("pool").count().where(F.col("count") > pool_rows).select("pool")
    if large.isEmpty():
        return _glicko_pools(valid, state)
    return _glicko_pools(valid.join(large, "pool", "left_anti"), state).unionByName(
        glicko_by_period(valid.join(large, "pool", "left_semi"), state))


def _glicko_pools(valid: DataFrame, state: DataFrame | None = None) -> DataFrame:
    active_day = F.dense_rank().over(Window.partitionBy("pool").orderBy("day")).alias("step")
    stepped = valid.repartition(_tasks(valid), "pool").select("contest_id", "day", "a_id", "b_id", "a_win", "pool", active_day)
    if state is not None:
        zero = F.lit(0).cast("long")
        none = [F.lit(None).cast("double").alias(c) for c in ("r", "d", "s")]
        held = state.select(zero.alias("contest_id"), zero.alias("day"), F.col("entity_id").alias("a_id"), zero.alias("b_id"), zero.alias("a_win"), "pool",
                            F.lit(0).alias("step"), "r", "d", "s", "last")
        stepped = stepped.select("*", *none, F.lit(None).cast("long").alias("last")).unionByName(held).repartition(_tasks(valid), "pool")
    return stepped.sortWithinPartitions("step", "contest_id").mapInPandas(_glicko_fold, GLICKO_SCHEMA)


def glicko_by_period(valid: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The same timeline for a pool too large for one task: one round of joins per period.

    Contests of a period only need the state before it, so a period is two joins, one partial
    aggregation and a vectorised root. Rounds are bounded by the calendar.
    """
    spark = valid.sparkSession
    base = run_dir(spark, "glicko")
    rows = materialize(valid, f"{base}/contests", "day")
    days = [r[0] for r in rows.select("day").distinct().orderBy("day").collect()]
    columns = [c.split()[0] for c in GLICKO_SCHEMA.split(", ")]
    none = spark.createDataFrame([], "pool long, entity_id long, r double, d double, s double, last long")
    state = materialize(none if start is None else start.select(*none.columns), f"{base}/state")

    @F.pandas_udf("r2 double, d2 double, s2 double")
    def after(r: pd.Series, d: pd.Series, s: pd.Series, inverse: pd.Series, gain: pd.Series) -> pd.DataFrame:
        r2, d2, s2 = period_update(*[c.to_numpy(dtype=float) for c in (r, d, s, inverse, gain)])
        return pd.DataFrame({"r2": r2, "d2": d2, "s2": s2})

    for day in days:
        today = rows.where(F.col("day") == day)
        for side in ("a", "b"):
            idle = rates.glicko_idle_periods(F.lit(day) - F.col("last"))
            own = state.select("pool", F.col("entity_id").alias(f"{side}_id"), F.col("r").alias(f"{side}_r"),
                               rates.glicko_inactivity(F.col("d"), F.col("s"), idle).alias(f"{side}_d"),
                               F.col("s").alias(f"{side}_s"))
            today = today.join(own, ["pool", f"{side}_id"], "left")
            for c, start in (("r", rates.START_RATING), ("d", rates.START_DEVIATION), ("s", rates.START_VOLATILITY)):
                today = today.withColumn(f"{side}_{c}", F.coalesce(f"{side}_{c}", F.lit(start)))

        def view(kind, own, other, won):
            return F.struct(
                F.lit(kind).alias("k"), F.col(f"{own}_id").alias("entity_id"), F.col(f"{own}_r").alias("r"),
                F.col(f"{own}_d").alias("d"), F.col(f"{own}_s").alias("s"), F.col(f"{other}_r").alias("r_o"),
                F.col(f"{other}_d").alias("d_o"), won.alias("won"))

        sides = today.select("pool", F.explode(F.array(
            view(0, "a", "b", F.col("a_win")), view(1, "b", "a", 1 - F.col("a_win")))).alias("v")).select("pool", "v.*")
        phi_o = F.col("d_o") / rates.GLICKO_SCALE
        g = 1 / F.sqrt(1 + 3 * phi_o * phi_o / (np.pi ** 2))
        e = 1 / (1 + F.exp(-g * (F.col("r") - F.col("r_o")) / rates.GLICKO_SCALE))
        sums = sides.groupBy("pool", "entity_id", "r", "d", "s").agg(
            F.sum(g * g * e * (1 - e)).alias("inverse"), F.sum(g * (F.col("won") - e)).alias("gain"),
            F.count("*").alias("contests"), F.sum("won").alias("wins"))
        rated = sums.withColumn("u", after("r", "d", "s", "inverse", "gain"))
        out_contests = today.select(
            F.lit(0).alias("kind"), "contest_id", F.lit(day).alias("day"), F.col("a_id").alias("entity_id"),
            F.col("b_id").alias("opponent_id"), F.col("a_r").alias("rating"), F.col("a_d").alias("deviation"),
            F.col("a_s").alias("volatility"), F.col("b_r").alias("other_rating"), F.col("b_d").alias("other_deviation"),
            F.col("b_s").alias("other_volatility"), F.lit(1).cast("long").alias("contests"), F.col("a_win").alias("wins"), "pool")
        out_periods = rated.select(
            F.lit(1).alias("kind"), F.lit(0).cast("long").alias("contest_id"), F.lit(day).alias("day"), "entity_id",
            F.lit(0).cast("long").alias("opponent_id"), F.col("r").alias("rating"), F.col("d").alias("deviation"),
            F.col("s").alias("volatility"), F.col("u.r2").alias("other_rating"), F.col("u.d2").alias("other_deviation"),
            F.col("u.s2").alias("other_volatility"), "contests", "wins", "pool")
        path = f"{base}/out/step={day}"
        out_contests.unionByName(out_periods).select(*columns).write.mode("overwrite").parquet(path)
        changed = spark.read.schema(GLICKO_SCHEMA).parquet(path).where("kind = 1").select(
            "pool", "entity_id", F.col("other_rating").alias("r"), F.col("other_deviation").alias("d"),
            F.col("other_volatility").alias("s"), F.col("day").alias("last"))
        state = materialize(state.join(changed.select("pool", "entity_id"), ["pool", "entity_id"], "left_anti").unionByName(changed),
                            f"{base}/state-{day}")
    return spark.read.schema(GLICKO_SCHEMA + ", step long").parquet(f"{base}/out").drop("step")


def glicko_features(timeline: DataFrame) -> DataFrame:
    t = timeline.where("kind = 0")
    return t.select(
        "contest_id", F.col("entity_id").alias("a_id"), F.col("opponent_id").alias("b_id"),
        F.col("rating").alias("a_rating"), F.col("other_rating").alias("b_rating"),
        F.col("deviation").alias("a_deviation"), F.col("other_deviation").alias("b_deviation"),
        (F.col("rating") - F.col("other_rating")).alias("rating_difference"),
        rates.glicko_expected(F.col("rating"), F.col("other_rating"), F.col("deviation"), F.col("other_deviation")).alias("a_expected"),
        F.col("wins").alias("a_win"))


def glicko_history(timeline: DataFrame) -> DataFrame:
    t = timeline.where("kind = 1")
    return t.select("day", "entity_id", F.col("rating").alias("rating_before"), F.col("deviation").alias("deviation_before"),
                    F.col("volatility").alias("volatility_before"), F.col("other_rating").alias("rating_after"),
                    F.col("other_deviation").alias("deviation_after"), F.col("other_volatility").alias("volatility_after"),
                    "contests", "wins")
