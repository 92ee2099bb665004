"""The line-up table: duels are read once, and team features are put together for duels only."""

import numpy as np
from conftest import SF, by_key, close
from pyspark.sql import functions as F

from contestry.operators import lineups, models
from contestry.plans import features
from contestry.sources import sample_tables as st


def test_features_of_wanted_contests_are_those_of_all(spark, contests):
    every = by_key(features.contest_features(contests), "contest_id")
    wanted = contests.where("contest_id % 7 = 3").select("contest_id").unionByName(spark.createDataFrame([(-5,), (None,)], "contest_id long"))
    some = by_key(features.contest_features(contests, wanted=wanted), "contest_id")
    close(some, {k: v for k, v in every.items() if k[0] % 7 == 3})
    assert 0 < len(some) < len(every) / 4


def test_duels_are_computed_once(spark, contests):
    duels = lineups.duels(st.members(spark, SF), 2)
    n, read = duels.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = features.lineup_features(contests, duels.mapInArrow(counted, duels.schema))
    rows = table.collect()
    assert read.value == n and len(rows) == len({r.contest_id for r in rows}) > 50
    team = by_key(features.contest_features(contests).select("contest_id", *features.FEATURES), "contest_id")
    close(by_key(table.select("contest_id", *features.FEATURES), "contest_id"), {(r.contest_id,): team[r.contest_id,] for r in rows})


def test_models_of_a_grid_are_those_of_single_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), float(rng.random() < 1 / (1 + np.exp(b - a))), float(w)) for (a, b), w in zip(x, rng.uniform(0.1, 1, 400))]
    df = spark.createDataFrame(rows, "u double, v double, target double, w double")
    grid = models.weighted_logistics(df, ["u", "v"], F.col("w"), [0.01, 1.0])
    for c, model in zip([0.01, 1.0], grid):
        alone = models.weighted_logistic(df, ["u", "v"], F.col("w"), c)
        assert np.allclose(model.model.coefficients, alone.model.coefficients, atol=1e-9) and model.fitted == alone.fitted
    assert abs(grid[0].model.coefficients[0]) < abs(grid[1].model.coefficients[0]) and not df.is_cached
