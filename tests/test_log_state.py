"""The state of activity features: files in any order add up to a full run."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from retentia.operators import activity, log_state

SCHEMA = "u string, date date, x bigint, y double"


def measures():
    return {"x": F.col("x"), "y": F.col("y")}


def logs(seed, n=300):
    rng = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    users = ["hot"] * 6 + ["a", "b", "c", None, "only once"]
    return [
        (rng.choice(users), rng.choice([None, *[day + datetime.timedelta(d) for d in range(40)]]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, -1.0]))
        for _ in range(n)
    ]


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def full(spark, rows_):
    df = spark.createDataFrame(rows_, SCHEMA)
    return activity.activity_features(df, "u", "date", measures(), tie=["x", "y"])


@pytest.mark.parametrize("cuts", [(300,), (0, 300), (120, 180), (5, 200, 95)])
def test_merged_states_equal_a_full_run(spark, cuts):
    every, state, start = logs(1), None, 0
    for n in cuts:
        part = spark.createDataFrame(every[start : start + n], SCHEMA)
        start += n
        one = log_state.state_of(part, "u", "date", measures())
        state = one if state is None else log_state.merge(state, one, "u")
    assert rows(log_state.features_of(state, "u", "date")) == rows(full(spark, every))


def test_updates_are_kept_counted_once_and_survive_a_cut(spark, tmp_path):
    folder, every = str(tmp_path / "state"), logs(2)
    assert log_state.read_state(spark, folder) is None

    def update(name, part):
        return log_state.update(spark, folder, spark.createDataFrame(part, SCHEMA), name, "u", "date", measures())

    update("one", every[:100])
    # An update that was cut off after its state was written has no list of files, and is made again.
    spark.createDataFrame([(1,)], "junk int").write.parquet(f"{folder}/state-2")
    update("two", every[100:])
    state = update("one", every[:100])
    assert rows(log_state.features_of(state, "u", "date")) == rows(full(spark, every))


def test_two_keys_and_a_tie(spark):
    day = datetime.date(2020, 1, 1)
    schema = "u int, v int, date date, t int, x int"
    old = spark.createDataFrame([(1, 1, day, 5, 50), (1, 2, day, 1, 7)], schema)
    new = spark.createDataFrame([(1, 1, day, 9, 10), (1, 1, day, 7, 30)], schema)
    parts = [log_state.state_of(f, ["u", "v"], "date", {"x": F.col("x")}, tie=["t"]) for f in (old, new)]
    got = log_state.features_of(log_state.merge(*parts, ["u", "v"]), ["u", "v"], "date").where("v = 1").first()
    assert (got["x_last"], got["x_2ndlast"], got["x_3rdlast"], got["sum_x_3last"], got["sum_x"]) == (10, 30, 50, 90, 90)
