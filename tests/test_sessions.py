"""Working tables go when their operator returns, unless its result reads them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import sessions
from fieldloom.operators import effects, matching, order


def tables(spark) -> set[str]:
    folder = sessions.shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("fieldloom-")}


def names(found: set[str]) -> list[str]:
    return sorted(f.split("-")[1] for f in found)


@sessions.owning
def inner(df: DataFrame) -> DataFrame:
    kept, _ = sessions.cut(df, "kept")
    sessions.cut(df, "idle")
    return kept.join(kept.groupBy("k").count(), "k")


@sessions.owning
def outer(df: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
    found = inner(df)
    if again:
        found, _ = sessions.cut(found, "again")
    return found, df


@pytest.mark.parametrize(("again", "left"), [(False, ["kept"]), (True, ["again"])])
def test_only_what_is_read_stays(spark, again, left):
    before = tables(spark)
    found, _ = outer(spark.range(10).select((F.col("id") % 3).alias("k")), again)
    assert names(tables(spark) - before) == left
    assert found.count() == 10


def test_failure_leaves_nothing(spark):
    @sessions.owning
    def fails(df: DataFrame) -> DataFrame:
        sessions.cut(df, "idle")
        raise ValueError("no")

    before = tables(spark)
    with pytest.raises(ValueError, match="no"):
        fails(spark.range(3).toDF("k"))
    assert tables(spark) == before


def test_without_an_owner_tables_stay(spark):
    before = tables(spark)
    sessions.cut(spark.range(3), "plain")
    assert names(tables(spark) - before) == ["plain"]


def test_operators_leave_what_they_read(spark):
    files = spark.createDataFrame([(f"image_{k:03d}_ch1.png",) for k in range(40)], "name string")
    values = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    for result in (
        lambda: matching.match_names(files, files.where("name > 'image_010'")),
        lambda: order.quantiles(values, ["k"], F.col("v"), {"mid": 0.5}),
        lambda: effects.adjusted(values.withColumn("p", F.col("v") / 100), ["k"]),
    ):
        before = tables(spark)
        df = result()
        left = tables(spark) - before
        assert df.count() > 0
        assert all(t in sessions.tables_read(df) for t in left)
