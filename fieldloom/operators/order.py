"""Places in one order over a whole table or within each key, which no single task has to sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.sessions import cut, owning


def placed(df: DataFrame, *order: Column, name: str = "place", start: int = 1) -> DataFrame:
    """``df`` with each row's place, gapless from ``start``, by ``order``; rows equal in it get places in any order.

    Rows are dealt to ranges of the order, numbered within their range, and offset by the ranges before it. The ranges
    are written first: they depend on a sample that another run would draw anew.
    """
    return placed_within(df, [], *order, name=name, start=start)


def placed_within(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "place", start: int = 1, before: Column | None = None) -> DataFrame:
    """``df`` with each row's place among the rows of its keys, gapless from ``start``, by ``order``.

    A key may hold nearly all rows: rows are dealt to ranges of keys and order, so a large key takes several ranges and a
    range several small keys. Nulls are a key like any other. With ``before`` (whole numbers) the place is ``start`` and
    the sum of it over the rows ahead, a running sum. Rows equal in all of ``order`` get places in any order; many of
    them lie in one range unless the last of ``order`` tells them apart.
    """
    at = [f"_key{k}" for k in range(len(keys))]
    by = [f"_order{k}" for k in range(len(order))]
    step = {"_step": F.lit(1) if before is None else before}
    own = df.withColumns({a: F.col(k) for a, k in zip(at, keys, strict=True)} | dict(zip(by, order, strict=True)) | step)
    ranged, _ = cut(own.repartitionByRange(*at, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*at, "_range").agg(F.sum("_step").alias("_in"))  # a row a range and key
    ahead = F.sum("_in").over(Window.partitionBy(*at).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*(F.col(a).alias(f"{a}_") for a in at), F.col("_range").alias("_range_"), F.coalesce(ahead, F.lit(0)).alias("_before"))
    inner = F.sum("_step").over(Window.partitionBy("_range", *at).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    joined = ranged.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(offsets, [F.col("_range") == F.col("_range_"), *(F.col(a).eqNullSafe(F.col(f"{a}_")) for a in at)])
    kept = [c for c in df.columns if c != name]
    return joined.select(*kept, (F.col("_before") + F.col("_inner") + start).cast("long").alias(name))


@owning
def quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """Per key the exact quantiles of ``value`` (nulls don't count), by name: interpolated between the two values next to
    the place, as ``percentile`` does. Keys that are null or have no value are left out.

    Equal values are one row with a count; their places come from :func:`placed_within`, so that no task holds all the
    different values of a key.
    """
    by = list(keys) or ["_all"]
    own = df if keys else df.withColumn("_all", F.lit(0))
    known = own.select(*by, value.cast("double").alias("_v")).where(" and ".join(f"`{k}` is not null" for k in [*by, "_v"]))
    rows = placed_within(known.groupBy(*by, "_v").agg(F.count("*").alias("_n")), by, F.col("_v"), name="_at", start=0, before=F.col("_n"))
    rows, _ = cut(rows, "places")
    sizes = rows.groupBy(*by).agg(F.sum("_n").alias("_total"))
    joined = rows.join(sizes, by)
    found = {}
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_total") - 1)
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            found[f"_{end}_{name}"] = F.max(F.when((F.col("_at") <= at) & (at < F.col("_at") + F.col("_n")), F.col("_v")))
    ends = joined.groupBy(*by).agg(F.first("_total").alias("_total"), *(c.alias(n) for n, c in found.items()))
    out = []
    for name, share in shares.items():
        place, low, high = F.lit(float(share)) * (F.col("_total") - 1), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return ends.select(*keys, *out)
