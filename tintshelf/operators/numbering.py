"""Consecutive numbers and running sums inside groups of any size.

A plain window pulls a whole group into one task. Here rows are cut into key ranges over (group, order), so a
group with a third of all rows spans many tasks; only the totals per range are chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintshelf.session import new_folder

MAX_RANGES = 4096  # of the split points, which go to every task; otherwise as many ranges as shuffle partitions


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared folder (see ``new_folder``)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(new_folder(df.sparkSession))
    return df.checkpoint()


def _ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``_pid``, the number of the key range a row falls into.

    The rows are stored first: they are read for the split points and again for the numbers. Split
    points come from a few hashed keys; they only decide how even the ranges are, never the result.
    """
    base = checkpointed(df)
    n = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*group, *order)
    some = base.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(n * 16)
    ranked = some.agg(F.sort_array(F.collect_list("k")).alias("ks"))  # at most n * 16 keys
    step = F.size("ks") / n
    splits = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get("ks", F.least(F.floor(i * step).cast("int"), F.size("ks") - 1)))
    one = ranked.select(F.array_distinct(splits).alias("_splits"), F.lit(1).alias("_one"))
    with_splits = base.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    pid = _rank_in("_splits", key, n)
    return with_splits.withColumn("_pid", pid).drop("_splits", "_one")


def _rank_in(splits: str, key: Column, most: int) -> Column:
    """How many of the sorted ``splits`` (at most ``most``) are not above ``key``, by halving."""

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, up = at["low"] < at["high"], F.get(splits, middle) <= key
        return F.struct(F.when(open_ & up, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~up, middle).otherwise(at["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(splits).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, step)["low"]


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add running totals: ``sums`` maps a new column to the numeric column it adds up. ``order`` is unique per group."""
    r = _ranged(df, group, order)
    parts = r.groupBy(*group, "_pid").agg(*[F.sum(src).alias(f"_o_{new}") for new, src in sums.items()])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_pid", *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(src).over(inside).alias(f"_l_{new}") for new, src in sums.items()])
    out = local.join(parts, [*group, "_pid"])
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def number_within(df: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Add 0, 1, 2, .. per group in ``order``."""
    counted = running_sums(df.withColumn("_unit", F.lit(1)), group, order, {name: "_unit"})
    return counted.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("_unit")
