"""Wide to long and back, with reconciliation of parts and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def melt(df: DataFrame, keys: list[str], columns: dict[str, Column], name: str = "name", value: str = "value", kind: str = "bigint") -> DataFrame:
    """One row per key and column, nulls included."""
    cells = F.array(*[F.struct(F.lit(n).alias(name), c.cast(kind).alias(value)) for n, c in columns.items()])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, f"_c.{name}", f"_c.{value}")


def row_sum(columns: list[Column]) -> Column:
    """Sum across columns, nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def signed_split(change: Column) -> tuple[Column, Column]:
    """A change as an increase and a decrease; null where it is none."""
    return F.when(change > 0, change), F.when(change < 0, -change)


def reconcile(items: DataFrame, key: str, value: str, reported: DataFrame, total: str) -> DataFrame:
    """Rows (key, reported_total, itemized_total, gap): what is itemised against what is reported, keys of either side kept."""
    sums = items.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("itemized_total"))
    both = reported.select(key, F.col(total).alias("reported_total")).join(sums, key, "full_outer")
    return both.select(key, "reported_total", F.coalesce("itemized_total", F.lit(0)).alias("itemized_total"), (F.col("reported_total") - F.coalesce("itemized_total", F.lit(0))).alias("gap"))


def surrogate_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``df`` with numbers 1, 2, ... in a total order.

    Rows are sorted over ranges, counted per range, and numbered within each, so no task holds all of them.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    marked = ranged.withColumn("_p", F.spark_partition_id())
    counts = {r["_p"]: r["n"] for r in marked.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, run = {}, 0
    for p in sorted(counts):
        before[p], run = run, run + counts[p]
    offset = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])[F.col("_p")]
    w = Window.partitionBy("_p").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return marked.withColumn(name, (F.row_number().over(w) + offset).cast("long")).drop("_p")
