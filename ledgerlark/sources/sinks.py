"""Writers and merges: each returns or writes a whole new table, never changes rows in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.operators.unify import first_per_key


def append_new(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Incoming rows whose key the target lacks, the first of each."""
    return first_per_key(incoming.join(target.select(*keys), keys, "left_anti"), keys, *order)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The target with incoming rows in place of, or besides, its own."""
    new = first_per_key(incoming, keys, *order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def null_fill(target: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The target's values, filled from incoming rows where they are null, and incoming rows with new keys."""
    a, b = target.select(key, *columns).alias("a"), incoming.select(key, *columns).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in [key, *columns]])


def relabel(df: DataFrame, column: str, labels: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with labels replaced by a mapping table; unmapped ones stay."""
    m = labels.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropna(subset=["_old"]).dropDuplicates(["_old"])
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def write_csv(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """CSV export with fixed headers, booleans as Yes and No, nulls empty; as many files as the data has partitions."""
    kinds = dict(df.dtypes)
    shown = [(F.when(F.col(c), "Yes").otherwise("No") if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(h) for c, h in headers.items()]
    df.select(*shown).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")


def swap(df: DataFrame, path: str) -> None:
    """Write a table beside its old version, then put it in its place by renaming; ``df`` may read the old version."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging, old, live = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in (".new", ".old", ""))
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(staging, True)
    df.write.parquet(staging.toString())
    fs.delete(old, True)
    if fs.exists(live):
        fs.rename(live, old)
    fs.rename(staging, live)
    fs.delete(old, True)
