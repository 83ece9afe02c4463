"""One view over overlapping catalogues, with label layers that override without changing their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def layered(layers: list[Column]) -> Column:
    """The first layer that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in layers])


def unified_view(mapped: DataFrame, catalogue: DataFrame, key: str, prefer: list[str], fallback: dict[str, Column] | None = None) -> DataFrame:
    """Mapped rows with what the catalogue adds, and catalogue rows that aren't mapped; ``is_mapped`` tells them apart.

    For the columns in ``prefer`` a mapped row takes its own value, or else the catalogue's. ``fallback``
    gives unmapped rows replacements for columns.
    """
    extra = catalogue.select(F.col(key), *[F.col(c).alias(f"_c_{c}") for c in prefer])
    both = mapped.join(extra, key, "left").select(key, *[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) for c in prefer], F.lit(True).alias("is_mapped"))
    alone = catalogue.join(mapped.select(key), key, "left_anti")
    alone = alone.select(key, *[(fallback or {}).get(c, F.col(c)).alias(c) for c in prefer], F.lit(False).alias("is_mapped"))
    return both.unionByName(alone)


def with_flag(df: DataFrame, members: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """``df`` with a two-valued column: whether its columns ``on`` (df column -> members column) occur in ``members``."""
    keys = members.select(*[F.col(m).alias(f"_m_{i}") for i, m in enumerate(on.values())]).dropna().distinct().withColumn("_hit", F.lit(True))
    matched = df.join(keys, [F.col(c) == F.col(f"_m_{i}") for i, c in enumerate(on)], "left")
    return matched.withColumn(flag, F.col("_hit").isNotNull()).drop("_hit", *[f"_m_{i}" for i in range(len(on))])


def resolve_labels(df: DataFrame, label: str, tiers: list[tuple[str, DataFrame, str, str]], unknown: list[str]) -> DataFrame:
    """``df`` with resolved and tier: the first tier (name, table, key, value) that knows the label's upper-cased, trimmed text."""
    key = F.upper(F.trim(F.col(label)))
    out = df.withColumn("_key", F.when(F.lower(F.trim(F.col(label))).isin(unknown), F.lit(None)).otherwise(key))
    for i, (_, table, k, v) in enumerate(tiers):
        known = table.select(F.upper(F.trim(F.col(k))).alias("_key"), F.nullif(F.trim(F.col(v)), F.lit("")).alias(f"_v{i}")).dropna().groupBy("_key").agg(F.min(f"_v{i}").alias(f"_v{i}"))
        out = out.join(known, "_key", "left")
    values = [F.col(f"_v{i}") for i in range(len(tiers))]
    tier = F.lit("none")
    for i in reversed(range(len(tiers))):
        tier = F.when(values[i].isNotNull(), tiers[i][0]).otherwise(tier)
    return out.withColumn("resolved", F.coalesce(*values)).withColumn("tier", tier).drop("_key", *[f"_v{i}" for i in range(len(tiers))])
