"""Statistics over cohorts: timelines, networks, rates, velocity, distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def timeline(df: DataFrame, year: Column, series: dict[str, Column], least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows (year, one count per series), over plausible years."""
    y = df.withColumn("year", year.cast("long")).where(F.col("year").isNotNull())
    if least is not None:
        y = y.where(F.col("year").between(least, most))
    return y.groupBy("year").agg(*[F.count_if(c).alias(n) for n, c in series.items()])


def cumulative(counts: DataFrame, order: str, columns: list[str], lead: int = 0) -> DataFrame:
    """Running totals through each step of ``order`` from ``lead`` steps before the first, with missing steps filled; one row per step, so few."""
    span = counts.agg(F.min(order).alias("a"), F.max(order).alias("b")).select(F.explode(F.sequence(F.col("a") - lead, F.col("b"))).alias(order))
    full = span.join(counts, order, "left").na.fill(0, columns)
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(order, *[F.sum(c).over(w).alias(f"cum_{c}") for c in columns])


def flow(stages: DataFrame, links: list[tuple[str, str, str]]) -> DataFrame:
    """Links (source, target, value) of a network from one row of named amounts; links without flow are left out."""
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(v).cast("long").alias("value")) for a, b, v in links])
    return stages.select(F.explode(rows).alias("l")).select("l.source", "l.target", "l.value").where("value > 0")


def flow_nodes(links: DataFrame) -> DataFrame:
    """Nodes (node, outflow, inflow) that a link reaches; nodes without any are no part of the network."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.when(F.lit(c == "source"), F.col("value")).alias("out"), F.when(F.lit(c == "target"), F.col("value")).alias("in")) for c in ("source", "target")])
    sums = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("o"), F.sum("e.in").alias("i"))
    return sums.select("node", F.coalesce("o", F.lit(0)).alias("outflow"), F.coalesce("i", F.lit(0)).alias("inflow"))


def top_counts(df: DataFrame, keys: list[str], fields: list[str], k: int) -> DataFrame:
    """Rows (*keys, field, value, n, place): the ``k`` most frequent non-blank values of each field, the smaller first where tied; one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")
    counts = df.select(*keys, cells).where(F.trim("c.value") != "").groupBy(*keys, F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys, "field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def dominant(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest where tied."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(value).alias("value"), F.col("n").alias("n")), F.struct((-F.col("n")).alias("a"), F.col(value).alias("b")))
    return counts.groupBy(key).agg(best.alias("d")).select(key, F.col("d.value").alias(value), F.col("d.n").alias("n"))


def positional_quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """The values at positions n/4, n/2 and 3n/4 of each key's sorted values, by ranks rather than by gathering them."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(key, value, (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    at = lambda e: F.max(F.when(F.col("r") == F.expr(e), F.col(value)))
    return ranked.groupBy(key).agg(at("n div 4").alias("p25"), at("n div 2").alias("p50"), at("(3 * n) div 4").alias("p75"))


def variation(counts: DataFrame, key: str, year: str, n: str) -> DataFrame:
    """Coefficient of variation of each key's yearly counts, years without a row as zero, and the first year of the most."""
    sums = counts.groupBy(key).agg(F.min(year).alias("a"), F.max(year).alias("b"), F.sum(n).alias("s"), F.sum(F.col(n) * F.col(n)).alias("q"), F.min_by(year, F.struct((-F.col(n)).alias("x"), F.col(year).alias("y"))).alias("peak_year"))
    years = F.col("b") - F.col("a") + 1
    mean = F.col("s") / years
    return sums.select(key, years.alias("years"), "peak_year", F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / years - mean * mean)) / mean, 6).alias("cv"))
