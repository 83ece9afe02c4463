"""Audits: gaps in numbered volumes, differences between builds, agreement of two extractions, violated constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sequence_gaps(df: DataFrame, key: str, pattern: str = r"^([A-Z]{2})([0-9]+)__\.([0-9]+)$") -> DataFrame:
    """Rows (state, volume, entries, highest, gap, complete_pct) of keys that number pages of volumes; a key entered twice is two entries."""
    part = lambda i: F.nullif(F.regexp_extract(F.trim(F.col(key)), pattern, i), F.lit(""))
    pages = df.select(part(1).alias("state"), part(2).alias("volume"), part(3).try_cast("bigint").alias("page")).where("page IS NOT NULL")
    out = pages.groupBy("state", "volume").agg(F.count("*").alias("entries"), F.max("page").alias("highest"))
    return out.select("state", "volume", "entries", "highest", (F.col("highest") - F.col("entries")).alias("gap"), F.round(F.col("entries") * F.lit(100.0) / F.greatest(F.col("highest"), F.lit(1)), 1).alias("complete_pct"))


def symmetric_difference(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("only_old", "only_new")) -> DataFrame:
    """Rows (side, *columns) that just one of two builds has, as sets; one aggregation, not two subtractions."""
    columns = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.select(*columns).withColumn("_s", F.lit(2)))
    sides = both.groupBy(*columns).agg(F.bit_or("_s").alias("_s")).where("_s < 3")
    return sides.select(F.when(F.col("_s") == 1, names[0]).otherwise(names[1]).alias("side"), *columns)


def field_tallies(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (field, match, disagree, left_null, right_null, both_null) over common keys, in any case and without outer blanks."""
    text = lambda side, f: F.nullif(F.lower(F.trim(F.col(f"{side}.{f}").cast("string"))), F.lit(""))
    pairs = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), text("l", f).alias("a"), text("r", f).alias("b")) for f in fields])
    long = pairs.select(F.explode(cells).alias("c")).select("c.field", "c.a", "c.b")
    null = lambda c: F.col(c).isNull()
    return long.groupBy("field").agg(
        F.count_if(F.col("a") == F.col("b")).alias("match"), F.count_if(F.col("a") != F.col("b")).alias("disagree"), F.count_if(null("a") & ~null("b")).alias("left_null"),
        F.count_if(~null("a") & null("b")).alias("right_null"), F.count_if(null("a") & null("b")).alias("both_null"),
    )


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, group: str | None = None) -> DataFrame:
    """Counts of keys where two extractions agree, differ, or just one has a value, in all or by ``group`` (of ``a``, else of ``b``)."""
    x = a.select(F.col(key).alias("k"), F.col(value).alias("x"), *([F.col(group).alias("gx")] if group else [F.lit("all").alias("gx")]))
    y = b.select(F.col(key).alias("k"), F.col(value).alias("y"), *([F.col(group).alias("gy")] if group else [F.lit("all").alias("gy")]))
    both = x.join(y, "k", "full_outer").withColumn("group", F.coalesce("gx", "gy"))
    has_x, has_y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return both.groupBy("group").agg(
        F.count_if(has_x & has_y & (F.col("x") == F.col("y"))).alias("same"), F.count_if(has_x & has_y & (F.col("x") != F.col("y"))).alias("different"),
        F.count_if(has_x & ~has_y).alias("only_a"), F.count_if(~has_x & has_y).alias("only_b"), F.count_if(~has_x & ~has_y).alias("neither"),
    )


def violations(df: DataFrame, key: str, checks: dict[str, Column], unique: dict[str, list[str]]) -> DataFrame:
    """Rows (constraint, key): rows that break a check (null passes), and rows of repeated keys where all are given."""
    broken = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    out = df.select(F.explode(broken).alias("constraint"), F.col(key).alias("key")) if checks else None
    for name, columns in unique.items():
        whole = df.dropna(subset=columns)
        again = whole.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        one = whole.join(again, columns, "left_semi").select(F.lit(name).alias("constraint"), F.col(key).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def stop_after_misses(probes: DataFrame, volume: str, page: str, hit: str, misses: int) -> DataFrame:
    """Rows (volume, stop_page): where a run of ``misses`` failures in a row, after a first hit, would end the probing."""
    order = Window.partitionBy(volume).orderBy(page)
    runs = probes.withColumn("_hits", F.sum(F.col(hit).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.where((F.col("_hits") > 0) & ~F.col(hit))
    runs = runs.withColumn("_at", F.row_number().over(Window.partitionBy(volume, "_hits").orderBy(page))).where(F.col("_at") == misses)
    return runs.groupBy(volume).agg(F.min(page).alias("stop_page"))


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int, seed: str) -> DataFrame:
    """Exactly ``size`` rows (all, if there are fewer), spread over the strata in proportion by a seeded hash of the key.

    A stratum's quota is its share, rounded, and at least 1. While the quotas are too many, the largest gives one back, to 0 at the end
    where there are more strata than rows; while they are too few, the stratum with the most rows left takes one. Ties go to the
    smallest stratum. Giving back and taking one by one ends with a common level, which is found by ranking the single places.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per stratum
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("n"))
    quota = F.least(F.greatest(F.lit(1), F.rint(F.lit(float(size)) * F.col("n") / total)).cast("long"), F.col("n"))
    quotas = sizes.withColumn("quota", quota).withColumn("given", F.sum("quota").over(Window.partitionBy(F.lit(1))))
    # A place is given back, or taken, at the level the quota, or the rest, has before it.
    back = F.when(F.col("given") > size, F.transform(F.sequence(F.lit(1).cast("long"), F.col("quota")), lambda i: F.struct(i.alias("level"), F.lit(-1).alias("step"))))
    more = F.when((F.col("given") < size) & (F.col("n") > F.col("quota")), F.transform(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("quota"), F.lit(size).cast("long"))), lambda i: F.struct((F.col("n") - F.col("quota") - i + 1).alias("level"), F.lit(1).alias("step"))))
    places = quotas.select("_s", "given", F.explode(F.coalesce(back, more)).alias("p")).withColumn("at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("p.level"), F.col("_s").asc_nulls_first())))
    moved = places.where(F.col("at") <= F.abs(F.col("given") - size)).groupBy(F.col("_s").alias("_m")).agg(F.sum("p.step").alias("moved"))  # at most ``size`` a stratum
    quotas = quotas.join(moved, F.col("_s").eqNullSafe(F.col("_m")), "left").select("_s", (F.col("quota") + F.coalesce("moved", F.lit(0))).alias("quota")).where("quota > 0")
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    joined = df.join(F.broadcast(quotas), F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.withColumn("_r", F.row_number().over(order)).where("_r <= quota").drop("_r", "_s", "quota")


def gap_audit(gaps: DataFrame, highest: int = 100, gap: int = 50) -> DataFrame:
    """Of ``sequence_gaps`` the volumes that reach page ``highest``, with whether ``gap`` or more of their pages are missing."""
    return gaps.where(F.col("highest") >= highest).withColumn("gappy", F.col("gap") >= gap)


def gap_rollup(audit: DataFrame) -> DataFrame:
    """Rows (state, volumes, gappy, missing) of a ``gap_audit``; missing counts gappy volumes only."""
    return audit.groupBy("state").agg(F.count("*").alias("volumes"), F.count_if("gappy").alias("gappy"), F.coalesce(F.sum(F.when(F.col("gappy"), F.col("gap"))), F.lit(0)).alias("missing"))
