"""Claims and patents joined by way of a bridge; labels of one source mapped to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlark.functions.text import strip_zeros
from ledgerlark.operators.stats import dominant
from ledgerlark.runtime import small


def bridge_join(claims: DataFrame, bridge: DataFrame, how: str = "left", case: str = "case_number", name: str = "allottee_name") -> DataFrame:
    """Claims with the bridge's rows of the same case number, without leading zeros, and the same allottee.

    bridge: (bridge_case, bridge_name, ...); a null on either side joins nothing.
    """
    keyed = bridge.withColumn("_case", strip_zeros(F.col("bridge_case"))).withColumnRenamed("bridge_name", "_name").drop("bridge_case")
    c = claims.withColumn("_case", strip_zeros(F.col(case))).withColumn("_name", F.col(name))
    return c.join(keyed, ["_case", "_name"], how).drop("_case", "_name")


def label_map(links: DataFrame, label: str, target: str, overrides: dict[str, str | None]) -> DataFrame:
    """Rows (label, mapped) of the target each label is linked with most often (ties: the smallest), or the override; null drops the label."""
    own = dominant(links.where(F.col(target).isNotNull()), label, target).select(F.col(label).alias("label"), F.col(target).alias("mapped"))
    if not overrides:
        return own
    spark = links.sparkSession
    fixed = spark.createDataFrame(list(overrides.items()), "label string, mapped string")
    return own.join(F.broadcast(fixed), "label", "left_anti").unionByName(fixed)  # a literal list


def mapped_rates(claims: DataFrame, patents: DataFrame, mapping: DataFrame, least: int = 20) -> DataFrame:
    """Rows (tribe, labels, patents, trust, fee, claims, forced, rate): claims, counted per label and added up under the label's target, against patents.

    claims: (label, claims, forced) counts; patents: (tribe, patents, trust, fee) counts. A label without a mapping stands for
    itself, one mapped to null drops out. rate: forced claims in 100 fee patents, 100 at most; groups with fewer than ``least`` fee patents have none.
    """
    m = mapping.withColumn("_known", F.lit(True))
    to = claims.join(small(m), "label", "left").withColumn("tribe", F.when(F.col("_known"), F.col("mapped")).otherwise(F.col("label"))).where("tribe IS NOT NULL")
    sums = to.groupBy("tribe").agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("labels"), F.sum("claims").alias("claims"), F.sum("forced").alias("forced"))
    out = patents.where(F.col("fee") >= least).join(sums, "tribe", "left").na.fill(0, ["claims", "forced"]).na.fill("", ["labels"])
    return out.withColumn("rate", F.least(F.round(F.col("forced") * F.lit(100.0) / F.col("fee"), 1), F.lit(100.0)))


def contains_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (text, name) of rows (text) and (name), lower-cased alike, where either holds the other.

    What one text holds begins with three letters that stand somewhere in it, so the pairs come from an equality join on pieces of
    three (or fewer, for shorter ones), and are verified.
    """
    pieces = lambda c: F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(F.col(c), i, F.lit(n))) for n in (1, 2, 3)])))  # noqa: B023, E731
    head = lambda c: F.substring(c, 1, 3)
    t, n = texts.select("text").where("text != ''").distinct(), names.select("name").where("name != ''").distinct()
    one = t.select("text", F.explode(pieces("text")).alias("k")).join(n.withColumn("k", head("name")), "k").where(F.col("text").contains(F.col("name")))
    two = n.select("name", F.explode(pieces("name")).alias("k")).join(t.withColumn("k", head("text")), "k").where(F.col("name").contains(F.col("text")))
    return one.select("text", "name").unionByName(two.select("text", "name")).distinct()


def match_reservations(labels: DataFrame, names: DataFrame, manual: dict[str, str | None]) -> DataFrame:
    """Rows (label, core, name, method) of distinct labels (label, core): by hand, by a substring either way, by a first word that only one name begins with.

    names: (name, n); of several that fit by substring the one with the highest n, then the smallest, wins. A label that the hand-made map
    says has no counterpart has method 'no_match'; one that nothing fits, 'unmatched'.
    """
    hand = F.create_map(*[x for k, v in manual.items() for x in (F.lit(k), F.lit(v).cast("string"))]) if manual else None
    base = labels.select("label", "core").distinct().withColumn("low", F.lower("core"))
    by_hand = F.col("label").isin(list(manual)) if manual else F.lit(False)
    low = names.select(F.lower("name").alias("name"), F.col("name").alias("full"), "n")
    held = contains_pairs(base.select(F.col("low").alias("text")), low.select("name")).join(small(low), "name")
    held = held.groupBy(F.col("text").alias("low")).agg(F.min_by("full", F.struct(-F.col("n"), "full")).alias("by_part"))
    first = F.regexp_extract("low", r"^\s*(\S+)", 1)
    words = base.select("low", first.alias("w")).where(F.length("w") >= 4).distinct()
    starts = words.join(small(low.withColumn("head", F.substring("name", 1, 4))), F.substring("w", 1, 4) == F.col("head")).where(F.col("name").startswith(F.col("w")))
    starts = starts.groupBy("low").agg(F.count("*").alias("k"), F.min("full").alias("by_word")).where("k = 1").select("low", "by_word")
    out = base.join(held, "low", "left").join(starts, "low", "left")
    method = F.when(by_hand, F.when(hand[F.col("label")].isNotNull(), "manual").otherwise("no_match") if manual else F.lit("")).when(F.col("by_part").isNotNull(), "substring").when(F.col("by_word").isNotNull(), "first_word").otherwise("unmatched")
    name = F.when(by_hand, hand[F.col("label")] if manual else F.lit(None).cast("string")).otherwise(F.coalesce("by_part", "by_word"))
    return out.select("label", "core", name.alias("name"), method.alias("method"))
