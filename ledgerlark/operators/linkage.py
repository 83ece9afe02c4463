"""Links between records by references in text, normalised keys, bounded edits and shared composite keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.segments import kept_keys, sought_keys
from ledgerlark.functions.text import fee_references, key_variants, name_tokens
from ledgerlark.operators.unify import first_per_key


def extract_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, pos, ref): every reference in the text; texts without any have no row."""
    return df.select(key, F.posexplode(fee_references(F.col(text))).alias("pos", "ref"))


def match_cascade(refs: DataFrame, targets: DataFrame, ref: str, key: str, id_columns: list[str]) -> DataFrame:
    """Rows (*id_columns, ref, target, match_type): a reference's target by its exact text, else by the likeliest variant of either spelling.

    Both sides' variants are exploded and joined once; the pair with the smallest rank wins, then the smallest target.
    """
    left = refs.select(*id_columns, F.col(ref).alias("ref"), F.posexplode(key_variants(F.col(ref))).alias("rank", "v"))
    right = targets.select(F.col(key).alias("target")).distinct().select("target", F.explode(F.array_distinct(F.array("target", F.regexp_replace(F.upper("target"), "[^A-Z0-9]", "")))).alias("v"))
    hits = left.join(right, "v").withColumn("rank", F.when(F.col("ref") == F.col("target"), -1).otherwise(F.col("rank")))
    best = first_per_key(hits, [*id_columns, "ref"], F.col("rank"), F.col("target"))
    return best.select(*id_columns, "ref", "target", F.when(F.col("rank") == -1, "exact").otherwise("normalized").alias("match_type"))


def fuzzy_blocked(left: DataFrame, right: DataFrame, most: int = 2, block_tokens: int = 2) -> DataFrame:
    """Rows (id, target, distance): for rows (id, key, name, state) the target whose key is closest within ``most`` edits.

    Candidates share one of their first ``block_tokens`` sorted name tokens, and their states agree where both are known. The
    join is by token and a segment of the key, of which keys so close share one: so a token that many names hold, a given name, makes no
    pairs of keys that lie far apart.
    """
    blocks = lambda n: F.explode(F.slice(F.array_sort(name_tokens(F.col(n), stops=False)), 1, block_tokens))
    a = left.select("id", "key", "state", blocks("name").alias("block"))
    b = right.select(F.col("id").alias("target"), F.col("key").alias("key2"), F.col("state").alias("state2"), blocks("name").alias("block"))
    x, y = sought_keys(a, "key", ["block"], most).drop("block"), kept_keys(b, "key2", ["block"], most).drop("block")
    longer = x.join(y, "k").drop("k")
    # Targets with the longer key look for the others.
    x, y = kept_keys(a, "key", ["block"], most).drop("block"), sought_keys(b, "key2", ["block"], most, tuple(range(1, most + 1))).drop("block")
    pairs = longer.unionByName(x.join(y, "k").drop("k")).where((F.col("id") != F.col("target")) & F.coalesce(F.col("state") == F.col("state2"), F.lit(True)))
    pairs = pairs.withColumn("distance", F.levenshtein("key", "key2", most)).where("distance >= 0")
    closest = pairs.groupBy("id").agg(F.min(F.struct("distance", "target")).alias("m"))
    return closest.select("id", "m.target", "m.distance")


def composite_links(trust: DataFrame, fee: DataFrame, keys: list[str], date: str, name: str) -> DataFrame:
    """Pairs (trust_id, fee_id, gap) on equal keys (null counts as ''), a fee date not before the trust date where both are known, and a shared name token."""
    blank = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col(date).alias(f"{side}_date"), name_tokens(F.col(name)).alias(f"{side}_tokens"), *[F.coalesce(F.col(k), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)])
    pairs = blank(trust, "trust").join(blank(fee, "fee"), [f"k{i}" for i in range(len(keys))])
    order = F.coalesce(F.col("fee_date") >= F.col("trust_date"), F.lit(True))
    pairs = pairs.where(order & F.arrays_overlap("trust_tokens", "fee_tokens"))
    return pairs.select("trust_id", "fee_id", F.floor(F.date_diff("fee_date", "trust_date") / 365).cast("long").alias("gap"))


def sources_by_priority(df: DataFrame, keys: list[str], source: str, priority: dict[str, int], *ties: str) -> DataFrame:
    """One row per key, from the source that comes first; rows with a null key are all kept."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(source)], F.lit(len(priority)))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return first_per_key(df.where(whole), keys, rank, *[F.col(t) for t in ties]).unionByName(df.where(~whole))


def tiered_pick(candidates: DataFrame, key: str, label: str, *order: Column) -> DataFrame:
    """The best candidate per key, and whether the candidates disagree about the label."""
    w = Window.partitionBy(key)
    flagged = candidates.withColumn("labels", F.size(F.collect_set(label).over(w)))
    return first_per_key(flagged, [key], *order).withColumn("disagree", F.col("labels") > 1).drop("labels")


def evidence_tier(pairs: DataFrame, key: str, label: str, similarity: str, parcel: str, date: str, tie: str) -> DataFrame:
    """Rows (key, tier, label, sibling): the best evidence for each record's label among pairs with records that have one.

    'disagreement' if the pairs name several labels; T1: the same name and parcel, the earliest; T2: a similarity of 0.7 or more and
    the same parcel, the most similar, then the earliest; both with the label. T3: the same parcel; T4: the same name; T5: neither; these without.
    """
    s, same = F.round(F.col(similarity), 6), F.coalesce(F.col(parcel), F.lit(False))
    tier = F.when(same & (s == 1), 1).when(same & (s >= 0.7), 2).when(same, 3).when(s == 1, 4).otherwise(5)
    rank = F.struct(tier.alias("tier"), F.when(tier == 2, -s).otherwise(F.lit(0.0)).alias("sim"), F.col(date).isNull().alias("undated"), F.col(date).alias("date"), F.col(tie).alias("tie"))
    best = pairs.groupBy(key).agg(F.min(rank).alias("r"), F.min_by(label, rank).alias("l"), (F.min(label) != F.max(label)).alias("several"))
    sure = ~F.col("several") & (F.col("r.tier") <= 2)
    return best.select(key, F.when(F.col("several"), "disagreement").otherwise(F.concat(F.lit("T"), F.col("r.tier"))).alias("tier"), F.when(sure, F.col("l")).alias("label"), F.when(sure, F.col("r.tie")).alias("sibling"))
