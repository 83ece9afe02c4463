"""Trigram similarity of texts: sets of three-letter pieces of words padded by two blanks before and one after."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F


def words(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _of_word(w: Column) -> Column:
    padded = F.concat(F.lit("  "), w, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of all words."""
    return F.array_distinct(F.flatten(F.transform(words(c), _of_word)))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two sets of trigrams; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    return overlap(trigrams(a), trigrams(b))


def may_reach(c: Column, query: str, threshold: float) -> Column:
    """Whether a text holds enough of the query's trigrams, wherever, to reach a similarity of ``threshold``; cheap, and never false for one that does.

    Two sets with that similarity share at least that part of either. A trigram with a word's end counts if its letters occur at all.
    """
    grams = {f"  {w} "[i : i + 3].strip() for w in re.findall(r"[^\W_]+", query.lower()) for i in range(len(w) + 1)}
    sets = len({f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", query.lower()) for i in range(len(w) + 1)})
    low = F.lower(c)
    held = [low.contains(g).cast("int") for g in sorted(grams)]
    # Trigrams that differ by blanks only are counted once here, so they count for nothing in the need.
    need = math.ceil(threshold * sets - 1e-9) - (sets - len(grams))
    return F.coalesce(sum(held[1:], held[0]) >= need, F.lit(False)) if held and need > 0 else c.isNotNull()


def span_similarity(query: Column, text: Column) -> Column:
    """Highest similarity of ``query`` to a run of whole words of ``text``."""
    w = words(text)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_distinct(F.flatten(F.transform(F.slice(w, i, j - i + 1), _of_word))))))
    q = trigrams(query)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.array_max(F.transform(spans, lambda s: overlap(q, s))))


def similar_pairs(queries: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (q, t, sim) of rows (id, text) with a similarity of ``threshold`` or more, through an inverted index of trigrams.

    Two sets share at least threshold / (1 + threshold) times the sum of their sizes, so the shared
    trigrams are counted by grouping and nothing without common trigrams is compared.
    """
    q = queries.select(F.col("id").alias("q"), trigrams(F.col("text")).alias("g")).withColumn("nq", F.size("g")).select("q", "nq", F.explode("g").alias("g"))
    t = texts.select(F.col("id").alias("t"), trigrams(F.col("text")).alias("g")).withColumn("nt", F.size("g")).select("t", "nt", F.explode("g").alias("g"))
    shared = q.join(t, "g").groupBy("q", "t", "nq", "nt").agg(F.count("*").alias("n"))
    sim = F.col("n") / (F.col("nq") + F.col("nt") - F.col("n"))
    return shared.select("q", "t", sim.alias("sim")).where(F.col("sim") >= threshold)
