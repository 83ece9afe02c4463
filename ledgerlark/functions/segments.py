"""Pigeonhole keys: texts within ``most`` edits share one of most + 1 segments, shifted by no more than the edits on either side of it.

The segments' numbers and shifts are laid out as rows before a key is worked out, so the expression stays small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _keyed(df: DataFrame, text: str, block: list[str | Column], parts: int, shapes: list[tuple[int, int, int]], name: str) -> DataFrame:
    """A row per shape (letters less, segment, shift) that fits, with its key."""
    laid = F.explode(F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(d).alias("d")) for less, i, d in shapes])).alias("_s")
    rows = df.select("*", laid)
    n, i = F.length(text), F.col("_s.i")
    m = n - F.col("_s.less")
    cut = lambda j: F.call_function("div", m * j, F.lit(parts)).cast("int")
    at, size = cut(i) + 1 + F.col("_s.d"), cut(i + 1) - cut(i)
    key = F.xxhash64(*block, m, i, F.substring(text, at, size)).alias(name)
    return rows.where((m > 0) & (at >= 1) & (at + size - 1 <= n)).select(*df.columns, key)


def kept_keys(df: DataFrame, text: str, block: list[str | Column], most: int = 2, name: str = "k") -> DataFrame:
    """A row for each key under which a text is found: one for each of its segments, within ``block``. An empty text has none."""
    return _keyed(df, text, block, most + 1, [(0, i, 0) for i in range(most + 1)], name)


def sought_keys(df: DataFrame, text: str, block: list[str | Column], most: int = 2, shorter: tuple[int, ...] | None = None, name: str = "k", own: bool = True) -> DataFrame:
    """A row for each key of the texts as long as this one, or up to ``most`` letters shorter (or as much shorter as given), that may lie within ``most`` edits of it.

    Without ``own``, the keys under which the text is found itself are left out; texts that share one of them are those that ``kept_keys`` gives the same key.
    """
    shapes = []
    for less in range(most + 1) if shorter is None else shorter:
        for i in range(most + 1):
            # i edits at most lie before the segment, most - i behind it; ``less`` of all are deletions.
            shapes += [(less, i, d) for d in range(max(-i, less - (most - i)), min(i, less + (most - i)) + 1) if own or less or d]
    return _keyed(df, text, block, most + 1, shapes, name)
