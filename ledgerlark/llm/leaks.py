"""Evaluation passages inside corpus texts: Wu-Manber search for every run of ``run`` words.

The patterns are all runs of ``run`` consecutive words of the passages. The search moves a window of that many
words over a text and looks at the two words at its end: a table gives how far the window can safely move
(``run - 1`` where no pattern holds these two words); where the table says nothing, the patterns that end in
the two words are compared with the window directly.

The tables are built of blocks of passages, none of more than ``block_chars`` characters but for a single longer passage. A larger
set of passages takes several passes over the corpus, one after the other: a block's tables are released, and its
finds written, before the next one's are built. Texts are searched whole, without a shuffle.

Defined cases: words are lower-cased maximal runs of letters and digits; null, empty and blank texts and
passages, and such with fewer than ``run`` words, match nothing; repeated rows give one result row; several
items with the same run are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ledgerlark.runtime import Kept

_WORD = re.compile(r"[^\W_]+")
#: Numbers that are neither letters nor digits (fractions, raised and circled numbers, numerals) separate words.
_OTHER_NUMBER = re.compile("[²³¹¼-¾⁰-⁹₀-₉⅐-↋①-⒛⓪-⓿❶-➓]")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _OTHER_NUMBER.sub(" ", text)
    return _WORD.findall(text)


class WuManber:
    """Shift and bucket tables of word patterns of one length."""

    def __init__(self, passages: list[tuple[int, str | None]], run: int):
        self.run = run
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        patterns: dict[tuple[str, ...], set[int]] = {}
        for item, passage in passages:
            w = words_of(passage)
            for i in range(len(w) - run + 1):
                patterns.setdefault(tuple(w[i : i + run]), set()).add(item)
        for p, items in patterns.items():
            for i in range(1, run):
                block = p[i - 1], p[i]
                self.shift[block] = min(self.shift.get(block, run - 1), run - 1 - i)
            self.bucket.setdefault((p[-2], p[-1]), {})[p] = sorted(items)

    def search(self, text: str | None) -> set[int]:
        """Items of which the text holds a pattern."""
        found: set[int] = set()
        w, run, shift, bucket = words_of(text), self.run, self.shift, self.bucket
        at, n, far = run - 1, len(w), run - 1
        while at < n:
            block = w[at - 1], w[at]
            step = shift.get(block, far)
            if step:
                at += step
                continue
            items = bucket[block].get(tuple(w[at - run + 1 : at + 1]))
            if items:
                found.update(items)
            at += 1
        return found


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = 13, block_chars: int = 2_000_000) -> DataFrame:
    """Rows (doc_id, item_id): the text holds at least ``run`` consecutive words of the item's passage."""
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.length("text") >= 2 * run - 1)
    tests = items.where(F.length(f"`{passage}`") >= 2 * run - 1).select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{passage}`").alias("passage"))
    chars, n = tests.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)), F.count("*")).first()
    # Passages are dealt to blocks by hash; twice as many blocks until none is too large, or each has one passage.
    blocks = max(1, -(-chars // block_chars))
    block = lambda: F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks))
    while blocks > 1 and blocks < 64 * n and tests.groupBy(block().alias("b")).agg(F.sum(F.length("passage")).alias("c"), F.count("*").alias("k")).where((F.col("c") > block_chars) & (F.col("k") > 1)).head(1):
        blocks *= 2

    def search(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        tables = documents.sparkSession.sparkContext.broadcast(WuManber([(r["item_id"], r["passage"]) for r in part.collect()], run))  # a bounded block

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = tables.value.search
            for batch in it:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                hits = [(d, item) for d, t in zip(ids, texts) for item in find(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["doc_id", "item_id"])

        return docs.mapInArrow(batches, "doc_id long, item_id long").distinct(), tables

    if blocks == 1:
        return search(tests)[0]
    out = None
    for b in [r["b"] for r in tests.select(block().alias("b")).distinct().collect()]:
        found, tables = search(tests.where(block() == b))
        one = Kept(found).df
        tables.unpersist()
        out = one if out is None else out.unionByName(one)
    return out.distinct()
