"""References to records that do not exist, per table and period.

Keys are range-partitioned over the 64-bit code space of xxhash64, whose equal slices hold equal shares of the distinct
keys whatever the keys look like. The parents of a range are stored once, as one row of sorted arrays. References stream past
their range's arrays in batches, each probed by one vectorised binary search; no reference is joined with parents by key.
Ranges with many references are salted: their arrays are read by several tasks, so a key that a third of all
references name is spread over many.

Defined cases: null references are no references; '' and blank ones are compared as written. A parent
without a time counts as always there; a reference without a time is an orphan only if no parent has its
key, and its period is null. Empty parents make every reference missing. Duplicate parents count once, by
their earliest time. Two keys are taken for one only if both their 64-bit codes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.runtime import Kept, small

_NEVER = -(2**63)
_ABSENT = 2**63 - 1
_ARRAYS = ("code", "other", "first", "elsewhere")


def _micros(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def _codes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("code"), F.xxhash64(F.lit("other"), key).alias("other")


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents sorted by range and codes into one row of arrays per range; a range has one task and is held once."""
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([t.column("slice")[0].as_py()], pa.int32()), *(pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for c in _ARRAYS)], names=["slice", *_ARRAYS])

    for batch in it:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != at[a]:
                yield row()
            held.append(batch.slice(a, b - a))
    if held:
        yield row()


def _probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of references that follow the arrays of their range and salt."""
    now, codes, others, first, elsewhere = None, *(np.zeros(0, np.int64) for _ in range(4))
    for batch in it:
        t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        slice_, salt, arrays = t["slice"].to_numpy(), t["salt"].to_numpy(), t["is_ref"].to_numpy() == 0
        fresh = np.flatnonzero((slice_[1:] != slice_[:-1]) | (salt[1:] != salt[:-1])) + 1
        cuts = [0, *fresh, len(slice_)]
        kinds: list[np.ndarray] = []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if arrays[a]:
                now = slice_[a], salt[a]
                codes, others, first, elsewhere = (np.frombuffer(t[f"p_{c}"][a].as_py(), dtype=np.int64) for c in _ARRAYS)
            elif now != (slice_[a], salt[a]):  # a range without parents
                now, codes, others, first, elsewhere = (slice_[a], salt[a]), *(np.zeros(0, np.int64) for _ in range(4))
            want, other, at = (t[c].to_numpy(zero_copy_only=False)[a:b] for c in ("code", "other", "at"))
            kind = np.full(b - a, 1, np.int8)  # missing
            if len(codes):
                lo, hi = np.searchsorted(codes, want, "left"), np.searchsorted(codes, want, "right")
                for step in range(int((hi - lo).max())):  # one step, but for keys that share a code
                    q = np.minimum(lo + step, len(codes) - 1)
                    same = (lo + step < hi) & (others[q] == other)
                    kind[same & (first[q] == _ABSENT) & (elsewhere[q] == 1)] = 2
                    kind[same & (first[q] != _ABSENT)] = 0
                    kind[same & (first[q] != _ABSENT) & (first[q] > at)] = 3
            if arrays[a]:
                kind[0] = 0
            kinds.append(kind)
        kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int8)
        live = pa.array(np.flatnonzero(kind))
        names = pa.array(["", "missing", "deleted", "late"]).take(pa.array(kind[kind > 0]))
        yield pa.RecordBatch.from_arrays([t["src"].take(live), t["id"].take(live), names, t["month"].take(live)], names=["src", "id", "kind", "ref_month"])


def find_orphans(references: list[tuple[str, DataFrame, str, str, str]], parents: DataFrame, parent_key: str, parent_time: str, elsewhere: DataFrame | None = None, elsewhere_key: str | None = None, batch: int = 50_000) -> DataFrame:
    """Orphans (src, id, kind, ref_month) of ``references``: tuples of name, table, id, reference and time column.

    kind: 'late' if parents with the key exist but all came after the reference, 'deleted' if only
    ``elsewhere`` has the key, else 'missing'. A range holds about ``batch`` parents, and a salt about as many references.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    long = lambda x: F.lit(x).cast("long")
    own = parents.where(F.col(f"`{parent_key}`").isNotNull()).select(*_codes(text(parent_key)), F.coalesce(_micros(f"`{parent_time}`"), long(_NEVER)).alias("first"), long(0).alias("elsewhere"))
    if elsewhere is not None:
        own = own.unionByName(elsewhere.where(F.col(f"`{elsewhere_key}`").isNotNull()).select(*_codes(text(elsewhere_key)), long(_ABSENT).alias("first"), long(1).alias("elsewhere")))
    own = Kept(own.groupBy("code", "other").agg(F.min("first").alias("first"), F.max("elsewhere").alias("elsewhere")))
    refs = None
    for src, df, id_, key, time in references:
        one = df.where(F.col(f"`{key}`").isNotNull()).select(F.lit(src).alias("src"), F.col(f"`{id_}`").cast("long").alias("id"), *_codes(text(key)), F.coalesce(_micros(f"`{time}`"), long(_ABSENT)).alias("at"), F.date_format(F.col(f"`{time}`"), "yyyy-MM").alias("month"))
        refs = one if refs is None else refs.unionByName(one)
    refs = Kept(refs).df
    bits = max(0, max(own.df.count(), refs.count()) // batch).bit_length()
    slice_of = (F.shiftrightunsigned(F.col("code"), 64 - bits).cast("int") if bits else F.lit(0)).alias("slice")
    arrays = own.df.select(slice_of, *_ARRAYS).repartition("slice").sortWithinPartitions("slice", "code", "other")
    arrays = Kept(arrays.mapInArrow(_pack, "slice int, " + ", ".join(f"{c} binary" for c in _ARRAYS))).df
    own.drop()
    refs = refs.withColumn("slice", slice_of)
    # How many tasks read a range: a row per range with more than one.
    salts = Kept(refs.groupBy("slice").agg(F.ceil(F.count("*") / batch).cast("int").alias("salts")).where("salts > 1")).df
    many = salts.count()
    salted = lambda df: df.join(small(salts, many), "slice", "left") if many else df.withColumn("salts", F.lit(1))
    refs = salted(refs).withColumn("salt", F.pmod(F.xxhash64("src", "id"), F.coalesce("salts", F.lit(1))).cast("int")).withColumn("is_ref", F.lit(1).cast("byte")).drop("salts")
    packed = salted(arrays).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("slice", "salt", F.lit(0).cast("byte").alias("is_ref"), *[F.col(c).alias(f"p_{c}") for c in _ARRAYS])
    rows = refs.unionByName(packed, allowMissingColumns=True).withColumns({c: F.coalesce(c, long(0)) for c in ("code", "other", "at")})
    rows = rows.repartition("slice", "salt").sortWithinPartitions("slice", "salt", "is_ref")
    return rows.mapInArrow(_probe, "src string, id long, kind string, ref_month string")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return orphans.groupBy("src", "ref_month", "kind").agg(F.count("*").alias("orphans"))
