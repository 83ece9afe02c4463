"""Differences between two copies of a table, found through invertible Bloom lookup tables.

Every row becomes an element (key code, row hash). Each side's elements are added into small tables of
cells, one table per bucket of keys; a cell keeps a signed count and three xor sums, so the cells combine
on the map side and the two sides cancel wherever they agree. What is left is peeled, cell by cell, into
the elements that only one side has. Only their rows are fetched again and compared field by field.

The cells are sized by a strata estimate over all rows. A bucket that can't be peeled (too many
differences, or a row repeated so often that it leaves a count beyond one) is compared element by element
in a plain aggregation, so the result is exact up to 64-bit hash collisions.

Defined cases: null equals null, null differs from ''. Rows repeated on one side are no difference. A key
that is repeated with different values is compared on each field's smallest and largest value and on
whether it holds nulls. Rows with a null key have no counterpart and are left out. Fields are the columns
present in both copies; fields that can't be ordered (maps) are compared as JSON. Extra columns, of any
name, are ignored. Empty tables give every row of the other side as missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlark.functions.hashing import xx_longs
from ledgerlark.runtime import Kept, small

_CELL = "b long, cell long, n long, kx long, hx long, cx long"
_CHECK = 77
_STRATA, _STRATA_CELLS = 40, 40


def _row_hash(names: list[str], fields: dict[str, T.DataType]) -> Column:
    """Null-safe hash of a row: xxhash64 passes over nulls, so their places are hashed as a mask first."""
    cols = [_comparable(F.col(f"`{c}`"), fields[c]) for c in names]
    masks = []
    for i in range(0, len(cols), 60):
        bits = [F.when(c.isNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(cols[i : i + 60])]
        masks.append(sum(bits[1:], bits[0]))
    return F.xxhash64(*masks, *cols) if cols else F.lit(0).cast("long")


def _comparable(c: Column, kind: T.DataType) -> Column:
    def has_map(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and has_map(t.elementType)

    return F.to_json(c) if has_map(kind) else c


def _key_code(key: str, kind: T.DataType) -> Column:
    return F.col(key).cast("long") if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else F.xxhash64(F.col(key))


def _cells(elements: DataFrame, bucket: Column, size: Column) -> DataFrame:
    """Cells (b, cell, n, kx, hx, cx) of ``elements`` (sign, k, h); three cells of an element, one per third of a table."""
    lit = lambda x: F.lit(x).cast("long")
    e = elements.select("sign", "k", "h", bucket.alias("b"), size.alias("m")).withColumn("e", F.xxhash64("k", "h"))
    e = e.withColumn("c", F.xxhash64(F.col("e"), lit(_CHECK)))
    places = F.array(*[F.pmod(F.xxhash64(F.col("e"), lit(j)), F.col("m")) + F.col("m") * j for j in range(3)])
    out = e.select("b", "sign", "k", "h", "c", F.explode(places).alias("cell")).groupBy("b", "cell").agg(
        F.sum("sign").cast("long").alias("n"), F.bit_xor("k").alias("kx"), F.bit_xor("h").alias("hx"), F.bit_xor("c").alias("cx")
    )
    return out.where("n != 0 OR kx != 0 OR hx != 0 OR cx != 0")


def _peel(cells: pd.DataFrame, m: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Elements (k, h, sign) of one table of 3*m cells, and whether it was emptied."""
    n, kx, hx, cx = (np.zeros(3 * m, dtype=np.int64) for _ in range(4))
    at = cells["cell"].to_numpy()
    for name, a in (("n", n), ("kx", kx), ("hx", hx), ("cx", cx)):
        a[at] = cells[name].to_numpy()
    found: list[tuple[int, int, int]] = []
    todo = at
    while len(todo):
        pure = todo[np.abs(n[todo]) == 1]
        pure = pure[xx_longs(xx_longs(kx[pure], hx[pure]), np.full(len(pure), _CHECK)) == cx[pure]] if len(pure) else pure
        if not len(pure):
            break
        k, h, c, s = kx[pure], hx[pure], cx[pure], n[pure]
        _, first = np.unique(c, return_index=True)
        k, h, c, s = k[first], h[first], c[first], s[first]
        found.extend(zip(k.tolist(), h.tolist(), s.tolist()))
        e = xx_longs(k, h)
        touched = []
        for j in range(3):
            p = xx_longs(e, np.full(len(e), j)) % m + m * j
            np.subtract.at(n, p, s)
            np.bitwise_xor.at(kx, p, k)
            np.bitwise_xor.at(hx, p, h)
            np.bitwise_xor.at(cx, p, c)
            touched.append(p)
        todo = np.unique(np.concatenate(touched))
        if len(found) > 12 * m:
            break
    return found, not (n.any() or kx.any() or hx.any() or cx.any())


def _peeler(m: int):
    def peel(cells: pd.DataFrame) -> pd.DataFrame:
        found, whole = _peel(cells, m)
        b = int(cells["b"].iloc[0])
        if not whole:
            return pd.DataFrame({"b": [b], "k": [0], "h": [0], "sign": [0]})
        return pd.DataFrame({"b": b, "k": [x[0] for x in found], "h": [x[1] for x in found], "sign": [x[2] for x in found]}).astype("int64")

    return peel


def estimate_difference(elements: DataFrame) -> int:
    """About how many elements only one side has: strata of halving size, each a small table, peeled from the thinnest."""
    e = F.xxhash64("k", "h").bitwiseAND(F.lit(2**63 - 1))
    low = e.bitwiseAND(-e).cast("double")
    stratum = F.when(e == 0, F.lit(_STRATA - 1)).otherwise(F.least(F.lit(_STRATA - 1), F.round(F.log2(low)).cast("long"))).cast("long")
    cells = _cells(elements, stratum, F.lit(_STRATA_CELLS).cast("long"))
    got = {r["b"]: (r["whole"], r["found"]) for r in cells.groupBy("b").applyInPandas(_count_peeled, "b long, whole boolean, found long").collect()}
    total = 0
    for i in range(_STRATA - 1, -1, -1):
        whole, found = got.get(i, (True, 0))
        if not whole:
            return max(1, total) * 2 ** (i + 1)
        total += found
    return total


def _count_peeled(cells: pd.DataFrame) -> pd.DataFrame:
    found, whole = _peel(cells, _STRATA_CELLS)
    return pd.DataFrame({"b": [int(cells["b"].iloc[0])], "whole": [whole], "found": [len(found)]})


def differing_keys(left: DataFrame, right: DataFrame, key: str, bucket_keys: int = 8192) -> tuple[DataFrame, str]:
    """Codes ``k`` of the keys whose rows differ, each once, and the path-free kind of bucket used ('range' or 'hash')."""
    names = [c for c in left.columns if c in right.columns and c != key]
    hashed = [
        df.where(F.col(key).isNotNull()).select(F.lit(sign).cast("int").alias("sign"), _key_code(key, {f.name: f.dataType for f in df.schema.fields}[key]).alias("k"), _row_hash(names, {f.name: f.dataType for f in df.schema.fields}).alias("h"))
        for df, sign in ((left, 1), (right, -1))
    ]
    kept = Kept(hashed[0].unionByName(hashed[1]))  # 20 bytes a row, read by each of the passes below
    elements = kept.df
    rows, ranges = elements.agg(F.count("*"), F.approx_count_distinct(F.floor(F.col("k") / bucket_keys))).first()
    if not rows:
        return elements.select("k"), "range"
    # Blocks of neighbouring keys keep a bucket's rows in few tasks; scattered keys are spread by hash.
    buckets = max(1, -(-rows // (2 * bucket_keys)))
    kind = "range" if ranges <= 2 * buckets + 8 else "hash"
    bucket = F.floor(F.col("k") / bucket_keys).cast("long") if kind == "range" else F.pmod(F.xxhash64("k"), F.lit(buckets).cast("long"))
    m = max(16, int(0.5 * 1.5 * estimate_difference(elements) / buckets) + 8)
    peeled = Kept(_cells(elements, bucket, F.lit(m).cast("long")).groupBy("b").applyInPandas(_peeler(m), "b long, k long, h long, sign long"))
    stuck = peeled.df.where("sign = 0").select("b").distinct()
    n_stuck = stuck.count()
    keys = peeled.df.where("sign != 0").select("k")
    if n_stuck:
        rest = elements.withColumn("b", bucket).join(small(stuck, n_stuck), "b", "left_semi")
        rest = rest.groupBy("k", "h").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi")).where("lo = hi").select("k")
        keys = keys.unionByName(rest)
    return keys.distinct(), kind


def diff_copies(left: DataFrame, right: DataFrame, key: str = "id", missing_in_right: str = "missing_in_right", missing_in_left: str = "missing_in_left") -> DataFrame:
    """Rows (key, kind, field): a key that one side lacks, with field '', or kind 'value' with a differing field's name."""
    lk, rk = ({f.name: f.dataType for f in df.schema.fields} for df in (left, right))
    names = [c for c in left.columns if c in right.columns and c != key]
    keys = Kept(differing_keys(left, right, key)[0]).df
    keys = small(keys, keys.count())
    # A field becomes one compared value, so that sides of different types are compared as strings.
    text = {c: lk[c] != rk[c] for c in names}

    def side(df: DataFrame, kinds: dict[str, T.DataType], tag: str) -> DataFrame:
        rows = df.withColumn("_k", _key_code(key, kinds[key])) if "_k" not in df.columns else df.drop("_k").withColumn("_k", _key_code(key, kinds[key]))
        rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "_k", *[(_comparable(F.col(f"`{c}`"), kinds[c]).cast("string") if text[c] else _comparable(F.col(f"`{c}`"), kinds[c])).alias(f"f{i}") for i, c in enumerate(names)])
        rows = rows.join(keys.withColumnRenamed("k", "_k"), "_k", "left_semi")
        packed = [F.struct(F.min(f"f{i}").alias("lo"), F.max(f"f{i}").alias("hi"), (F.count(f"f{i}") < F.count("*")).alias("gap")).alias(f"{tag}{i}") for i in range(len(names))]
        return rows.groupBy("_key").agg(F.lit(True).alias(f"has_{tag}"), *packed)

    both = side(left, lk, "l").join(side(right, rk, "r"), "_key", "full_outer")
    lost = F.when(F.col("has_r").isNull(), F.array(F.struct(F.lit(missing_in_right).alias("kind"), F.lit("").alias("field")))).when(
        F.col("has_l").isNull(), F.array(F.struct(F.lit(missing_in_left).alias("kind"), F.lit("").alias("field")))
    )
    differ = [F.when(~F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")), F.struct(F.lit("value").alias("kind"), F.lit(c).alias("field"))) for i, c in enumerate(names)]
    values = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<struct<kind:string,field:string>>")
    out = both.select(F.col("_key").alias(key), F.explode(F.coalesce(lost, values)).alias("d"))
    return out.select(key, "d.kind", "d.field")
