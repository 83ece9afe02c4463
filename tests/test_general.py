"""Packed values, copy differences and orphan references on small cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions.hashing import xx_longs
from ledgerlark.operators.copy_diff import diff_copies, estimate_difference
from ledgerlark.operators.orphans import find_orphans, orphan_report
from ledgerlark.operators.packed_values import delimiter_scores, split_packed, split_pieces
from ledgerlark.runtime import Kept, finished, small

COPY = "id int, a string, b string, n int"


def test_hash_twin(spark):
    values = [(0, 0), (1, -1), (2**62, 5), (-(2**63), 2**63 - 1)]
    got = [r[0] for r in spark.createDataFrame(values, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert got == xx_longs(np.array([v[0] for v in values]), np.array([v[1] for v in values])).tolist()


def brute(left, right):
    """Differences by comparing every row."""
    out = set()
    for i in {r[0] for r in left + right} - {None}:
        a, b = {r for r in left if r[0] == i}, {r for r in right if r[0] == i}
        if not b:
            out.add((i, "missing_in_right", ""))
        elif not a:
            out.add((i, "missing_in_left", ""))
        else:
            for k, name in ((1, "a"), (2, "b"), (3, "n")):
                lo = lambda s: min((r[k] for r in s if r[k] is not None), default=None)  # noqa: B023, E731
                hi = lambda s: max((r[k] for r in s if r[k] is not None), default=None)  # noqa: B023, E731
                if (lo(a), hi(a), any(r[k] is None for r in a)) != (lo(b), hi(b), any(r[k] is None for r in b)):
                    out.add((i, "value", name))
    return out


CASES = {
    "plain": ([(1, "x", "", 1), (2, "x", None, 2), (3, "q", "q", 3)], [(1, "x", None, 1), (2, "y", None, 2), (4, "q", "q", 3)]),
    "swapped nulls": ([(1, "x", None, None)], [(1, None, "x", None)]),
    "repeated": ([(1, "x", "y", 1)], [(1, "x", "y", 1)] * 3 + [(2, "x", "y", 1)] * 2),
    "several values": ([(1, "x", "y", 1), (1, "z", "y", 1)], [(1, "x", "y", 1)]),
    "null keys": ([(None, "x", "y", 1)], [(None, "z", "y", 1)]),
    "empty left": ([], [(1, "x", "y", 1)]),
    "both empty": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_diff_cases(spark, rows, name):
    left, right = CASES[name]
    got = diff_copies(spark.createDataFrame(left, COPY), spark.createDataFrame(right, COPY))
    assert rows(got) == sorted(brute(left, right), key=repr)


def test_diff_many_and_hot(spark, rows):
    left = [(i, f"v{i % 7}", None if i % 5 else "t", i) for i in range(4000)] + [(7, "hot", "hot", 7)] * 1500
    right = [(i, f"v{i % 7}" + "!" * (i % 11 == 0), None if i % 5 else "t", i) for i in range(200, 4300)] + [(7, "hot", "cold", 7)] * 1500
    got = diff_copies(spark.createDataFrame(left, COPY), spark.createDataFrame(right, COPY))
    assert rows(got) == sorted(brute(left, right), key=repr)


def test_diff_string_keys_and_extra_columns(spark, rows):
    left = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "id string, v int, _k int")
    right = spark.createDataFrame([("a", 1, "x", 5), ("c", 2, "x", 6)], "id string, v int, other string, _k int")
    assert rows(diff_copies(left, right)) == [("b", "missing_in_right", ""), ("c", "missing_in_left", "")]


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(-(2**40), 2**40), max_size=300), st.sets(st.integers(-(2**40), 2**40), max_size=300))
def test_diff_random_keys(spark, a, b):
    left, right = ([(k, k * 3) for k in s] for s in (a, b))
    got = diff_copies(spark.createDataFrame(left, "id long, v long"), spark.createDataFrame(right, "id long, v long"))
    assert {(r[0], r[1]) for r in got.collect()} == {(k, "missing_in_right") for k in a - b} | {(k, "missing_in_left") for k in b - a}


def test_estimate(spark):
    both = spark.range(20000).select(F.lit(1).alias("sign"), F.col("id").alias("k"), F.xxhash64("id").alias("h"))
    other = spark.range(1000, 20000).select(F.lit(-1).alias("sign"), F.col("id").alias("k"), F.xxhash64("id").alias("h"))
    assert 300 <= estimate_difference(both.unionByName(other)) <= 3000


def t(day, hour=0):
    return dt.datetime(2020, 1, day, hour)


def test_orphans(spark, rows):
    refs = spark.createDataFrame([(1, "A", t(5)), (2, "A", t(1)), (3, "B", t(5)), (4, "C", t(5)), (5, None, t(5)), (6, "", t(5)), (7, "A", None), (8, "C", None), (9, "A", t(2))], "id int, k string, at timestamp_ntz")
    parents = spark.createDataFrame([("A", t(2)), ("A", t(9)), ("D", None)], "p string, at timestamp_ntz")
    other = spark.createDataFrame([("B",), ("B",), (None,)], "p string")
    got = find_orphans([("r", refs, "id", "k", "at")], parents, "p", "at", other, "p")
    assert rows(got) == sorted([("r", 2, "late", "2020-01"), ("r", 3, "deleted", "2020-01"), ("r", 4, "missing", "2020-01"), ("r", 6, "missing", "2020-01"), ("r", 8, "missing", None)], key=repr)
    assert rows(orphan_report(got))[0] == ("r", "2020-01", "deleted", 1)


def test_orphans_hot_and_empty(spark, rows):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id"))).alias("k"), F.lit(t(5)).cast("timestamp_ntz").alias("at"))
    none = spark.createDataFrame([], "p string, at timestamp_ntz")
    assert find_orphans([("r", refs, "id", "k", "at")], none, "p", "at", batch=100).count() == 3000
    some = spark.createDataFrame([("HOT", t(4))], "p string, at timestamp_ntz")
    assert find_orphans([("r", refs, "id", "k", "at")], some, "p", "at", batch=100).count() == 1000
    assert find_orphans([("r", refs.limit(0), "id", "k", "at")], some, "p", "at").count() == 0


TEXTS = {
    None: [], "": [], "  ": [], "ONE NOTE": ["ONE NOTE"], "ONE NOTE;": ["ONE NOTE"], "A; B|C\nD, E / F": ["A", "B", "C", "D", "E", "F"], "W 1/2 NE 1/4 ONLY": ["W 1/2 NE 1/4 ONLY"],
    '"X; Y"; Z': ["X; Y", "Z"], '"MARKED ""FEE"", LOT 3",B': ['MARKED "FEE", LOT 3', "B"], '1) A 2) "B / C" 3) D': ["A", "B / C", "D"], "1) A; 2) B": ["A", "B"], "A /  / B": ["A", "B"],
    '"never closed; B': ['"never closed', "B"], ";;;": [], '"A" ; ""; B': ["A", "B"], "x" * 100_000 + ";y": ["x" * 100_000, "y"], 'SAID "NO" THEN; B': ['SAID "NO" THEN', "B"],
}


def test_split_pieces(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(df.select("i", split_pieces(F.col("t"), [";", "|", "\n", ",", " / "])).collect())
    assert [got[i] or [] for i in range(len(TEXTS))] == list(TEXTS.values())


def test_split_packed_infers(spark, rows):
    notes = ["PAGE TORN", "LOT 4", "NAME ILLEGIBLE", "DEED 7", "E 1/2 SEC 5"]
    data = [(i, notes[i % 5], "s1") for i in range(100)] + [(100 + i, f"{notes[i % 4]}; {notes[(i + 1) % 4]}", "s1") for i in range(50)] + [(200 + i, f"{notes[i % 4]}|{notes[(i + 2) % 4]}", None) for i in range(50)]
    df = spark.createDataFrame(data + [(999, None, "s1"), (998, " ", None)], "id int, t string, src string").withColumn("_text", F.lit(1)).withColumn("pos", F.lit("x"))
    scores = {(r["source"], r["delimiter"]): r["score"] for r in delimiter_scores(df, "t", "src").collect()}
    assert scores["s1", ";"] > 0.7 and scores[None, "|"] > 0.7
    got = rows(split_packed(df, "t", ["id"], "src"))
    want = [(i, k + 1, n) for i, t, _ in data if i >= 100 for k, n in enumerate(t.replace("|", ";").split(";"))]
    assert got == sorted([(i, k, n.strip()) for i, k, n in want], key=repr)
    assert split_packed(df.limit(0), "t", ["id"], "src").count() == 0


NOTES = ["PAGE TORN", "LOT 4", "DEED 7 OF 1911", "NAME ILLEGIBLE", "E 1/2 SEC 5", "SHARE - ALIKE"]
OWNERS = ["MARTIN, JOHN", "LAME BEAR, ANN", "WEKODI, PETER"]


def test_sources_disagree(spark, rows):
    """A comma is content in one source and separates in another; two sources use signs that nobody foresaw. No constant set of delimiters splits all four right."""
    packed = []  # (source, pieces, text)
    for i in range(120):
        a, b = NOTES[i % 6], NOTES[(i + 1 + i % 4) % 6]
        packed += [("names", [OWNERS[i % 3], OWNERS[(i + 1) % 3]], f"{OWNERS[i % 3]}; {OWNERS[(i + 1) % 3]}"), ("commas", [a, b], f"{a}, {b}"), ("tilde", [a, b], f"{a}~{b}"), ("slashes", [a, b], f"{a}//{b}")]
    single = [(s, n) for s, own in (("names", OWNERS), ("commas", NOTES), ("tilde", NOTES), ("slashes", NOTES)) for n in own for _ in range(30)]
    data = [(i, t, s) for i, (s, _, t) in enumerate(packed)] + [(10_000 + i, n, s) for i, (s, n) in enumerate(single)]
    df = spark.createDataFrame(data, "id int, t string, src string")
    want = sorted(((i, k + 1, n) for i, (_, p, _) in enumerate(packed) for k, n in enumerate(p)), key=repr)
    assert rows(split_packed(df, "t", ["id"], "src")) == want
    for constant in ([";"], [",", ";"], [";", "~", "//"], [",", ";", "~", "//"], [";", "|", "\n", ",", " / "]):
        fixed = df.select("id", F.posexplode(split_pieces(F.col("t"), constant)).alias("pos", "note"))
        several = fixed.groupBy("id").count().where("count > 1").select("id")
        assert rows(fixed.join(several, "id", "left_semi").select("id", F.col("pos") + 1, "note")) != want


def test_orphans_many_ranges(spark, rows):
    """Ranges, salts and arrays give what comparing every reference with every parent gives."""
    rng = np.random.default_rng(2)
    refs = [(int(i), f"K{rng.integers(60)}" if i % 3 else "HOT", t(1 + int(rng.integers(20)))) for i in range(900)]
    parents = [(f"K{k}", t(1 + int(rng.integers(20)))) for k in rng.integers(60, size=50)] + [("HOT", t(10))] * 40
    other = [(f"K{k}",) for k in rng.integers(80, size=30)]
    first, gone = {}, {k for k, in other}
    for k, at in parents:
        first[k] = min(at, first.get(k, at))
    want = [("r", i, "late" if k in first else "deleted" if k in gone else "missing", f"{at:%Y-%m}") for i, k, at in refs if k not in first or first[k] > at]
    frames = spark.createDataFrame(refs, "id int, k string, at timestamp_ntz"), spark.createDataFrame(parents, "p string, at timestamp_ntz"), spark.createDataFrame(other, "p string")
    for batch in (7, 100, 50_000):
        assert rows(find_orphans([("r", frames[0], "id", "k", "at")], frames[1], "p", "at", frames[2], "p", batch=batch)) == sorted(want, key=repr)


def test_small_counts_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "a string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, limit=5000)) and hinted(small(spark.range(10), 10, limit=80)) and not hinted(small(spark.range(10), 11, limit=80))


def test_small_counts_the_hash_table(spark):
    # A million keys of 8 bytes take some 70 MB once they are hashed.
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(spark.range(10), 100_000)) and not hinted(small(spark.range(10), 1_000_000)) and not hinted(small(spark.range(1_000_000)))


def test_kept_leaves_no_shuffle_files(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = blocks()
    kept = Kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert blocks() <= before and kept.df.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_finished_drops_what_it_wrote(spark):
    made = []

    def build():
        made.append(Kept(spark.range(5)))
        return made[0].df.where("id > 1")

    assert finished(build).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(made[0].path).count()
