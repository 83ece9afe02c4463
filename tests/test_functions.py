"""Literal cases of the scalar functions, readers, sinks and operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from ledgerlark.functions import dates, geo, records, text, trigram
from ledgerlark.operators import bridge, linkage, quality, reshape, search, stats, unify
from ledgerlark.sources import readers, sinks
from ledgerlark.streaming import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "remark, refs",
    [
        ("SEE SERIAL PATENT NR 75921-09 FOR FEE PATENT", ["75921-09"]), ("SEE SERIAL PATENT NR 942795 AND 1196898 FOR FEE PATENT", ["942795", "1196898"]),
        ("NR 1; SEE SERIAL PATENT NR 957685 957686 AND 957687 FOR FEE PATENT", ["957685", "957686", "957687"]), ("SEE FEE PATENT NR 527838", ["527838"]), ("PATENT #706068", ["706068"]), ("", []), ("PAGE TORN", []),
    ],
)
def test_fee_references(spark, remark, refs):
    assert one(spark, remark, text.fee_references) == refs


def test_null_remark(spark):
    assert one(spark, None, text.fee_references) in (None, [])
    assert one(spark, None, text.is_cancelled) is False


def test_file_references(spark):
    got = one(spark, "ADDTIONAL IO #14329-08; b.i.a. 84348-26", text.file_references)
    assert [tuple(r) for r in got] == [("ADDTIONAL IO #14329-08", "ADDITIONAL IO", "14329", 1908), ("b.i.a. 84348-26", "BIA", "84348", 1926)]


@pytest.mark.parametrize("a, kind", [("NESW", "qqsec"), ("NE", "qsec"), ("12", "lot"), ("142", "large_lot"), ("1NE", "lot"), ("S½NE", "qsec"), ("W½SWSE", "qqsec"), ("N½", "half_section"), ("N½N½SE", "partial"), ("", "empty"), (None, "empty")])
def test_aliquot(spark, a, kind):
    assert one(spark, a, records.aliquot)[0] == kind


def test_names_and_keys(spark):
    assert one(spark, "LAST, FIRST; SMITH, ANN", text.flip_names) == "FIRST LAST; ANN SMITH"
    assert one(spark, " O'Neil & Sons ", text.slugify) == "oneil-sons"
    assert one(spark, "0123456", text.key_variants)[:3] == ["0123456", "123456", "00123456"]
    assert one(spark, "LIZZIE DOWD-JR. MRS X", text.name_tokens) == ["LIZZIE", "DOWD"]


def test_trigrams(spark):
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]
    assert pair("cat", "cart", trigram.similarity) == pytest.approx(2 / 7)
    assert pair("word", "two words", trigram.span_similarity) == pytest.approx(4 / 7)
    assert pair("", "x", trigram.similarity) == 0 and pair(None, "x", trigram.similarity) in (None, 0)


def test_dates(spark):
    for t, d in (("1910-02-03", dt.date(1910, 2, 3)), ("2/3/1910", dt.date(1910, 2, 3)), ("February 3, 1910", dt.date(1910, 2, 3)), ("about 1910", None), ("1910-02-31", None)):
        assert one(spark, t, dates.parse_date) == d
    assert one(spark, dt.date(2016, 2, 29), dates.fix_century, "date") == dt.date(1916, 2, 29)
    assert one(spark, dt.date(2000, 2, 29), dates.fix_century, "date") == dt.date(1900, 2, 28)


def test_parcel_pair(spark, rows):
    """Two trust patents and the fee patent of the same parcels, 15 years later."""
    trust = spark.createDataFrame([(1, "SD", None, dt.date(1891, 6, 13), "LIZZIE DOWD"), (2, "SD", None, None, "DOWD, LIZZIE")], "id int, s string, a string, d date, name string")
    fee = spark.createDataFrame([(9, "SD", None, dt.date(1906, 10, 29), "LIZZIE DOWD"), (8, "SD", None, dt.date(1880, 1, 1), "LIZZIE DOWD"), (7, "SD", None, dt.date(1906, 1, 1), "PETER OTHER")], "id int, s string, a string, d date, name string")
    assert rows(linkage.composite_links(trust, fee, ["s", "a"], "d", "name")) == [(1, 9, 15), (2, 8, None), (2, 9, None)]


def test_cascade_and_fuzzy(spark, rows):
    refs = spark.createDataFrame([(1, "000123456"), (2, "A-77"), (3, "nothing")], "id int, ref string")
    targets = spark.createDataFrame([("123456",), ("A77",), ("A77",), (None,)], "k string")
    assert rows(linkage.match_cascade(refs, targets, "ref", "k", ["id"])) == [(1, "000123456", "123456", "normalized"), (2, "A-77", "A77", "normalized")]
    people = spark.createDataFrame([(1, "111111", "ANN LEE", "OR"), (2, "111112", "LEE, ANN", "OR"), (3, "111113", "ANN LEE", "WA"), (4, "111119", None, None)], "id int, key string, name string, state string")
    assert rows(linkage.fuzzy_blocked(people, people)) == [(1, 2, 1), (2, 1, 1)]


def test_search(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else None, i * 1.5) for i in range(30)], "id int, name string, v double")
    spec = search.SearchSpec(equal={"name": "name"}, ranges={"v": "v"}, search=("name",), sortable=("name", "v"), default=(("v", "desc"),), ties=("id",))
    found = search.search(df, spec, {"name": "x", "v_from": 3.0, "v_to": None}, [], 2, 5)
    assert found.total.first()[0] == 30 and found.filtered.first()[0] == 14
    assert [r["id"] for r in found.page.collect()] == [25, 23, 21, 19, 17]
    assert search.page_rows(-3) == 50 and search.page_rows("9999") == 500 and search.page_rows("x") == 50
    with pytest.raises(ValueError):
        spec.predicate({"nope": 1})
    assert [r["id"] for r in df.orderBy(*spec.order([(7, "up")])).limit(2).collect()] == [0, 1]


def test_unify(spark, rows):
    mapped = spark.createDataFrame([("a", None), ("b", "mb")], "k string, v string")
    catalogue = spark.createDataFrame([("a", "ca"), ("c", "cc"), (None, "n")], "k string, v string")
    assert rows(unify.unified_view(mapped, catalogue, "k", ["v"])) == sorted([("a", "ca", True), ("b", "mb", True), ("c", "cc", False), (None, "n", False)], key=repr)


def test_reshape_and_quality(spark, rows):
    df = spark.range(2000).select((F.col("id") * 37 % 2000).alias("k"), F.lit("x").alias("v"))
    numbered = reshape.surrogate_ids(df, "k", name="n")
    assert numbered.where("n != k + 1").count() == 0
    gaps = quality.sequence_gaps(spark.createDataFrame([("SD2610__.247",), ("SD2610__.001",), ("bad",), (None,)], "a string"), "a")
    assert rows(gaps) == [("SD", "2610", 2, 247, 245, 0.8)]
    probes = spark.createDataFrame([("v", i, i in (2, 3, 7)) for i in range(1, 12)], "volume string, page int, hit boolean")
    assert rows(quality.stop_after_misses(probes, "volume", "page", "hit", 3)) == [("v", 6)]
    sample = quality.stratified_sample(spark.range(1000).select("id", (F.col("id") % 7 % 3).alias("s")), "id", "s", 100, "z")
    assert sample.count() == 100
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v long")
    reported = spark.createDataFrame([("a", 5), ("c", 1)], "k string, t long")
    assert rows(reshape.reconcile(items, "k", "v", reported, "t")) == sorted([("a", 5, 3, 2), ("b", None, 1, None), ("c", 1, 0, 1)], key=repr)
    bad = quality.violations(items.withColumn("id", F.monotonically_increasing_id()), "k", {"small": F.col("v") < 2}, {"unique": ["k"]})
    assert rows(bad) == [("small", "a"), ("unique", "a"), ("unique", "a")]


def test_stats(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("a", 10), ("b", 5), ("b", None)], "k string, v int")
    assert rows(stats.positional_quantiles(df, "k", "v")) == [("a", 2, 9, 10), ("b", 5, 5, 5)]
    counts = spark.createDataFrame([(1900, 2), (1903, 1)], "year long, n long")
    assert rows(stats.cumulative(counts, "year", ["n"], lead=1)) == [(1899, 0), (1900, 2), (1901, 2), (1902, 2), (1903, 3)]
    assert rows(stats.dominant(spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "k string, v string"), "k", "v")) == [("a", "x", 1)]


def test_geo(spark):
    df = spark.createDataFrame([([[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]],)], f"g {geo.POLYGONS}")
    assert tuple(df.select(geo.polygons_center(F.col("g"))).first()[0]) == (1.0, 0.5)
    assert '"type":"Point"' in df.select(geo.feature("Point", F.array(F.lit(1.0), F.lit(2.0)), F.struct(F.lit(1).alias("id")))).first()[0]


def test_readers(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('﻿id,when,ok,n\n1,1910-02-03,Yes,"1,200"\n2,bad,no,x\n3,,maybe,\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("when", T.DateType()), T.StructField("ok", T.BooleanType()), T.StructField("n", T.IntegerType())])
    assert rows(readers.read_csv(spark, str(tmp_path / "a.csv"), schema)) == [(1, dt.date(1910, 2, 3), True, 1200), (2, None, False, None), (3, None, None, None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/d1.json").write_text('{"extraction": {"name": "x"}}')
    (tmp_path / "j/d2.json").write_text('{"document_id": "two", "extraction": [{"name": "y"}, {"name": "z"}]}')
    (tmp_path / "j/d3.json").write_text("broken")
    got = readers.read_json_documents(spark, str(tmp_path / "j"), T.StructType([T.StructField("name", T.StringType())]))
    assert rows(got) == [("d1", 0, "x"), ("two", 0, "y"), ("two", 1, "z")]
    html = '<td id="glo_names">A, B<br/>C &amp; D</td><div id="glo_none">---</div><table><tr><td colspan=2>x</td><td>y</td></tr></table>'
    assert one(spark, html, lambda c: readers.html_field(c, "glo_names")) == "A, B; C & D"
    assert one(spark, html, lambda c: readers.html_field(c, "glo_none")) is None
    assert one(spark, html, readers.html_rows) == [["x", "x", "y"]]
    assert one(spark, "so: ```json\n{\"k\": 1}\n```", readers.tolerant_json) == '{"k": 1}'
    assert one(spark, "k = seven, j", lambda c: readers.loose_value(c, "k")) == "seven"


def test_sinks(spark, tmp_path, rows):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "k int, v string")
    assert rows(sinks.append_new(old, new, ["k"], F.col("v"))) == [(3, "d")]
    assert rows(sinks.upsert(old, new, ["k"], F.col("v"))) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(sinks.null_fill(old, new.dropDuplicates(["k"]).where("v != 'c'"), "k", ["v"]))[0] == (1, "a")
    path = str(tmp_path / "t")
    sinks.swap(old, path)
    sinks.swap(spark.read.parquet(path).where("k = 1"), path)
    assert rows(spark.read.parquet(path)) == [(1, "a")]
    sinks.write_csv(old.withColumn("b", F.lit(True)), str(tmp_path / "c"), {"k": "Key", "v": "Value", "b": "Mapped"})
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect() if not r[0].startswith("Key")) == ["1,a,Yes", "2,,Yes"]


def test_stream_equals_batch(spark, tmp_path, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=17 * i), i % 3, "click" if i % 2 else "view", 1.5, "{}") for i in range(300)]
    df = spark.createDataFrame(data + data[:50], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    events.run_once(events.once(stream), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 300
    events.run_once(events.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "c2"))
    closed = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert closed and closed <= set(map(tuple, events.tumbling(df).collect()))


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30), st.text(max_size=30))
def test_similarity_bounds(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    ab, ba = df.select(trigram.similarity(F.col("a"), F.col("b")), trigram.similarity(F.col("b"), F.col("a"))).first()
    assert ab == ba and 0 <= ab <= 1


@pytest.mark.parametrize(
    "f, given, want",
    [
        ("footnoted_count", "22 34,380,726", 34380726), ("footnoted_count", "3 512", 512), ("footnoted_count", "1,204 a", 1204), ("footnoted_count", "—", None), ("footnoted_count", "0", 0), ("footnoted_count", "", None), ("footnoted_count", None, None),
        ("tailnoted_number", "1,234.5 2", 1234.5), ("tailnoted_number", "0", None), ("tailnoted_number", "No answer", None), ("tailnoted_number", "12a", None), ("money", "$1,234.50", 1234.5), ("money", "0", 0.0), ("money", "…", None),
        ("agency_name", " Fort Hall consolidated 1", "Fort Hall"), ("leading_year", "1909 4", 1909), ("leading_year", "about 1909", None), ("page_says_missing", "<p>No records found.</p>", True), ("page_says_missing", "It could NOT be located", True),
        ("page_says_missing", "Object reference not set to", True), ("page_says_missing", "object reference not set to", False), ("page_says_missing", "the page was not found", False), ("page_says_missing", "A document does not exist in our database that", True),
        ("authority_name", "February 8, 1887: Indian Allotment - General (24 Stat. 388)", "Indian Allotment - General"), ("authority_name", "Indian Fee Patent (Heir)", None), ("reservation_core", "Coeur d'Alene (A.): Nez Perce (R.)", "Nez Perce"),
        ("reservation_core", "Crow (A. and R.)", "Crow"), ("reservation_core", "Crow", "Crow"), ("io_label", "ADDITIONAL I. O.", "yes"), ("io_label", "B BIA", "unknown"), ("io_label", "x", None), ("document_part", "Part12_x", 12), ("document_kind", "part1_Ledger_Entry_3", "ledger"),
        ("document_kind", None, "unknown"), ("cancellation_reason", "Refused; issued w/o application", "issued_without_application_and_acceptance_refused"), ("cancellation_reason", "1927 and 1931 Acts", "1927_and_1931_acts"), ("cancellation_reason", "Act of 1931", "1931_act"),
        ("cancellation_reason", " ", None), ("cancellation_reason", "lost", "other"), ("cancellation_reason", None, None), ("linked_remarks", "SEE NR 12", "SEE NR 12"),
    ],
)
def test_records(spark, f, given, want):
    assert one(spark, given, getattr(records, f)) == want


@pytest.mark.parametrize("a, value", [("NESW", "NESW"), ("12", "12"), ("1NE", "1"), ("S½NE", "NE"), ("W½SWSE", "SWSE"), ("N½", "N½"), ("N½N½SE", "N½N½SE"), ("", None), ("007", "007")])
def test_aliquot_value(spark, a, value):
    assert one(spark, a, records.aliquot)[1] == value


def test_record_keys(spark):
    df = spark.createDataFrame([("OK", "17", "10", "N", "3", "E", "26")], "s string, m string, t string, td string, r string, rd string, c string")
    assert df.select(records.section_key(*[F.col(c) for c in df.columns])).first()[0] == "OK170100N0030E0SN260"
    pad = lambda v: one(spark, v, lambda c: records.padded(c, 3))
    assert [pad("3.0"), pad("12345"), pad("x"), pad(None)] == ["003", "12345", "", ""]
    assert tuple(one(spark, " 1007-37 ", records.reference_key)) == ("1007", "37", None) and tuple(one(spark, "42", records.reference_key)) == (None, None, 42)
    url = lambda c: one(spark, c, lambda x: records.record_url(F.lit("A1"), x)).rsplit("=", 1)[1]
    assert [url("State Land Patent"), url("IA"), url("An unknown class"), url("")] == ["STA", "IA", "SER", "SER"] and one(spark, "", lambda c: records.record_url(c, c)) is None
    assert 'accession=75921&' in one(spark, "SEE NR. 75921 AND 1234", records.linked_remarks)


@pytest.mark.parametrize("sizes, n", [([50] * 20, 10), ([1] * 20, 10), ([500, 3, 1, 1], 50), ([7, 7, 7], 30), ([10, 20, 30, 40], 33), ([999, 1], 4), ([5], 5)])
def test_stratified_sample_is_exact(spark, sizes, n):
    """As giving back and taking places one by one does; never more rows than asked for, never fewer than there are."""
    rows = [(f"s{i:02}" if i else None, f"{i}-{k}") for i, size in enumerate(sizes) for k in range(size)]
    got = quality.stratified_sample(spark.createDataFrame(rows, "s string, k string"), "k", "s", n, "seed")
    drawn = {r["s"]: r["n"] for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert sum(drawn.values()) == min(n, sum(sizes))
    size = {f"s{i:02}" if i else None: s for i, s in enumerate(sizes)}
    quota = {s: min(k, max(1, round(n * k / sum(sizes)))) for s, k in size.items()}
    first = lambda s: s or ""
    while sum(quota.values()) > n:
        quota[min(quota, key=lambda s: (-quota[s], first(s)))] -= 1
    while sum(quota.values()) < min(n, sum(sizes)):
        quota[min(quota, key=lambda s: (quota[s] - size[s], first(s)))] += 1
    assert drawn == {s: q for s, q in quota.items() if q}


def test_bridge(spark, rows):
    claims = spark.createDataFrame([(1, "0012", "ANN"), (2, "12", "BEN"), (3, None, "ANN"), (4, "7", None)], "id int, case_number string, allottee_name string")
    links = spark.createDataFrame([("12", "ANN", "A1"), ("012", "ANN", "A2"), (None, "ANN", "A3"), ("7", None, "A4")], "bridge_case string, bridge_name string, accession string")
    assert rows(bridge.bridge_join(claims, links).select("id", "accession")) == [(1, "A1"), (1, "A2"), (2, None), (3, None), (4, None)]
    assert bridge.bridge_join(claims, links, "inner").count() == 2 and bridge.bridge_join(claims, links.limit(0), "inner").count() == 0


def test_reservation_match(spark, rows):
    labels = spark.createDataFrame([("Crow (A. and R.)", "Crow"), ("Nez", "Nez"), ("Fort Something", "Fort Something"), ("Wind Cave", "Wind Cave"), ("skip", "skip"), ("zzz", "zzz"), ("Big Crow Creek", "Big Crow Creek")], "label string, core string")
    names = spark.createDataFrame([("Crow", 5), ("Nez Perce", 3), ("Fort Hall", 2), ("Fort Peck", 2), ("Wind River", 9), ("Crow Creek", 7)], "name string, n int")
    got = {r["label"]: (r["name"], r["method"]) for r in bridge.match_reservations(labels, names, {"skip": None}).collect()}
    assert got == {"Crow (A. and R.)": ("Crow Creek", "substring"), "Nez": ("Nez Perce", "substring"), "Fort Something": (None, "unmatched"), "Wind Cave": ("Wind River", "first_word"), "skip": (None, "no_match"), "zzz": (None, "unmatched"), "Big Crow Creek": ("Crow Creek", "substring")}


def test_feature_and_output_readers(spark, rows):
    text = ['{"attributes": {"k": 1, "d": -86400000}, "centroid": {"x": 1.5, "y": 2}, "geometry": {"rings": [[[0, 0], [1, 0], [0, 0]]]}}', '{"attributes": {"k": 2}, "geometry": {"x": 3, "y": 4}}', '{"attributes": {"k": 3}}', "broken", None]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("d", T.LongType())])
    got = rows(readers.feature_rows(spark.createDataFrame([(t,) for t in text], "t string"), "t", schema, ("d",)))
    assert [(r[0], str(r[1]), r[2]) for r in got] == [(1, "1969-12-31", 1.5), (2, "None", None), (3, "None", None)] and "Polygon" in got[0][4] and "Point" in got[1][4] and got[2][4] is None
    files = spark.createDataFrame([(1, '[{"a": "x", "v": 1}, {"a": "y", "v": 2}]'), (2, '{"a": "x", "v": 3}'), (3, "no json"), (4, None)], "f int, t string")
    assert {r["a"]: r["output"] for r in readers.model_outputs(files, "t", "a", "f").collect()} == {"x": '{"a": "x", "v": 3}', "y": '{"a":"y","v":2}'}
    assert readers.load_share(95, 100) and not readers.load_share(94, 100) and not readers.load_share(0, 0)
    sheet = spark.createDataFrame([(1, " a ", ""), (2, "", " "), (3, None, "b")], "source_row int, _c0 string, _c1 string")
    assert rows(readers.spreadsheet_rows(sheet, ["x", "y"])) == [(1, "a", None), (3, None, "b")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_blocked_is_brute_force(spark, rows):
    """Keys of any kind and length, hot tokens, null states: as comparing every row with every row."""
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("12A") for _ in range(rng.randrange(1, 9)))
    data = [(i, key(), rng.choice(["ANN LAMEBEAR", "ANN CROW", "BEN CROW", "Ann", "", None]), rng.choice(["OR", "WA", None])) for i in range(120)] + [(900, None, "ANN", "OR")]
    tokens = lambda n: set(sorted(set(t for t in (n or "").upper().split() if len(t) > 1))[:2])
    want = []
    for i, k, n, s in data:
        near = [(edits(k, k2), j) for j, k2, n2, s2 in data if k is not None and k2 is not None and i != j and tokens(n) & tokens(n2) and (s is None or s2 is None or s == s2) and edits(k, k2) <= 2]
        if near:
            want.append((i, min(near)[1], min(near)[0]))
    df = spark.createDataFrame(data, "id int, key string, name string, state string")
    assert rows(linkage.fuzzy_blocked(df, df)) == sorted(want, key=repr)


def test_evidence_tiers(spark):
    d = dt.date
    pairs = [
        (1, "A", 1.0, True, d(1910, 1, 1), 11), (1, "A", 1.0, True, d(1905, 1, 1), 12), (2, "A", 0.8, True, d(1901, 1, 1), 21), (2, "A", 0.9, True, d(1950, 1, 1), 22), (3, "A", 0.66, True, None, 31), (4, "A", 1.0, False, None, 41),
        (5, "A", 0.9, None, None, 51), (6, "A", 1.0, True, None, 61), (6, "B", 1.0, True, None, 62), (7, "A", 1.0, True, None, 71), (7, "A", 1.0, True, d(1930, 1, 1), 72),
    ]
    df = spark.createDataFrame(pairs, "id int, label string, s double, same boolean, at date, sib int")
    got = {r["id"]: (r["tier"], r["label"], r["sibling"]) for r in linkage.evidence_tier(df, "id", "label", "s", "same", "at", "sib").collect()}
    assert got == {1: ("T1", "A", 12), 2: ("T2", "A", 22), 3: ("T3", None, None), 4: ("T4", None, None), 5: ("T5", None, None), 6: ("disagreement", None, None), 7: ("T1", "A", 72)}


@pytest.mark.parametrize("query, ids", [("roberts", {1, 2, 4}), ("rush roberts", {1}), ("Rush Robertss", {1}), ("caleb of the hill", {3}), ("zzz", set())])
def test_person_search(spark, query, ids):
    """First and last name of the same person; a literal hit needs no person."""
    df = spark.createDataFrame([(1, "RUSH ROBERTS"), (2, "ANN ROBERTS"), (3, "CALEB OF THE HILL"), (4, "ROBERTS CO"), (5, None), (6, "RUSH CROW; ANN SMITH")], "id int, full_name string")
    persons = spark.createDataFrame([(1, "RUSH", "ROBERTS"), (2, "ANN", "ROBERTS"), (6, "RUSH", "CROW"), (6, "ANN", "SMITH"), (5, None, None)], "id int, first string, last string")
    got = search.person_search(df, persons, "id", "full_name", query).collect()
    assert {r["id"] for r in got} == ids and all(r["match_type"] == ("exact" if query.lower() in r["full_name"].lower() else "fuzzy") for r in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abAB é'1", max_size=14), min_size=20, max_size=20), st.text(alphabet="abé 1", min_size=1, max_size=9), st.sampled_from([0.3, 0.65, 1.0]))
def test_may_reach_loses_nothing(spark, texts, query, threshold):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(trigram.may_reach(F.col("t"), query, threshold), trigram.similarity(F.col("t"), F.lit(query)) >= threshold).collect()
    assert all(may or not does for may, does in got)


def test_grid_filters(spark, rows):
    spec = search.SearchSpec(like={"code": "code"}, integers={"n": "n"}, buckets={"size": {"small": "n < 3", "large": "n >= 3"}}, sortable=("n",), ties=("code",))
    df = spark.createDataFrame([("a1", 1), ("A2", 4), ("b", None)], "code string, n int")
    found = lambda p: sorted(r["code"] for r in search.search(df, spec, p).page.collect())
    assert [found(p) for p in ({"code": "a_"}, {"min_n": "2"}, {"max_n": "x"}, {"size": "small"}, {"size": "?"}, {"min_n": 1, "max_n": "1"})] == [["A2", "a1"], ["A2"], ["A2", "a1", "b"], ["a1"], ["A2", "a1", "b"], ["a1"]]
    with pytest.raises(ValueError):
        search.search(df, spec, {"nothing": 1})
