"""Queries of statistics, reshaping, audits, merges, documents, geometry and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerlark.functions.geo import POLYGONS, feature, haversine_km, polygons_center, ring_center
from ledgerlark.functions.text import FEE_AUTHORITIES, TRUST_AUTHORITIES, blank_to_null, flip_names, patent_class
from ledgerlark.operators.quality import agreement, field_tallies, sequence_gaps, stop_after_misses, stratified_sample, symmetric_difference, violations
from ledgerlark.operators.reshape import melt, reconcile, row_sum, signed_split, surrogate_ids
from ledgerlark.operators.stats import cumulative, flow, positional_quantiles, timeline, variation
from ledgerlark.operators.unify import first_per_key
from ledgerlark.plans.catalogue_queries import _CLOUD, _FEE, _TRUST, _cloud
from ledgerlark.plans.registry import Registry
from ledgerlark.runtime import table
from ledgerlark.sources.readers import document_records, html_escaped, html_field, html_rows, loose_value, tolerant_json
from ledgerlark.sources.sinks import append_new, null_fill, relabel, upsert
from ledgerlark.streaming.events import once, sessions, tumbling

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
_CLASS = f"CASE WHEN authority IN ({_FEE}) THEN 'fee' WHEN authority IN ({_TRUST}) THEN 'trust' ELSE 'other' END"


def _rails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rails_patents")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trust_fee_linkages_recovered")


@query(f"""SELECT CAST(year(signature_date) AS BIGINT) AS year, CAST(count(*) FILTER (WHERE authority IN ({_FEE})) AS BIGINT) AS fee, CAST(count(*) FILTER (WHERE authority IN ({_TRUST})) AS BIGINT) AS trust, CAST(count(*) FILTER (WHERE authority NOT IN ({_FEE}) AND authority NOT IN ({_TRUST})) AS BIGINT) AS other
FROM rails_patents WHERE year(signature_date) BETWEEN 1850 AND 2018 GROUP BY 1""")
def patents_timeline_pivot(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("authority")
    fee, trust = a.isin(FEE_AUTHORITIES), a.isin(TRUST_AUTHORITIES)
    return timeline(_rails(spark, d), F.year("signature_date"), {"fee": fee, "trust": trust, "other": ~fee & ~trust}, 1850, 2018)


@query("""WITH p AS (SELECT year(signature_date) AS y, count(*) AS n, sum(total_acres) AS acres FROM rails_patents WHERE signature_date IS NOT NULL GROUP BY 1), l AS (SELECT year(fee_date) AS y, count(*) AS n FROM trust_fee_linkages_recovered WHERE fee_date IS NOT NULL GROUP BY 1)
SELECT CAST(p.y AS BIGINT) AS year, CAST(p.n AS BIGINT) AS patents, CAST(p.acres AS DOUBLE) AS acres, CAST(l.n AS BIGINT) AS linked FROM p LEFT JOIN l ON p.y = l.y""")
def timeline_overlay(spark: SparkSession, d: str) -> DataFrame:
    patents = _rails(spark, d).where("signature_date IS NOT NULL").groupBy(F.year("signature_date").cast("long").alias("year")).agg(F.count("*").alias("patents"), F.sum("total_acres").cast("double").alias("acres"))
    return patents.join(timeline(_links(spark, d), F.year("fee_date"), {"linked": F.lit(True)}), "year", "left")


_STAGES = f"""(SELECT count(*) FILTER (WHERE authority IN ({_TRUST})) AS trust, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee, count(*) FILTER (WHERE cancelled_doc) AS cancelled, (SELECT count(DISTINCT trust_accession) FROM trust_fee_linkages_recovered WHERE fee_accession IS NOT NULL) AS converted FROM rails_patents)"""


@query(f"""SELECT * FROM (SELECT 'patents' AS source, 'trust' AS target, CAST(trust AS BIGINT) AS value FROM {_STAGES} UNION ALL SELECT 'patents', 'fee', fee FROM {_STAGES} UNION ALL SELECT 'patents', 'cancelled', cancelled FROM {_STAGES} UNION ALL SELECT 'trust', 'converted', converted FROM {_STAGES} UNION ALL SELECT 'trust', 'remained', trust - converted FROM {_STAGES}) WHERE value > 0""")
def flow_nodes_links(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("authority")
    counts = _rails(spark, d).agg(F.count_if(a.isin(TRUST_AUTHORITIES)).alias("trust"), F.count_if(a.isin(FEE_AUTHORITIES)).alias("fee"), F.count_if("cancelled_doc").alias("cancelled"))
    linked = _links(spark, d).where("fee_accession IS NOT NULL").agg(F.countDistinct("trust_accession").alias("converted"))
    stages = counts.crossJoin(linked).withColumn("remained", F.col("trust") - F.col("converted"))  # one row each
    return flow(stages, [("patents", "trust", "trust"), ("patents", "fee", "fee"), ("patents", "cancelled", "cancelled"), ("trust", "converted", "converted"), ("trust", "remained", "remained")])


@query("""SELECT fee_state AS state, CAST(count(*) AS BIGINT) AS n, quantile_cont(date_gap_years, 0.5) AS median_years, CAST(count(*) FILTER (WHERE date_gap_years < 10) AS BIGINT) AS fast, CAST(count(*) FILTER (WHERE date_gap_years >= 10 AND date_gap_years < 25) AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE date_gap_years >= 25) AS BIGINT) AS slow
FROM trust_fee_linkages_recovered WHERE date_gap_years >= 0 AND date_gap_years < 200 GROUP BY 1""")
def flow_timing(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("date_gap_years")
    rows = _links(spark, d).where((g >= 0) & (g < 200))
    return rows.groupBy(F.col("fee_state").alias("state")).agg(F.count("*").alias("n"), F.percentile("date_gap_years", 0.5).alias("median_years"), F.count_if(g < 10).alias("fast"), F.count_if((g >= 10) & (g < 25)).alias("medium"), F.count_if(g >= 25).alias("slow"))


_ACRES = f"""(SELECT l.id, t.total_acres AS ta, f.total_acres AS fa, f.state, f.glo_tribe_name FROM trust_fee_linkages_recovered l JOIN (SELECT accession_number, min(total_acres) AS total_acres FROM rails_patents GROUP BY 1) t ON l.trust_accession = t.accession_number JOIN (SELECT accession_number, min(total_acres) AS total_acres, min(state) AS state, min(glo_tribe_name) AS glo_tribe_name FROM rails_patents GROUP BY 1) f ON l.fee_accession = f.accession_number)"""


def _acres(spark: SparkSession, d: str) -> DataFrame:
    p = _rails(spark, d).groupBy("accession_number").agg(F.min("total_acres").alias("acres"), F.min("state").alias("state"), F.min("glo_tribe_name").alias("tribe"))
    trust, fee = p.select(F.col("accession_number").alias("trust_accession"), F.col("acres").alias("ta")), p.select(F.col("accession_number").alias("fee_accession"), F.col("acres").alias("fa"), "state", "tribe")
    return _links(spark, d).select("id", "trust_accession", "fee_accession").join(trust, "trust_accession").join(fee, "fee_accession")


@query(f"""SELECT CAST(round(sum(ta)) AS BIGINT) AS trust_acres, CAST(round(sum(fa)) AS BIGINT) AS fee_acres, CAST(count(*) FILTER (WHERE fa < ta) AS BIGINT) AS shrunk, CAST(count(*) FILTER (WHERE fa = ta) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE fa > ta) AS BIGINT) AS grew, CAST(sum(coalesce(ta, 0) - coalesce(fa, 0)) AS DOUBLE) AS lost FROM {_ACRES}""")
def flow_acreage(spark: SparkSession, d: str) -> DataFrame:
    ta, fa = F.col("ta"), F.col("fa")
    return _acres(spark, d).agg(F.round(F.sum(ta)).cast("long").alias("trust_acres"), F.round(F.sum(fa)).cast("long").alias("fee_acres"), F.count_if(fa < ta).alias("shrunk"), F.count_if(fa == ta).alias("same"), F.count_if(fa > ta).alias("grew"), F.sum(F.coalesce(ta, F.lit(0)) - F.coalesce(fa, F.lit(0))).cast("double").alias("lost"))


@query("""SELECT CASE WHEN date_gap_years < 0 THEN 'backwards' WHEN date_gap_years < 5 THEN 'under 5' WHEN date_gap_years < 15 THEN '5-14' WHEN date_gap_years < 25 THEN '15-24' ELSE '25 and more' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM trust_fee_linkages_recovered WHERE date_gap_years IS NOT NULL GROUP BY 1""")
def flow_speed_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("date_gap_years")
    bucket = F.when(g < 0, "backwards").when(g < 5, "under 5").when(g < 15, "5-14").when(g < 25, "15-24").otherwise("25 and more")
    return _links(spark, d).where(g.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT glo_tribe_name AS tribe, CAST(sum(fa) AS DOUBLE) AS acres FROM {_ACRES} WHERE glo_tribe_name IS NOT NULL AND fa IS NOT NULL GROUP BY 1 ORDER BY sum(fa) DESC, 1 LIMIT 10")
def flow_top10(spark: SparkSession, d: str) -> DataFrame:
    sums = _acres(spark, d).where("tribe IS NOT NULL AND fa IS NOT NULL").groupBy("tribe").agg(F.sum("fa").alias("acres"))
    return sums.orderBy(F.desc("acres"), "tribe").limit(10).select("tribe", F.col("acres").cast("double").alias("acres"))


@query(f"""WITH f AS (SELECT state, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee FROM rails_patents WHERE state IS NOT NULL GROUP BY 1), c AS (SELECT state, count(*) AS forced FROM federal_register_claims WHERE claim_type ILIKE '%FORCED FEE%' AND state IS NOT NULL GROUP BY 1)
SELECT f.state, CAST(fee AS BIGINT) AS fee, CAST(coalesce(forced, 0) AS BIGINT) AS forced, least(round(coalesce(forced, 0) * 100.0 / fee, 1), 100.0) AS rate FROM f LEFT JOIN c ON f.state = c.state WHERE fee >= 20""")
def claims_rate(spark: SparkSession, d: str) -> DataFrame:
    fee = _rails(spark, d).where("state IS NOT NULL").groupBy("state").agg(F.count_if(F.col("authority").isin(FEE_AUTHORITIES)).alias("fee")).where("fee >= 20")
    forced = table(spark, d, "federal_register_claims").where(F.col("claim_type").ilike("%FORCED FEE%") & F.col("state").isNotNull()).groupBy("state").agg(F.count("*").alias("forced"))
    out = fee.join(forced, "state", "left").na.fill(0, ["forced"])
    return out.withColumn("rate", F.least(F.round(F.col("forced") * F.lit(100.0) / F.col("fee"), 1), F.lit(100.0)))


@query("""WITH r AS (SELECT state, count(*) AS tribes FROM tribe_reference GROUP BY 1), p AS (SELECT state, count(*) AS patents, sum(total_acres) AS acres, count(*) FILTER (WHERE cancelled_doc) AS cancelled FROM rails_patents GROUP BY 1)
SELECT r.state, CAST(tribes AS BIGINT) AS tribes, CAST(coalesce(patents, 0) AS BIGINT) AS patents, CAST(greatest(coalesce(patents, 0), tribes) AS BIGINT) AS base, CAST(coalesce(acres, 0) AS DOUBLE) AS acres, round(coalesce(cancelled, 0) * 100.0 / nullif(patents, 0), 1) AS cancelled_pct FROM r LEFT JOIN p ON r.state = p.state""")
def reservation_baseline(spark: SparkSession, d: str) -> DataFrame:
    tribes = table(spark, d, "tribe_reference").groupBy("state").agg(F.count("*").alias("tribes"))
    patents = _rails(spark, d).groupBy("state").agg(F.count("*").alias("patents"), F.sum("total_acres").alias("acres"), F.count_if("cancelled_doc").alias("cancelled"))
    n = F.coalesce("patents", F.lit(0))
    return tribes.join(patents, "state", "left").select("state", "tribes", n.alias("patents"), F.greatest(n, F.col("tribes")).alias("base"), F.coalesce(F.col("acres").cast("double"), F.lit(0.0)).alias("acres"), F.round(F.try_divide(F.coalesce("cancelled", F.lit(0)) * F.lit(100.0), F.col("patents")), 1).alias("cancelled_pct"))


@query(f"""WITH y AS (SELECT glo_tribe_name AS tribe, {_CLASS} AS class, year(signature_date) AS year FROM rails_patents WHERE glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL),
m AS (SELECT tribe, quantile_cont(year, 0.5) FILTER (WHERE class = 'trust') AS trust_year, quantile_cont(year, 0.5) FILTER (WHERE class = 'fee') AS fee_year, count(*) FILTER (WHERE class = 'trust') AS nt, count(*) FILTER (WHERE class = 'fee') AS nf FROM y GROUP BY 1)
SELECT tribe, trust_year, fee_year, fee_year - trust_year AS lag FROM m WHERE nt >= 3 AND nf >= 3""")
def velocity_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL").select(F.col("glo_tribe_name").alias("tribe"), patent_class(F.col("authority")).alias("class"), F.year("signature_date").alias("year"))
    of = lambda c: F.when(F.col("class") == c, F.col("year"))
    out = rows.groupBy("tribe").agg(F.percentile(of("trust"), 0.5).alias("trust_year"), F.percentile(of("fee"), 0.5).alias("fee_year"), F.count(of("trust")).alias("nt"), F.count(of("fee")).alias("nf"))
    return out.where("nt >= 3 AND nf >= 3").select("tribe", "trust_year", "fee_year", (F.col("fee_year") - F.col("trust_year")).alias("lag"))


@query(f"""SELECT tribe, CAST(fee AS BIGINT) AS fee, CAST(cancelled AS BIGINT) AS cancelled, CAST(greatest(fee - cancelled, 0) AS BIGINT) AS regular, round(cancelled / CAST(fee AS DOUBLE), 6) AS rate FROM (SELECT glo_tribe_name AS tribe, count(*) AS fee, count(*) FILTER (WHERE cancelled_doc) AS cancelled FROM rails_patents WHERE authority IN ({_FEE}) AND glo_tribe_name IS NOT NULL GROUP BY 1) WHERE fee >= 5 ORDER BY cancelled / CAST(fee AS DOUBLE) DESC, tribe LIMIT 20""")
def forced_rate_top20(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where(F.col("authority").isin(FEE_AUTHORITIES) & F.col("glo_tribe_name").isNotNull())
    out = rows.groupBy(F.col("glo_tribe_name").alias("tribe")).agg(F.count("*").alias("fee"), F.count_if("cancelled_doc").alias("cancelled")).where("fee >= 5")
    rate = F.col("cancelled") / F.col("fee")
    return out.orderBy(rate.desc(), "tribe").limit(20).select("tribe", "fee", "cancelled", F.greatest(F.col("fee") - F.col("cancelled"), F.lit(0)).alias("regular"), F.round(rate, 6).alias("rate"))


@query(f"""WITH c AS (SELECT year(signature_date) AS year, count(*) FILTER (WHERE authority IN ({_TRUST})) AS trust, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee FROM rails_patents WHERE signature_date IS NOT NULL GROUP BY 1),
s AS (SELECT unnest(range(CAST((SELECT min(year) - 10 FROM c) AS BIGINT), CAST((SELECT max(year) + 1 FROM c) AS BIGINT))) AS year)
SELECT s.year, CAST(sum(coalesce(trust, 0)) OVER w AS BIGINT) AS cum_trust, CAST(sum(coalesce(fee, 0)) OVER w AS BIGINT) AS cum_fee FROM s LEFT JOIN c ON s.year = c.year WINDOW w AS (ORDER BY s.year)""")
def cumulative_by_year(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("authority")
    counts = timeline(_rails(spark, d), F.year("signature_date"), {"trust": a.isin(TRUST_AUTHORITIES), "fee": a.isin(FEE_AUTHORITIES)})
    return cumulative(counts, "year", ["trust", "fee"], lead=10)


@query("""WITH c AS (SELECT state, year(signature_date) AS y, count(*) AS n FROM rails_patents WHERE state IS NOT NULL AND signature_date IS NOT NULL GROUP BY 1, 2),
s AS (SELECT state, min(y) AS a, max(y) AS b, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY 1), p AS (SELECT state, y FROM c QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, y) = 1)
SELECT s.state, CAST(b - a + 1 AS BIGINT) AS years, CAST(p.y AS BIGINT) AS peak_year, round(sqrt(greatest(0.0, CAST(q AS DOUBLE) / (b - a + 1) - (CAST(s AS DOUBLE) / (b - a + 1)) * (CAST(s AS DOUBLE) / (b - a + 1)))) / (CAST(s AS DOUBLE) / (b - a + 1)), 6) AS cv FROM s JOIN p ON s.state = p.state""")
def temporal_cv(spark: SparkSession, d: str) -> DataFrame:
    counts = _rails(spark, d).where("state IS NOT NULL AND signature_date IS NOT NULL").groupBy("state", F.year("signature_date").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return variation(counts, "state", "y", "n")


@query(f"""SELECT glo_tribe_name AS tribe, CAST(count(*) FILTER (WHERE authority IN ({_TRUST})) AS BIGINT) AS trust, CAST(count(*) FILTER (WHERE authority IN ({_FEE})) AS BIGINT) AS fee, round(count(*) FILTER (WHERE authority IN ({_FEE})) * 100.0 / count(*), 1) AS fee_pct, CAST(max(year(signature_date)) - min(year(signature_date)) AS BIGINT) AS span FROM rails_patents WHERE glo_tribe_name IS NOT NULL GROUP BY 1""")
def group_comparison(spark: SparkSession, d: str) -> DataFrame:
    a, year = F.col("authority"), F.year("signature_date")
    fee = F.count_if(a.isin(FEE_AUTHORITIES))
    return _rails(spark, d).where("glo_tribe_name IS NOT NULL").groupBy(F.col("glo_tribe_name").alias("tribe")).agg(F.count_if(a.isin(TRUST_AUTHORITIES)).alias("trust"), fee.alias("fee"), F.round(fee * F.lit(100.0) / F.count("*"), 1).alias("fee_pct"), (F.max(year) - F.min(year)).cast("long").alias("span"))


@query("SELECT land_office, CAST(count(*) AS BIGINT) AS n FROM rails_patents WHERE trim(land_office, ' ') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_land_offices(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).where(blank_to_null(F.col("land_office")).isNotNull()).groupBy("land_office").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "land_office").limit(12)


@query("""WITH r AS (SELECT match_type, date_gap_years AS g, row_number() OVER (PARTITION BY match_type ORDER BY date_gap_years) - 1 AS i, count(*) OVER (PARTITION BY match_type) AS n FROM trust_fee_linkages_recovered WHERE date_gap_years IS NOT NULL)
SELECT match_type, max(g) FILTER (WHERE i = n // 4) AS p25, max(g) FILTER (WHERE i = n // 2) AS p50, max(g) FILTER (WHERE i = (3 * n) // 4) AS p75 FROM r GROUP BY 1""")
def positional_gap_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return positional_quantiles(_links(spark, d), "match_type", "date_gap_years")


@query("""SELECT state, CAST(d AS BIGINT) AS decade, CAST(n AS BIGINT) AS n FROM (SELECT s.state, k.d, count(p.id) AS n FROM (SELECT DISTINCT state FROM rails_patents WHERE state IS NOT NULL) s CROSS JOIN (VALUES (1880), (1890), (1900), (1910), (1920)) k(d) LEFT JOIN rails_patents p ON p.state = s.state AND year(p.signature_date) >= k.d AND year(p.signature_date) < k.d + 10 GROUP BY 1, 2)""")
def decades_melted(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("signature_date")
    wide = _rails(spark, d).where("state IS NOT NULL").groupBy("state").agg(*[F.count_if((year >= y) & (year < y + 10)).alias(f"y{y}") for y in range(1880, 1930, 10)])
    long = melt(wide, ["state"], {str(y): F.col(f"y{y}") for y in range(1880, 1930, 10)}, "decade", "n")
    return long.select("state", F.col("decade").cast("long").alias("decade"), "n")


@query("""WITH w AS (SELECT state, count(*) FILTER (WHERE year(signature_date) < 1910) AS before, count(*) FILTER (WHERE year(signature_date) >= 1910) AS after FROM rails_patents WHERE state IS NOT NULL GROUP BY 1)
SELECT state, CAST(CASE WHEN after - before > 0 THEN after - before END AS BIGINT) AS increase, CAST(CASE WHEN after - before < 0 THEN before - after END AS BIGINT) AS decrease, CAST(before + after AS BIGINT) AS total FROM w""")
def increase_decrease(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("signature_date")
    w = _rails(spark, d).where("state IS NOT NULL").groupBy("state").agg(F.count_if(year < 1910).alias("before"), F.count_if(year >= 1910).alias("after"))
    up, down = signed_split(F.col("after") - F.col("before"))
    return w.select("state", up.alias("increase"), down.alias("decrease"), row_sum([F.col("before"), F.col("after")]).alias("total"))


@query("""WITH i AS (SELECT patent_accession AS k, count(*) AS itemized FROM patent_file_ref_links GROUP BY 1), r AS (SELECT accession_number AS k, count(*) AS reported FROM rails_patents WHERE accession_number IS NOT NULL GROUP BY 1)
SELECT coalesce(r.k, i.k) AS k, CAST(reported AS BIGINT) AS reported_total, CAST(coalesce(itemized, 0) AS BIGINT) AS itemized_total, CAST(reported - coalesce(itemized, 0) AS BIGINT) AS gap FROM r FULL JOIN i ON r.k = i.k""")
def mechanism_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "patent_file_ref_links").select(F.col("patent_accession").alias("k"), F.lit(1).cast("long").alias("v"))
    reported = _rails(spark, d).where("accession_number IS NOT NULL").groupBy(F.col("accession_number").alias("k")).agg(F.count("*").alias("total"))
    return reconcile(items, "k", "v", reported, "total")


@query("SELECT CAST(row_number() OVER (ORDER BY accession_number NULLS LAST, id) AS BIGINT) AS n, CAST(id AS BIGINT) AS id FROM rails_patents")
def surrogate_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).select("accession_number", F.col("id").cast("long").alias("id"))
    return surrogate_ids(rows, "accession_number", "id", name="n").select("n", "id")


_PAIR = "CAST(id AS BIGINT) AS id, accession_number, state, full_name"


@query(f"SELECT 'only_old' AS side, * FROM (SELECT {_PAIR} FROM rails_patents EXCEPT SELECT {_PAIR} FROM rails_patents_cloud) UNION ALL SELECT 'only_new', * FROM (SELECT {_PAIR} FROM rails_patents_cloud EXCEPT SELECT {_PAIR} FROM rails_patents)")
def rebuild_symmetric_diff(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.col("id").cast("long").alias("id"), "accession_number", "state", "full_name"]
    return symmetric_difference(_rails(spark, d).select(*columns), table(spark, d, "rails_patents_cloud").select(*columns))


@query(f"""SELECT 'authority' AS field, CAST(count(*) FILTER (WHERE p.authority IS DISTINCT FROM c.authority) AS BIGINT) AS differing FROM rails_patents p JOIN {_CLOUD.replace('accession_number ORDER', 'id ORDER')} c ON p.id = c.id UNION ALL
SELECT 'full_name', CAST(count(*) FILTER (WHERE p.full_name IS DISTINCT FROM c.full_name) AS BIGINT) FROM rails_patents p JOIN {_CLOUD.replace('accession_number ORDER', 'id ORDER')} c ON p.id = c.id""")
def rebuild_column_diff(spark: SparkSession, d: str) -> DataFrame:
    cloud = first_per_key(table(spark, d, "rails_patents_cloud"), ["id"], F.col("id"), F.col("synced_at"))
    p, c = _rails(spark, d).alias("p"), cloud.alias("c")
    both = p.join(c, F.col("p.id") == F.col("c.id")).agg(*[F.count_if(~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}"))).alias(f) for f in ("authority", "full_name")])
    return melt(both, [], {f: F.col(f) for f in ("authority", "full_name")}, "field", "differing")


_PAGES = "(SELECT regexp_extract(trim(accession_number, ' '), '^([A-Z]{2})([0-9]+)__\\.([0-9]+)$', 1) AS state, regexp_extract(trim(accession_number, ' '), '^([A-Z]{2})([0-9]+)__\\.([0-9]+)$', 2) AS volume, CAST(regexp_extract(trim(accession_number, ' '), '^([A-Z]{2})([0-9]+)__\\.([0-9]+)$', 3) AS BIGINT) AS page FROM rails_patents WHERE regexp_full_match(trim(accession_number, ' '), '[A-Z]{2}[0-9]+__\\.[0-9]+'))"


@query(f"SELECT state, volume, CAST(count(*) AS BIGINT) AS entries, max(page) AS highest, max(page) - count(*) AS gap, round(count(*) * 100.0 / greatest(max(page), 1), 1) AS complete_pct FROM {_PAGES} GROUP BY 1, 2")
def sequence_gap_audit(spark: SparkSession, d: str) -> DataFrame:
    return sequence_gaps(_rails(spark, d), "accession_number")


@query("""SELECT CAST(coalesce(p.id, c.id) AS BIGINT) AS id, coalesce(p.authority, c.authority) AS authority, coalesce(p.full_name, c.full_name) AS full_name FROM rails_patents p FULL JOIN (SELECT * FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at) = 1) c ON p.id = c.id""")
def null_fill_merge(spark: SparkSession, d: str) -> DataFrame:
    cloud = first_per_key(table(spark, d, "rails_patents_cloud"), ["id"], F.col("synced_at"))
    return null_fill(_rails(spark, d), cloud, "id", ["authority", "full_name"]).withColumn("id", F.col("id").cast("long"))


@query("""WITH c AS (SELECT * FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at DESC) = 1)
SELECT CAST(id AS BIGINT) AS id, accession_number, full_name FROM c UNION ALL SELECT CAST(id AS BIGINT), accession_number, full_name FROM rails_patents WHERE id NOT IN (SELECT id FROM c)""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.col("id").cast("long").alias("id"), "accession_number", "full_name"]
    incoming = table(spark, d, "rails_patents_cloud").select(*columns, "synced_at")
    target = _rails(spark, d).select(*columns, F.lit(None).cast("timestamp_ntz").alias("synced_at"))
    return upsert(target, incoming, ["id"], F.col("synced_at").desc()).drop("synced_at")


@query("""SELECT patent_accession, CAST(file_ref_id AS BIGINT) AS file_ref_id, CAST(id AS BIGINT) AS id FROM patent_file_ref_links WHERE patent_accession NOT IN (SELECT trust_accession FROM trust_fee_linkages_recovered WHERE trust_accession IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY patent_accession ORDER BY id) = 1""")
def append_new_only(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "patent_file_ref_links").select("patent_accession", F.col("file_ref_id").cast("long").alias("file_ref_id"), F.col("id").cast("long").alias("id"))
    target = _links(spark, d).select(F.col("trust_accession").alias("patent_accession"))
    return append_new(target, incoming, ["patent_accession"], F.col("id"))


@query("""SELECT CAST(p.id AS BIGINT) AS id, coalesce(m.v, p.glo_tribe_name) AS label FROM rails_patents p LEFT JOIN (SELECT glo_name, min(authoritative_tribe) AS v FROM tribe_crosswalk WHERE authoritative_tribe IS NOT NULL GROUP BY 1) m ON p.glo_tribe_name = m.glo_name""")
def bulk_relabel(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "tribe_crosswalk").where("authoritative_tribe IS NOT NULL").groupBy("glo_name").agg(F.min("authoritative_tribe").alias("v"))
    return relabel(_rails(spark, d), "glo_tribe_name", labels, "glo_name", "v").select(F.col("id").cast("long").alias("id"), F.col("glo_tribe_name").alias("label"))


@query("""SELECT 'no_self_link' AS constraint, CAST(id AS BIGINT) AS key FROM trust_fee_linkages_recovered WHERE trust_accession = fee_accession UNION ALL SELECT 'gap_sign', CAST(id AS BIGINT) FROM trust_fee_linkages_recovered WHERE NOT date_gap_years >= 0
UNION ALL SELECT 'unique_pair', CAST(id AS BIGINT) FROM trust_fee_linkages_recovered WHERE trust_accession IS NOT NULL AND fee_accession IS NOT NULL QUALIFY count(*) OVER (PARTITION BY trust_accession, fee_accession) > 1""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d).withColumn("id", F.col("id").cast("long"))
    return violations(links, "id", {"no_self_link": F.col("trust_accession") != F.col("fee_accession"), "gap_sign": F.col("date_gap_years") >= 0}, {"unique_pair": ["trust_accession", "fee_accession"]})


@query("SELECT CAST(l.id AS BIGINT) AS id, l.patent_accession FROM patent_file_ref_links l WHERE NOT EXISTS (SELECT 1 FROM rails_patents p WHERE p.accession_number = l.patent_accession)")
def orphan_probe(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "patent_file_ref_links").select(F.col("id").cast("long").alias("id"), "patent_accession")
    return links.join(_rails(spark, d), F.col("patent_accession") == F.col("accession_number"), "left_anti")


_AB = "(SELECT id AS k, nullif(trim(authority, ' '), '') AS x, coalesce(state, 'none') AS g FROM rails_patents) a FULL JOIN (SELECT id AS k, nullif(trim(authority, ' '), '') AS y, coalesce(state, 'none') AS h FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at) = 1) b ON a.k = b.k"
_TALLY = "CAST(count(*) FILTER (WHERE x = y) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE x <> y) AS BIGINT) AS different, CAST(count(*) FILTER (WHERE x IS NOT NULL AND y IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE x IS NULL AND y IS NOT NULL) AS BIGINT) AS only_b, CAST(count(*) FILTER (WHERE x IS NULL AND y IS NULL) AS BIGINT) AS neither"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shape = ["id", blank_to_null(F.col("authority")).alias("v"), F.coalesce("state", F.lit("none")).alias("g")]
    return _rails(spark, d).select(*shape), first_per_key(table(spark, d, "rails_patents_cloud"), ["id"], F.col("synced_at")).select(*shape)


@query(f"SELECT 'all' AS \"group\", {_TALLY} FROM {_AB}")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement(*_two(spark, d), "id", "v")


@query(f"SELECT coalesce(g, h) AS \"group\", {_TALLY} FROM {_AB} GROUP BY 1")
def model_confusion_by_group(spark: SparkSession, d: str) -> DataFrame:
    return agreement(*_two(spark, d), "id", "v", "g")


_FIELDS = ["authority", "full_name", "land_office"]
_CID = "(SELECT * FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at) = 1)"
_N = lambda s, f: f"nullif(lower(trim({s}.{f}, ' ')), '')"


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE {_N('l', f)} = {_N('r', f)}) AS BIGINT) AS match, CAST(count(*) FILTER (WHERE {_N('l', f)} <> {_N('r', f)}) AS BIGINT) AS disagree, CAST(count(*) FILTER (WHERE {_N('l', f)} IS NULL AND {_N('r', f)} IS NOT NULL) AS BIGINT) AS left_null, CAST(count(*) FILTER (WHERE {_N('l', f)} IS NOT NULL AND {_N('r', f)} IS NULL) AS BIGINT) AS right_null, CAST(count(*) FILTER (WHERE {_N('l', f)} IS NULL AND {_N('r', f)} IS NULL) AS BIGINT) AS both_null FROM rails_patents l JOIN {_CID} r ON l.id = r.id" for f in _FIELDS))
def field_agreement(spark: SparkSession, d: str) -> DataFrame:
    return field_tallies(_rails(spark, d), first_per_key(table(spark, d, "rails_patents_cloud"), ["id"], F.col("synced_at")), "id", _FIELDS)


@query(f"""WITH p AS (SELECT DISTINCT state, volume, page FROM {_PAGES}), n AS (SELECT *, lead(page) OVER (PARTITION BY state, volume ORDER BY page) AS nxt, max(page) OVER (PARTITION BY state, volume) AS top FROM p)
SELECT state || volume AS volume, min(page + 5) AS stop_page FROM n WHERE coalesce(nxt, top + 1) - page > 5 GROUP BY 1""")
def consecutive_miss_stop(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"^([A-Z]{2}[0-9]+)__\.([0-9]+)$"
    key = F.trim("accession_number")
    hits = _rails(spark, d).where(key.rlike(pattern)).select(F.regexp_extract(key, pattern, 1).alias("volume"), F.regexp_extract(key, pattern, 2).cast("long").alias("page")).distinct()
    spans = hits.groupBy("volume").agg(F.min("page").alias("a"), F.max("page").alias("b")).select("volume", F.explode(F.sequence("a", "b")).alias("page"))
    probes = spans.join(hits.withColumn("hit", F.lit(True)), ["volume", "page"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return stop_after_misses(probes, "volume", "page", "hit", 5)


@query("""WITH s AS (SELECT state, count(*) AS n FROM rails_patents GROUP BY 1), q AS (SELECT state, n, least(n, greatest(1, CAST(round_even(n * 300.0 / (SELECT sum(n) FROM s), 0) AS BIGINT))) AS q FROM s), g AS (SELECT sum(q) AS g FROM q),
p AS (SELECT state, -1 AS step, unnest(range(1, q + 1)) AS level FROM q WHERE (SELECT g FROM g) > 300 UNION ALL SELECT state, 1, n - q + 1 - unnest(range(1, least(n - q, 300) + 1)) FROM q WHERE (SELECT g FROM g) < 300 AND n > q),
m AS (SELECT state, sum(step) AS m FROM (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY level DESC, state NULLS FIRST) <= abs((SELECT g FROM g) - 300)) GROUP BY 1),
z AS (SELECT q.state, q.q + coalesce(m.m, 0) AS quota FROM q LEFT JOIN m ON q.state IS NOT DISTINCT FROM m.state),
r AS (SELECT CAST(id AS BIGINT) AS id, state, row_number() OVER (PARTITION BY state ORDER BY md5('7' || CAST(id AS VARCHAR)), id) AS rn FROM rails_patents)
SELECT r.id, r.state FROM r JOIN z ON r.state IS NOT DISTINCT FROM z.state WHERE rn <= quota""")
def stratified_300(spark: SparkSession, d: str) -> DataFrame:
    return stratified_sample(_rails(spark, d).select(F.col("id").cast("long").alias("id"), "state"), "id", "state", 300, "7")


@query("SELECT CAST(id AS BIGINT) AS id FROM rails_patents ORDER BY md5('seed' || CAST(id AS VARCHAR)), id LIMIT 100")
def seeded_draw(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).select(F.col("id").cast("long").alias("id")).orderBy(F.md5(F.concat(F.lit("seed"), F.col("id").cast("string"))), "id").limit(100)


@query("""SELECT CAST(id AS BIGINT) AS id, array_to_string(list_transform(string_split_regex(allottee_name, ';\\s*'), lambda p: trim(CASE WHEN contains(p, ',') THEN trim(regexp_extract(p, '^[^,]*,(.*)$', 1), ' ') || ' ' || trim(regexp_extract(p, '^([^,]*),', 1), ' ') ELSE p END, ' ')), '; ') AS flipped FROM federal_register_claims WHERE allottee_name IS NOT NULL""")
def name_flip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "federal_register_claims").where("allottee_name IS NOT NULL").select(F.col("id").cast("long").alias("id"), flip_names(F.col("allottee_name")).alias("flipped"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("""SELECT CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos, json_extract_string(n, '$.type') AS type, json_extract_string(n, '$.date') AS date FROM (SELECT id, unnest(ns) AS n, unnest(range(0, len(ns))) AS pos FROM (SELECT id, from_json(CASE WHEN t LIKE '[%' THEN t ELSE '[' || t || ']' END, '["JSON"]') AS ns FROM (SELECT id, recovery_notes_json AS t FROM circular_2464_records UNION ALL SELECT id + 1000000, json_extract(recovery_notes_json, '$[0]') FROM circular_2464_records WHERE recovery_notes_json LIKE '[{%') WHERE trim(t, ' ') <> '' AND json_valid(t)))""")
def json_notes_explode(spark: SparkSession, d: str) -> DataFrame:
    """Notes of records: lists, and, under ids from 1,000,000 on, each list's first as a single object."""
    rows = table(spark, d, "circular_2464_records").select(F.col("id").cast("long").alias("id"), F.col("recovery_notes_json").alias("t"))
    single = rows.where("t LIKE '[{%'").select((F.col("id") + 1000000).alias("id"), F.get_json_object("t", "$[0]").alias("t"))
    texts = rows.unionByName(single).where("trim(t) != ''").select(F.concat(F.lit('{"extraction": '), F.col("t"), F.lit("}")).alias("text"), F.col("id").cast("string").alias("stem"))
    out = document_records(texts, "text", "stem", T.StructType([T.StructField("type", T.StringType()), T.StructField("date", T.StringType())]))
    return out.select(F.col("document_id").cast("long").alias("id"), F.col("record_index").cast("long").alias("pos"), "type", "date")


@query("SELECT CAST(id AS BIGINT) AS id, nullif(trim(regexp_replace(full_name, '\\s+', ' ', 'g'), ' '), '') AS name, land_office AS cell FROM rails_patents WHERE trim(full_name, ' ') <> '' AND land_office IS NOT NULL")
def pages_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("trim(full_name) != '' AND land_office IS NOT NULL")
    page = F.concat(F.lit('<div id="names">'), html_escaped(F.col("full_name")), F.lit('</div><table><tr><td colspan="2">office</td></tr><tr><td>x</td><td><b>'), F.col("land_office"), F.lit("</b></td></tr></table>"))
    return rows.select(F.col("id").cast("long").alias("id"), html_field(page, "names").alias("name"), F.element_at(F.element_at(html_rows(page), 2), 2).alias("cell"))


@query("SELECT CAST(event_id AS BIGINT) AS id, json_extract_string(props, '$.k') AS k FROM events")
def tolerant_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), loose_value(tolerant_json(answer), "k").alias("k"))


@query("""SELECT CAST(id AS BIGINT) AS id, 'Feature' AS type, 'Point' AS kind, -CAST(regexp_extract(geographic_name, 'R ([0-9]+)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(geographic_name, '^T ([0-9]+)', 1) AS DOUBLE) / 10 AS lat, accession_number, state FROM rails_patents WHERE regexp_full_match(geographic_name, 'T [0-9]+[NS] R [0-9]+[EW]')""")
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where(F.col("geographic_name").rlike("^T [0-9]+[NS] R [0-9]+[EW]$"))
    lat, lon = F.regexp_extract("geographic_name", "^T ([0-9]+)", 1).cast("double") / 10, -F.regexp_extract("geographic_name", "R ([0-9]+)", 1).cast("double")
    out = rows.select(F.col("id").cast("long").alias("id"), feature("Point", F.array(lon, lat), F.struct("accession_number", "state")).alias("f"))
    part = lambda p: F.get_json_object("f", p)
    return out.select("id", part("$.type").alias("type"), part("$.geometry.type").alias("kind"), part("$.geometry.coordinates[0]").cast("double").alias("lon"), part("$.geometry.coordinates[1]").cast("double").alias("lat"), part("$.properties.accession_number").alias("accession_number"), part("$.properties.state").alias("state"))


@query("""SELECT CAST(id AS BIGINT) AS id, round((4 * x + x) / 5 + 2.0 / 5, 6) AS lon, round((4 * y + y) / 5 + 2.0 / 5, 6) AS lat FROM (SELECT id, CAST(total_acres AS DOUBLE) AS x, CAST(id AS DOUBLE) AS y FROM rails_patents WHERE total_acres IS NOT NULL)""")
def ring_centroid(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("total_acres").cast("double"), F.col("id").cast("double")
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    polygons = F.from_json(F.to_json(F.array(F.array(ring))), POLYGONS)
    rows = _rails(spark, d).where("total_acres IS NOT NULL").select(F.col("id").cast("long").alias("id"), polygons_center(polygons).alias("c"), ring_center(ring).alias("r"))
    return rows.where(F.abs(F.col("c.lon") - F.col("r.lon")) < 1e-6).select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


_TOWN = "(SELECT id, state, CAST(regexp_extract(geographic_name, '^T ([0-9]+)', 1) AS DOUBLE) AS y, CAST(regexp_extract(geographic_name, 'R ([0-9]+)', 1) AS DOUBLE) AS x FROM rails_patents WHERE regexp_full_match(geographic_name, 'T [0-9]+[NS] R [0-9]+[EW]'))"


def _towns(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where(F.col("geographic_name").rlike("^T [0-9]+[NS] R [0-9]+[EW]$"))
    return rows.select("id", "state", F.regexp_extract("geographic_name", "^T ([0-9]+)", 1).cast("double").alias("y"), F.regexp_extract("geographic_name", "R ([0-9]+)", 1).cast("double").alias("x"))


@query(f"SELECT state, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM {_TOWN} GROUP BY 1")
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _towns(spark, d).groupBy("state").agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"))


@query(f"SELECT CAST(id AS BIGINT) AS id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(y / 2) / 2), 2) + cos(0) * cos(radians(y / 2)) * pow(sin(radians(x / 2) / 2), 2))), 3) AS km FROM {_TOWN}")
def distances(spark: SparkSession, d: str) -> DataFrame:
    return _towns(spark, d).select(F.col("id").cast("long").alias("id"), F.round(haversine_km(F.lit(0.0), F.lit(0.0), F.col("x") / 2, F.col("y") / 2), 3).alias("km"))


@query(f"""WITH a AS (SELECT state, indian_allotment_number AS k, min(geographic_name) AS g FROM rails_patents WHERE geographic_name IS NOT NULL AND indian_allotment_number IS NOT NULL GROUP BY 1, 2), b AS (SELECT state, land_office AS k, min(geographic_name) AS g FROM rails_patents WHERE geographic_name IS NOT NULL AND land_office IS NOT NULL GROUP BY 1, 2), c AS (SELECT state, min(geographic_name) AS g FROM rails_patents WHERE geographic_name IS NOT NULL GROUP BY 1)
SELECT CAST(p.id AS BIGINT) AS id, coalesce(p.geographic_name, a.g, b.g, c.g) AS place, CASE WHEN p.geographic_name IS NOT NULL THEN 0 WHEN a.g IS NOT NULL THEN 1 WHEN b.g IS NOT NULL THEN 2 WHEN c.g IS NOT NULL THEN 3 END AS tier FROM rails_patents p LEFT JOIN a ON p.state = a.state AND p.indian_allotment_number = a.k LEFT JOIN b ON p.state = b.state AND p.land_office = b.k LEFT JOIN c ON p.state = c.state""")
def geometry_tier(spark: SparkSession, d: str) -> DataFrame:
    p = _rails(spark, d).select(F.col("id").cast("long").alias("id"), "state", "indian_allotment_number", "land_office", "geographic_name")
    known = p.where("geographic_name IS NOT NULL")
    out, places = p, [F.col("geographic_name")]
    for i, keys in enumerate((["state", "indian_allotment_number"], ["state", "land_office"], ["state"]), 1):
        tier = known.dropna(subset=keys).groupBy(*keys).agg(F.min("geographic_name").alias(f"g{i}"))
        out, places = out.join(tier, keys, "left"), [*places, F.col(f"g{i}")]
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(places)])
    return out.select("id", F.coalesce(*places).alias("place"), tier.alias("tier"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return tumbling(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, s""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events")).select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events")
def events_once(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return once(e.unionByName(e)).agg(F.count("*").alias("n"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(max(rn) AS BIGINT) AS last_rank FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1""")
def events_ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", F.row_number().over(w).alias("rn")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("rn").cast("long").alias("last_rank"))
