"""Queries over linkages and label evidence: extraction, cascades, composite keys, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.functions.dates import years_between
from ledgerlark.functions.text import FEE_AUTHORITIES, REFERENCE_CLUSTERS, REFERENCE_FALLBACKS, TRUST_AUTHORITIES, bare_key, fee_references, is_cancelled, name_tokens
from ledgerlark.functions.trigram import similarity
from ledgerlark.operators.linkage import composite_links, extract_references, fuzzy_blocked, match_cascade, sources_by_priority, tiered_pick
from ledgerlark.operators.unify import first_per_key
from ledgerlark.plans.catalogue_queries import _FEE, _TRUST, _duck_grams
from ledgerlark.plans.registry import Registry
from ledgerlark.runtime import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trust_fee_linkages_recovered")


def _rails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rails_patents")


@query("""SELECT match_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE name_consistent) AS BIGINT) AS consistent, CAST(count(*) FILTER (WHERE NOT coalesce(name_consistent, FALSE)) AS BIGINT) AS not_consistent,
CAST(count(*) FILTER (WHERE fee_state IS DISTINCT FROM 'OR') AS BIGINT) AS elsewhere, quantile_cont(date_gap_years, 0.5) AS median_gap FROM trust_fee_linkages_recovered GROUP BY 1""")
def linkage_summary(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("match_type").agg(
        F.count("*").alias("n"), F.count_if("name_consistent").alias("consistent"), F.count_if(~F.coalesce("name_consistent", F.lit(False))).alias("not_consistent"),
        F.count_if(~F.col("fee_state").eqNullSafe("OR")).alias("elsewhere"), F.percentile("date_gap_years", 0.5).alias("median_gap"),
    )


_ONE = lambda t: f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY id) = 1)"
_CONE = "(SELECT * FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY id, synced_at) = 1)"


@query(f"""SELECT CAST(l.id AS BIGINT) AS id, coalesce(tm.full_name, tc.full_name) AS trust_name, coalesce(fm.full_name, fc.full_name) AS fee_name, l.date_gap_years IS NOT NULL AND l.date_gap_years < 0 AS backwards
FROM trust_fee_linkages_recovered l LEFT JOIN {_CONE} tm ON l.trust_accession = tm.accession_number LEFT JOIN {_ONE('rails_patents')} tc ON l.trust_accession = tc.accession_number
LEFT JOIN {_CONE} fm ON l.fee_accession = fm.accession_number LEFT JOIN {_ONE('rails_patents')} fc ON l.fee_accession = fc.accession_number""")
def linkage_roles(spark: SparkSession, d: str) -> DataFrame:
    mapped = first_per_key(table(spark, d, "rails_patents_cloud"), ["accession_number"], F.col("id"), F.col("synced_at")).select("accession_number", "full_name")
    catalogue = first_per_key(_rails(spark, d), ["accession_number"], F.col("id")).select("accession_number", "full_name")
    # One lookup with both names serves both roles.
    names = mapped.withColumnRenamed("full_name", "m").join(catalogue.withColumnRenamed("full_name", "c"), "accession_number", "full_outer").select("accession_number", F.coalesce("m", "c").alias("name"))
    out = _links(spark, d)
    for role in ("trust", "fee"):
        out = out.join(names.select(F.col("accession_number").alias(f"{role}_accession"), F.col("name").alias(f"{role}_name")), f"{role}_accession", "left")
    return out.select(F.col("id").cast("long").alias("id"), "trust_name", "fee_name", F.coalesce(F.col("date_gap_years") < 0, F.lit(False)).alias("backwards"))


@query("""SELECT accession, CAST(sum(as_trust) AS BIGINT) AS as_trust, CAST(sum(as_fee) AS BIGINT) AS as_fee FROM (SELECT trust_accession AS accession, 1 AS as_trust, 0 AS as_fee FROM trust_fee_linkages_recovered UNION ALL SELECT fee_accession, 0, 1 FROM trust_fee_linkages_recovered) WHERE accession IS NOT NULL GROUP BY 1""")
def linkage_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.col(f"{r}_accession").alias("accession"), F.lit(r).alias("role")) for r in ("trust", "fee")])).alias("e")
    rows = _links(spark, d).select(ends).where("e.accession IS NOT NULL")
    return rows.groupBy(F.col("e.accession").alias("accession")).agg(F.count_if(F.col("e.role") == "trust").alias("as_trust"), F.count_if(F.col("e.role") == "fee").alias("as_fee"))


def _duck_all(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(s, '{pattern}', {group})"


_REFS = f"""(SELECT id, accession_number, s, CASE WHEN len(c) > 0 THEN list_aggregate(c, 'string_agg', ' ') ELSE list_aggregate(f, 'string_agg', ' ') END AS refs FROM (
SELECT id, accession_number, s, list_filter(list_transform(flatten(list_transform(flatten([{', '.join(_duck_all(p) for p in REFERENCE_CLUSTERS)}]), lambda t: string_split(t, ' '))), lambda t: trim(t, ',.;:')), lambda t: regexp_matches(t, '[0-9]')) AS c,
list_filter(flatten([{', '.join(_duck_all(p) for p in REFERENCE_FALLBACKS)}]), lambda t: regexp_matches(t, '[0-9]')) AS f
FROM (SELECT id, accession_number, trim(regexp_replace(upper(remarks), '\\s+', ' ', 'g'), ' ') AS s FROM rails_patents WHERE remarks IS NOT NULL)))"""


@query(f"""SELECT DISTINCT CAST(id AS BIGINT) AS id, unnest(string_split(refs, ' ')) AS ref, regexp_matches(s, 'CANCELL?ED\\s+(?:DOCUMENT|PATENT)') AS cancelled FROM {_REFS} WHERE refs IS NOT NULL""")
def linkage_parse_remarks(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("remarks IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.explode(fee_references(F.col("remarks"))).alias("ref"), is_cancelled(F.col("remarks")).alias("cancelled"))
    return rows.distinct()


@query(f"""WITH r AS (SELECT DISTINCT CAST(id AS BIGINT) AS id, unnest(string_split(refs, ' ')) AS ref FROM {_REFS} WHERE refs IS NOT NULL),
v0 AS (SELECT id, ref, regexp_replace(upper(ref), '[^A-Z0-9]', '', 'g') AS b FROM r),
v1 AS (SELECT id, ref, b, regexp_full_match(b, '[0-9]+') AS dg FROM v0),
v AS (SELECT id, ref, unnest(range(0, 9)) AS rank, unnest([ref, b, CASE WHEN dg THEN nullif(ltrim(b, '0'), '') END, CASE WHEN dg THEN lpad(b, CAST(greatest(5, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(6, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(7, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(8, length(b)) AS INTEGER), '0') END,
  CASE WHEN dg AND length(b) >= 5 THEN substr(b, 1, length(b) - 3) || '-' || right(b, 3) END, CASE WHEN dg AND length(b) >= 5 THEN substr(b, 1, length(b) - 4) || '-' || right(b, 4) END]) AS v FROM v1),
t AS (SELECT DISTINCT accession_number AS target FROM rails_patents WHERE accession_number IS NOT NULL), tv AS (SELECT target, target AS v FROM t UNION SELECT target, regexp_replace(upper(target), '[^A-Z0-9]', '', 'g') FROM t),
h AS (SELECT v.id, v.ref, tv.target, CASE WHEN v.ref = tv.target THEN -1 ELSE v.rank END AS rank FROM v JOIN tv ON v.v = tv.v)
SELECT id, ref, target, CASE WHEN rank = -1 THEN 'exact' ELSE 'normalized' END AS match_type FROM h QUALIFY row_number() OVER (PARTITION BY id, ref ORDER BY rank, target) = 1""")
def linkage_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    refs = extract_references(_rails(spark, d).select(F.col("id").cast("long").alias("id"), "remarks"), "id", "remarks")
    return match_cascade(refs, _rails(spark, d).where("accession_number IS NOT NULL"), "ref", "accession_number", ["id"])


_BARE = "regexp_replace(upper(accession_number), '[^A-Z0-9]', '', 'g')"


@query(f"""WITH b AS (SELECT id, {_BARE} AS key, state, unnest(list_slice(list_sort(list_distinct(list_filter(string_split_regex(upper(full_name), '[^A-Z0-9]+'), lambda t: length(t) >= 2))), 1, 2)) AS block FROM rails_patents WHERE full_name IS NOT NULL AND {_BARE} <> ''),
c AS (SELECT DISTINCT a.id, b2.id AS target, levenshtein(a.key, b2.key) AS distance FROM b a JOIN b b2 ON a.block = b2.block AND a.id <> b2.id AND coalesce(a.state = b2.state, TRUE) WHERE abs(length(a.key) - length(b2.key)) <= 2 AND levenshtein(a.key, b2.key) <= 2)
SELECT CAST(id AS BIGINT) AS id, CAST(target AS BIGINT) AS target, CAST(distance AS BIGINT) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, target) = 1""")
def linkage_fuzzy_blocked(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("full_name IS NOT NULL").select(F.col("id").cast("long").alias("id"), bare_key(F.col("accession_number")).alias("key"), F.col("full_name").alias("name"), "state").where("key != ''")
    return fuzzy_blocked(rows, rows).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH r AS (SELECT id AS ref_id, {_BARE.replace('accession_number', 'ref')} AS key, state, full_name FROM (SELECT p.id, p.state, p.full_name, unnest(string_split(f.refs, ' ')) AS ref FROM rails_patents p JOIN {{refs}} f ON p.id = f.id WHERE p.full_name IS NOT NULL AND f.refs IS NOT NULL) WHERE ref NOT IN (SELECT accession_number FROM rails_patents WHERE accession_number IS NOT NULL) AND regexp_full_match({_BARE.replace('accession_number', 'ref')}, '[0-9]{{{{6,}}}}')),
t AS (SELECT id AS target, {_BARE} AS key, state, full_name FROM rails_patents WHERE full_name IS NOT NULL AND authority IN ({_FEE}) AND {_BARE} <> ''),
x AS (SELECT *, unnest(list_slice(list_sort(list_distinct(list_filter(string_split_regex(upper(full_name), '[^A-Z0-9]+'), lambda w: length(w) >= 2))), 1, 2)) AS block FROM r), y AS (SELECT *, unnest(list_slice(list_sort(list_distinct(list_filter(string_split_regex(upper(full_name), '[^A-Z0-9]+'), lambda w: length(w) >= 2))), 1, 2)) AS block FROM t),
c AS (SELECT DISTINCT ref_id || ':' || x.key AS ref, target, levenshtein(x.key, y.key) AS distance FROM x JOIN y ON x.block = y.block AND coalesce(x.state = y.state, TRUE) WHERE levenshtein(x.key, y.key) <= 2)
SELECT ref, CAST(target AS BIGINT) AS target, CAST(distance AS BIGINT) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY ref ORDER BY distance, target) = 1""".format(refs=_REFS))
def linkage_fuzzy_references(spark: SparkSession, d: str) -> DataFrame:
    """References in remarks that name no patent, of six digits or more, and the fee patent whose accession is closest."""
    p = _rails(spark, d)
    refs = extract_references(p.where("full_name IS NOT NULL"), "id", "remarks").join(p.select("accession_number"), F.col("ref") == F.col("accession_number"), "left_anti").select("id", bare_key(F.col("ref")).alias("key")).where(F.col("key").rlike("^[0-9]{6,}$")).distinct()
    refs = refs.join(p.select("id", "state", F.col("full_name").alias("name")), "id").select(F.concat("id", F.lit(":"), "key").alias("id"), "key", "name", "state")
    fee = p.where(F.col("authority").isin(FEE_AUTHORITIES) & F.col("full_name").isNotNull()).select("id", bare_key(F.col("accession_number")).alias("key"), F.col("full_name").alias("name"), "state").where("key != ''")
    found = fuzzy_blocked(refs, fee.withColumn("id", F.col("id").cast("string")))
    return found.select(F.col("id").alias("ref"), F.col("target").cast("long").alias("target"), F.col("distance").cast("long").alias("distance"))


_TOK = "list_filter(list_distinct(list_filter(string_split_regex(upper(full_name), '[\\s;,./-]+'), lambda t: length(t) >= 2)), lambda t: t NOT IN ('JR', 'SR', 'II', 'III', 'IV', 'MRS', 'MR', 'MISS', 'DR'))"


@query(f"""WITH p AS (SELECT CAST(id AS BIGINT) AS id, coalesce(state, '') AS s, coalesce(indian_allotment_number, '') AS a, coalesce(glo_tribe_name, '') AS g, signature_date AS dt, authority, {_TOK} AS tok FROM rails_patents WHERE full_name IS NOT NULL)
SELECT t.id AS trust_id, f.id AS fee_id, CAST(floor(date_diff('day', t.dt, f.dt) / 365) AS BIGINT) AS gap FROM p t JOIN p f ON t.s = f.s AND t.a = f.a AND t.g = f.g WHERE t.authority IN ({_TRUST}) AND f.authority IN ({_FEE}) AND coalesce(f.dt >= t.dt, TRUE) AND list_has_any(t.tok, f.tok)""")
def linkage_parcel(spark: SparkSession, d: str) -> DataFrame:
    p = _rails(spark, d).where("full_name IS NOT NULL").withColumn("id", F.col("id").cast("long"))
    return composite_links(p.where(F.col("authority").isin(TRUST_AUTHORITIES)), p.where(F.col("authority").isin(FEE_AUTHORITIES)), ["state", "indian_allotment_number", "glo_tribe_name"], "signature_date", "full_name")


@query("""WITH r AS (SELECT *, CASE source WHEN 'remarks_regex_v2' THEN 0 WHEN 'parcel_match_v1' THEN 1 WHEN 'vision_v5' THEN 2 ELSE 3 END AS p FROM trust_fee_linkages_recovered)
SELECT CAST(id AS BIGINT) AS id, source FROM r WHERE trust_accession IS NOT NULL AND fee_accession IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trust_accession, fee_accession ORDER BY p, id) = 1
UNION ALL SELECT CAST(id AS BIGINT), source FROM r WHERE trust_accession IS NULL OR fee_accession IS NULL""")
def linkage_dedupe_sources(spark: SparkSession, d: str) -> DataFrame:
    out = sources_by_priority(_links(spark, d), ["trust_accession", "fee_accession"], "source", {"remarks_regex_v2": 0, "parcel_match_v1": 1, "vision_v5": 2}, "id")
    return out.select(F.col("id").cast("long").alias("id"), "source")


@query(f"""SELECT CAST(l.id AS BIGINT) AS id FROM trust_fee_linkages_recovered l WHERE NOT (starts_with(l.match_type, 'fuzzy') AND EXISTS (SELECT 1 FROM {_ONE('rails_patents')} p WHERE p.accession_number = l.trust_accession AND p.state <> l.fee_state))""")
def fuzzy_state_cleanup(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    states = first_per_key(_rails(spark, d), ["accession_number"], F.col("id")).select(F.col("accession_number").alias("trust_accession"), "state")
    wrong = links.where(F.col("match_type").startswith("fuzzy")).join(states, "trust_accession").where("state <> fee_state").select("id")
    return links.join(wrong, "id", "left_anti").select(F.col("id").cast("long").alias("id"))


@query("""SELECT CAST(id AS BIGINT) AS id, CAST(floor(date_diff('day', trust_date, fee_date) / 365) AS BIGINT) AS signed_gap, CAST(floor(abs(date_diff('day', trust_date, fee_date)) / 365) AS BIGINT) AS distance FROM trust_fee_linkages_recovered WHERE trust_date IS NOT NULL AND fee_date IS NOT NULL""")
def linkage_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = _links(spark, d).where("trust_date IS NOT NULL AND fee_date IS NOT NULL")
    gap = lambda signed: years_between(F.col("fee_date"), F.col("trust_date"), signed).cast("long")
    return rows.select(F.col("id").cast("long").alias("id"), gap(True).alias("signed_gap"), gap(False).alias("distance"))


_SIM = f"(len(list_intersect({_duck_grams('a.full_name')}, {_duck_grams('b.full_name')})) / CAST(len({_duck_grams('a.full_name')}) + len({_duck_grams('b.full_name')}) - len(list_intersect({_duck_grams('a.full_name')}, {_duck_grams('b.full_name')})) AS DOUBLE))"
_SIBLINGS = f"""(SELECT CAST(a.id AS BIGINT) AS id, CAST(b.id AS BIGINT) AS sibling, b.glo_tribe_name AS label, {_SIM} AS sim, b.signature_date, CASE WHEN b.signature_date < a.signature_date THEN 'earlier' WHEN b.signature_date > a.signature_date THEN 'later' ELSE 'same' END AS direction
FROM rails_patents a JOIN rails_patents b ON a.state = b.state AND a.indian_allotment_number = b.indian_allotment_number AND a.accession_number <> b.accession_number
WHERE a.glo_tribe_name IS NULL AND a.full_name IS NOT NULL AND trim(a.indian_allotment_number, ' ') <> '' AND b.full_name IS NOT NULL AND trim(b.glo_tribe_name, ' ') <> '' AND len({_duck_grams('a.full_name')}) > 0 AND {_SIM} >= 0.5)"""


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    """Patents without a label beside labelled ones of the same state and number with a similar name."""
    p = _rails(spark, d).where("full_name IS NOT NULL AND trim(indian_allotment_number) != ''")
    a = p.where("glo_tribe_name IS NULL").select(F.col("id").cast("long").alias("id"), "state", "indian_allotment_number", F.col("accession_number").alias("acc"), F.col("full_name").alias("name"), F.col("signature_date").alias("date"))
    b = p.where("trim(glo_tribe_name) != ''").select(F.col("id").cast("long").alias("sibling"), "state", "indian_allotment_number", "accession_number", "full_name", F.col("glo_tribe_name").alias("label"), "signature_date")
    pairs = a.join(b, ["state", "indian_allotment_number"]).where("acc != accession_number").withColumn("sim", similarity(F.col("name"), F.col("full_name"))).where("sim >= 0.5")
    direction = F.when(F.col("signature_date") < F.col("date"), "earlier").when(F.col("signature_date") > F.col("date"), "later").otherwise("same")
    return pairs.select("id", "sibling", "label", "sim", "signature_date", direction.alias("direction"))


@query(f"SELECT id, sibling, label, round(sim, 6) AS sim, direction FROM {_SIBLINGS}")
def sibling_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _siblings(spark, d).select("id", "sibling", "label", F.round("sim", 6).alias("sim"), "direction")


@query(f"""SELECT id, label, sibling, n > 1 AS disagree FROM (SELECT s.*, n FROM {_SIBLINGS} s JOIN (SELECT id, count(DISTINCT label) AS n FROM {_SIBLINGS} GROUP BY 1) c USING (id)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, signature_date NULLS LAST, sibling) = 1""")
def sibling_tiered_pick(spark: SparkSession, d: str) -> DataFrame:
    out = tiered_pick(_siblings(spark, d), "id", "label", F.col("sim").desc(), F.col("signature_date").asc_nulls_last(), F.col("sibling"))
    return out.select("id", "label", "sibling", "disagree")


@query("""SELECT CAST(id AS BIGINT) AS id, regexp_replace(upper(accession_number), '[^A-Z0-9]', '', 'g') AS bare, list_sort(list_distinct(list_filter(string_split_regex(upper(full_name), '[^A-Z0-9]+'), lambda t: length(t) >= 2))) AS tokens FROM rails_patents WHERE full_name IS NOT NULL""")
def keys_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("full_name IS NOT NULL")
    return rows.select(F.col("id").cast("long").alias("id"), bare_key(F.col("accession_number")).alias("bare"), F.array_sort(name_tokens(F.col("full_name"), stops=False)).alias("tokens"))
