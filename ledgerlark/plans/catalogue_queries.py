"""Queries over claims, patents, testimony and file references: search, unification, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlark.functions.dates import era, parse_date
from ledgerlark.functions.text import CLAIM_GROUPS, FEE_AUTHORITIES, FILE_REFERENCE, LOSS_OF_TITLE, TRUST_AUTHORITIES, any_of, blank_to_null, file_references, in_claim_group, patent_class, slugify, strip_zeros
from ledgerlark.functions.trigram import may_reach, similar_pairs, similarity, span_similarity
from ledgerlark.operators.search import SearchSpec, facet, name_search, search
from ledgerlark.operators.stats import dominant, timeline
from ledgerlark.operators.unify import first_per_key, layered, resolve_labels, unified_view, with_flag
from ledgerlark.plans.registry import Registry
from ledgerlark.runtime import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_FEE, _TRUST = _list(FEE_AUTHORITIES), _list(TRUST_AUTHORITIES)
_LOSS = " OR ".join(f"claim_type ILIKE '%{p}%'" for p in LOSS_OF_TITLE)
CLAIM_GRID = SearchSpec(
    equal={"agency": "bia_agency_code", "state": "state"}, contains={"tribe": "tribe_identified", "claim_type": "claim_type", "name": "allottee_name", "allotment": "allotment_number"}, ranges={"date": "publication_date"},
    search=("bia_agency_code", "case_number", "allottee_name", "tribe_identified"), sortable=("bia_agency_code", "case_number", "allottee_name", "tribe_identified", "allotment_number", "claim_type"), default=(("bia_agency_code", "asc"), ("case_number", "asc")), ties=("id",),
)
PATENT_GRID = SearchSpec(equal={"state": "state"}, contains={"name": "full_name", "tribe": "glo_tribe_name"}, ranges={"date": "signature_date"}, search=("full_name", "accession_number"), sortable=("full_name", "glo_tribe_name", "state", "authority", "signature_date"), default=(("signature_date", "desc"),), ties=("id",))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "federal_register_claims")


def _rails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rails_patents")


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    """The second catalogue, one row per accession."""
    return first_per_key(table(spark, d, "rails_patents_cloud"), ["accession_number"], F.col("id"), F.col("synced_at"))


_CLOUD = "(SELECT * FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY accession_number ORDER BY id, synced_at) = 1)"


def _linked(spark: SparkSession, d: str, how: str) -> DataFrame:
    """Claims with the patents of the same allotment number, without leading zeros, and state."""
    c = _claims(spark, d).withColumn("k", F.nullif(strip_zeros(F.trim("allotment_number")), F.lit("")))
    p = _rails(spark, d).select(F.nullif(strip_zeros(F.trim("indian_allotment_number")), F.lit("")).alias("k"), "state", F.col("id").alias("patent_id"), "accession_number", "signature_date", "glo_tribe_name")
    return c.join(p, ["k", "state"], how)


_LINK = "nullif(ltrim(trim(c.allotment_number, ' '), '0'), '') = nullif(ltrim(trim(p.indian_allotment_number, ' '), '0'), '') AND c.state = p.state"


@query(f"""SELECT c.bia_agency_code, c.case_number, c.allottee_name, c.claim_type, min(p.signature_date) AS min_date, CAST(count(p.id) AS BIGINT) AS patent_count, coalesce(bool_or(m.accession_number IS NOT NULL), FALSE) AS on_map
FROM federal_register_claims c LEFT JOIN rails_patents p ON {_LINK} LEFT JOIN (SELECT DISTINCT accession_number FROM rails_patents_cloud) m ON p.accession_number = m.accession_number GROUP BY ALL""")
def claims_search_grouped(spark: SparkSession, d: str) -> DataFrame:
    mapped = table(spark, d, "rails_patents_cloud").select("accession_number").distinct().withColumn("m", F.lit(True))
    out = _linked(spark, d, "left").join(mapped, "accession_number", "left")
    return out.groupBy("bia_agency_code", "case_number", "allottee_name", "claim_type").agg(F.min("signature_date").alias("min_date"), F.count("patent_id").alias("patent_count"), F.coalesce(F.bool_or(F.col("m").isNotNull()), F.lit(False)).alias("on_map"))


@query("""SELECT (SELECT count(*) FROM federal_register_claims) AS total, (SELECT count(*) FROM federal_register_claims WHERE claim_type ILIKE '%trespass%' AND state = 'OR') AS filtered""")
def claims_search_count(spark: SparkSession, d: str) -> DataFrame:
    found = search(_claims(spark, d), CLAIM_GRID, {"claim_type": "trespass", "state": "OR"})
    return found.total.select(F.col("n").alias("total")).crossJoin(found.filtered.select(F.col("n").alias("filtered")))


@query("""SELECT CAST(id AS BIGINT) AS id, bia_agency_code, case_number, allottee_name FROM federal_register_claims WHERE tribe_identified ILIKE '%an%' AND publication_date >= '1983-01-01'
ORDER BY claim_type DESC NULLS LAST, case_number ASC NULLS LAST, id LIMIT 25 OFFSET 50""")
def claims_page_multisort(spark: SparkSession, d: str) -> DataFrame:
    page = search(_claims(spark, d), CLAIM_GRID, {"tribe": "an", "date_from": "1983-01-01"}, [(99, "desc"), (1, "asc")], 50, 25).page
    return page.select(F.col("id").cast("long").alias("id"), "bia_agency_code", "case_number", "allottee_name")


@query("""SELECT CAST(id AS BIGINT) AS id, claim_type FROM federal_register_claims WHERE coalesce(bia_agency_code ILIKE '%H8%', FALSE) OR coalesce(case_number ILIKE '%H8%', FALSE) OR coalesce(allottee_name ILIKE '%H8%', FALSE) OR coalesce(tribe_identified ILIKE '%H8%', FALSE)""")
def claims_global_search(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).where(CLAIM_GRID.predicate({"search": "H8"})).select(F.col("id").cast("long").alias("id"), "claim_type")


@query(f"""SELECT c.tribe_identified, string_agg(DISTINCT c.claim_type, '; ' ORDER BY c.claim_type) AS claim_types, string_agg(DISTINCT p.accession_number, '; ' ORDER BY p.accession_number) AS accessions, CAST(count(*) AS BIGINT) AS n
FROM federal_register_claims c LEFT JOIN rails_patents p ON {_LINK} GROUP BY 1""")
def claims_csv_agg(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), "; "), F.lit(""))
    return _linked(spark, d, "left").groupBy("tribe_identified").agg(text("claim_type").alias("claim_types"), text("accession_number").alias("accessions"), F.count("*").alias("n"))


@query(f"""SELECT CAST(c.id AS BIGINT) AS claim_id, CAST(p.id AS BIGINT) AS patent_id FROM federal_register_claims c LEFT JOIN rails_patents p ON {_LINK} WHERE p.signature_date >= DATE '1910-01-01' AND p.signature_date <= DATE '1920-12-31'""")
def claims_date_filter_left_to_inner(spark: SparkSession, d: str) -> DataFrame:
    out = _linked(spark, d, "left").where(F.col("signature_date").between("1910-01-01", "1920-12-31"))
    return out.select(F.col("id").cast("long").alias("claim_id"), F.col("patent_id").cast("long").alias("patent_id"))


@query("SELECT g AS claim_group, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{g}' AS g FROM federal_register_claims WHERE ({' OR '.join(f'claim_type ILIKE {chr(39)}%{m}%{chr(39)}' for m in must)})" + "".join(f" AND claim_type NOT ILIKE '%{n}%'" for n in never) for g, (must, never) in [*CLAIM_GROUPS.items(), ("LOSS OF TITLE", (LOSS_OF_TITLE, []))]) + ") GROUP BY 1")
def claim_type_groups(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("claim_type")
    names = [*[(g, in_claim_group(c, g)) for g in CLAIM_GROUPS], ("LOSS OF TITLE", any_of(c, LOSS_OF_TITLE))]
    groups = F.array_compact(F.array(*[F.when(p, g) for g, p in names]))
    return _claims(spark, d).select(F.explode(groups).alias("claim_group")).groupBy("claim_group").agg(F.count("*").alias("n"))


@query("""SELECT tribe_identified, trim(regexp_replace(regexp_replace(lower(trim(tribe_identified, ' ')), '[''"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(count(*) AS BIGINT) AS claims, list_sort(list_distinct(list(bia_agency_code))) AS agencies
FROM federal_register_claims WHERE trim(tribe_identified, ' ') <> '' GROUP BY 1, 2""")
def tribe_directory(spark: SparkSession, d: str) -> DataFrame:
    rows = _claims(spark, d).where(blank_to_null(F.col("tribe_identified")).isNotNull())
    return rows.groupBy("tribe_identified").agg(F.count("*").alias("claims"), F.array_sort(F.collect_set("bia_agency_code")).alias("agencies")).withColumn("slug", slugify(F.col("tribe_identified")))


_CLAIM_YEAR = "CASE WHEN regexp_full_match(trim(publication_date, ' '), '\\d{4}-\\d{2}-\\d{2}') THEN year(try_cast(trim(publication_date, ' ') AS DATE)) WHEN regexp_full_match(trim(publication_date, ' '), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN year(try_strptime(trim(publication_date, ' '), '%m/%d/%Y')) END"


@query(f"SELECT CAST({_CLAIM_YEAR} AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE claim_type ILIKE '%FORCED FEE%') AS BIGINT) AS forced FROM federal_register_claims WHERE ({_CLAIM_YEAR}) IS NOT NULL GROUP BY 1")
def claims_timeline_by_year(spark: SparkSession, d: str) -> DataFrame:
    return timeline(_claims(spark, d), F.year(parse_date(F.col("publication_date"))), {"claims": F.lit(True), "forced": in_claim_group(F.col("claim_type"), "ALL FORCED FEE")})


@query(f"""WITH l AS (SELECT year(p.signature_date) AS year, count(*) AS claims FROM federal_register_claims c JOIN rails_patents p ON {_LINK} WHERE p.signature_date IS NOT NULL GROUP BY 1),
a AS (SELECT year(signature_date) AS year, count(*) AS patents FROM rails_patents WHERE signature_date IS NOT NULL GROUP BY 1)
SELECT CAST(a.year AS BIGINT) AS year, CAST(patents AS BIGINT) AS patents, CAST(coalesce(claims, 0) AS BIGINT) AS claims FROM a LEFT JOIN l ON a.year = l.year""")
def tribe_profile_timeline(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("signature_date")
    patents = timeline(_rails(spark, d), year, {"patents": F.lit(True)})
    claims = timeline(_linked(spark, d, "inner"), year, {"claims": F.lit(True)})
    return patents.join(claims, "year", "left").na.fill(0, ["claims"])


@query("""SELECT field, value, CAST(count(*) AS BIGINT) AS n FROM (UNPIVOT (SELECT state, authority, document_class, land_office FROM rails_patents) ON COLUMNS(*) INTO NAME field VALUE value) WHERE trim(value, ' ') <> '' GROUP BY 1, 2""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return facet(_rails(spark, d), "state", "authority", "document_class", "land_office")


_VIEW = f"""(SELECT m.accession_number, coalesce(m.full_name, p.full_name) AS full_name, coalesce(m.glo_tribe_name, p.glo_tribe_name) AS glo_tribe_name, coalesce(m.authority, p.authority) AS authority, TRUE AS is_mapped
FROM {_CLOUD} m LEFT JOIN rails_patents p ON m.accession_number = p.accession_number
UNION ALL SELECT accession_number, full_name, glo_tribe_name, coalesce(authority, document_class), FALSE FROM rails_patents WHERE accession_number NOT IN (SELECT accession_number FROM rails_patents_cloud WHERE accession_number IS NOT NULL))"""


def _view(spark: SparkSession, d: str) -> DataFrame:
    return unified_view(_cloud(spark, d), _rails(spark, d), "accession_number", ["full_name", "glo_tribe_name", "authority"], {"authority": F.coalesce("authority", "document_class")})


@query(f"SELECT * FROM {_VIEW}")
def unified_view_rows(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d)


@query(f"SELECT is_mapped, CASE WHEN authority IN ({_FEE}) THEN 'fee' WHEN authority IN ({_TRUST}) THEN 'trust' ELSE 'other' END AS class, CAST(count(*) AS BIGINT) AS n FROM {_VIEW} GROUP BY 1, 2")
def unified_view_mappable_counts(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).groupBy("is_mapped", patent_class(F.col("authority")).alias("class")).agg(F.count("*").alias("n"))


_LOST = f"(SELECT DISTINCT p.accession_number FROM federal_register_claims c JOIN rails_patents p ON {_LINK} WHERE {_LOSS})"


def _lost(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, "inner").where(any_of(F.col("claim_type"), LOSS_OF_TITLE)).select("accession_number").distinct()


@query(f"SELECT CAST(id AS BIGINT) AS id, accession_number FROM rails_patents WHERE accession_number IN {_LOST}")
def patents_dispossession_semi(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).join(_lost(spark, d), "accession_number", "left_semi").select(F.col("id").cast("long").alias("id"), "accession_number")


@query(f"SELECT CAST(id AS BIGINT) AS id, coalesce(accession_number IN {_LOST}, FALSE) AS lost FROM rails_patents")
def patents_dispossession_flag(spark: SparkSession, d: str) -> DataFrame:
    return with_flag(_rails(spark, d), _lost(spark, d), {"accession_number": "accession_number"}, "lost").select(F.col("id").cast("long").alias("id"), "lost")


@query("SELECT CAST(id AS BIGINT) AS id, full_name, signature_date FROM rails_patents WHERE state = 'ID' ORDER BY signature_date DESC NULLS LAST, full_name ASC NULLS LAST, id LIMIT 50 OFFSET 100")
def patents_page_sorted(spark: SparkSession, d: str) -> DataFrame:
    return search(_rails(spark, d), PATENT_GRID, {"state": "ID"}, [(4, "desc"), (0, "asc")], 100, 50).page.select(F.col("id").cast("long").alias("id"), "full_name", "signature_date")


def _duck_grams(c: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_Q = "PETER KUDUVEPOKO"
_SIM = f"(len(list_intersect({_duck_grams('full_name')}, {_duck_grams(chr(39) + _Q + chr(39))})) / CAST(len({_duck_grams('full_name')}) + len({_duck_grams(chr(39) + _Q + chr(39))}) - len(list_intersect({_duck_grams('full_name')}, {_duck_grams(chr(39) + _Q + chr(39))})) AS DOUBLE))"


@query(f"SELECT CAST(id AS BIGINT) AS id, full_name, round({_SIM}, 6) AS sim FROM rails_patents WHERE full_name IS NOT NULL AND len({_duck_grams('full_name')}) > 0 AND {_SIM} >= 0.3")
def name_search_trigram(spark: SparkSession, d: str) -> DataFrame:
    sim = similarity(F.col("full_name"), F.lit(_Q))
    return _rails(spark, d).where(may_reach(F.col("full_name"), _Q, 0.3)).select(F.col("id").cast("long").alias("id"), "full_name", F.round(sim, 6).alias("sim")).where(sim >= 0.3)


@query(f"""SELECT CAST(id AS BIGINT) AS id, match_type, round(s, 3) AS sim_score FROM (SELECT id, CASE WHEN full_name ILIKE '%TOBUJUMOPU%' THEN 'exact' ELSE 'fuzzy' END AS match_type, CASE WHEN full_name ILIKE '%TOBUJUMOPU%' THEN 1.0 ELSE {_SIM.replace(_Q, 'TOBUJUMOPU')} END AS s
FROM rails_patents WHERE full_name IS NOT NULL AND len({_duck_grams('full_name')}) > 0) WHERE s >= 0.35""")
def name_search_scored(spark: SparkSession, d: str) -> DataFrame:
    out = name_search(_rails(spark, d), "full_name", "TOBUJUMOPU", 0.35)
    return out.select(F.col("id").cast("long").alias("id"), "match_type", F.round("sim_score", 3).alias("sim_score"))


@query(f"""WITH t AS (SELECT CAST(id AS BIGINT) AS id, {_duck_grams('glo_name')} AS g FROM tribe_crosswalk), r AS (SELECT CAST(ref_id AS BIGINT) AS ref_id, {_duck_grams('tribe_name')} AS g FROM tribe_reference)
SELECT ref_id AS q, id AS t, round(s, 6) AS sim FROM (SELECT ref_id, id, len(list_intersect(r.g, t.g)) / CAST(len(r.g) + len(t.g) - len(list_intersect(r.g, t.g)) AS DOUBLE) AS s FROM r, t WHERE len(t.g) > 0) WHERE s >= 0.65""")
def name_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tribe_reference").select(F.col("ref_id").cast("long").alias("id"), F.col("tribe_name").alias("text"))
    t = table(spark, d, "tribe_crosswalk").select(F.col("id").cast("long").alias("id"), F.col("glo_name").alias("text"))
    return similar_pairs(q, t, 0.65).select("q", "t", F.round("sim", 6).alias("sim"))


def _duck_span(q: str, text: str) -> str:
    """SQL of the highest trigram similarity of ``q`` to a run of whole words of ``text``."""
    g = _duck_grams("u")
    pair = f"list_max(list_transform(list_transform(spans, lambda u: {g}), lambda t: len(list_intersect(qg, t)) / CAST(len(qg) + len(t) - len(list_intersect(qg, t)) AS DOUBLE)))"
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"(SELECT coalesce({pair}, 0.0) FROM (SELECT {_duck_grams(q)} AS qg, flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(i, len(ws) + 1), lambda j: array_to_string(ws[i:j], ' ')))) AS spans FROM (SELECT {words} AS ws)))"


@query(f"SELECT * FROM (SELECT CAST(id AS BIGINT) AS id, full_name, round({_duck_span(chr(39) + 'KUDU VEPOKO' + chr(39), 'full_name')}, 6) AS sim FROM rails_patents WHERE full_name IS NOT NULL) WHERE sim >= 0.6")
def name_search_span(spark: SparkSession, d: str) -> DataFrame:
    sim = span_similarity(F.lit("KUDU VEPOKO"), F.col("full_name"))
    return _rails(spark, d).where(F.col("full_name").isNotNull()).select(F.col("id").cast("long").alias("id"), "full_name", F.round(sim, 6).alias("sim")).where("sim >= 0.6")


@query("""SELECT CAST(p.id AS BIGINT) AS id, coalesce(nullif(trim(d.label, ' '), ''), CASE WHEN p.glo_tribe_name IS NULL OR trim(p.glo_tribe_name, ' ') = '' OR p.glo_tribe_name ILIKE 'frn%' THEN nullif(trim(p.land_office, ' '), '') END, nullif(trim(p.glo_tribe_name, ' '), '')) AS label
FROM rails_patents p LEFT JOIN (SELECT patent_accession, min(notes) AS label FROM patent_file_ref_links WHERE notes IS NOT NULL GROUP BY 1) d ON p.accession_number = d.patent_accession""")
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    derived = table(spark, d, "patent_file_ref_links").where("notes IS NOT NULL").groupBy(F.col("patent_accession").alias("accession_number")).agg(F.min("notes").alias("derived"))
    base = _rails(spark, d).join(derived, "accession_number", "left")
    vague = blank_to_null(F.col("glo_tribe_name")).isNull() | F.col("glo_tribe_name").ilike("frn%")
    return base.select(F.col("id").cast("long").alias("id"), layered([F.col("derived"), F.when(vague, F.col("land_office")), F.col("glo_tribe_name")]).alias("label"))


@query("""WITH a AS (SELECT upper(trim(tribe_name, ' ')) AS k, min(nullif(trim(tribe_name, ' '), '')) AS v FROM tribe_reference WHERE nullif(trim(tribe_name, ' '), '') IS NOT NULL GROUP BY 1),
b AS (SELECT upper(trim(glo_name, ' ')) AS k, min(nullif(trim(authoritative_tribe, ' '), '')) AS v FROM tribe_crosswalk WHERE glo_name IS NOT NULL AND nullif(trim(authoritative_tribe, ' '), '') IS NOT NULL GROUP BY 1),
c AS (SELECT CAST(id AS BIGINT) AS id, CASE WHEN lower(trim(tribe_reservation, ' ')) IN ('', 'not stated', 'n/a', 'unknown', '(actual tribe unknown)') THEN NULL ELSE upper(trim(tribe_reservation, ' ')) END AS k FROM circular_2464_records)
SELECT c.id, coalesce(a.v, b.v) AS resolved, CASE WHEN a.v IS NOT NULL THEN 'reference' WHEN b.v IS NOT NULL THEN 'crosswalk' ELSE 'none' END AS tier FROM c LEFT JOIN a ON c.k = a.k LEFT JOIN b ON c.k = b.k""")
def crosswalk_resolution(spark: SparkSession, d: str) -> DataFrame:
    tiers = [("reference", table(spark, d, "tribe_reference"), "tribe_name", "tribe_name"), ("crosswalk", table(spark, d, "tribe_crosswalk"), "glo_name", "authoritative_tribe")]
    out = resolve_labels(table(spark, d, "circular_2464_records"), "tribe_reservation", tiers, ["", "not stated", "n/a", "unknown", "(actual tribe unknown)"])
    return out.select(F.col("id").cast("long").alias("id"), "resolved", "tier")


@query("""SELECT CAST(r.id AS BIGINT) AS id, EXISTS (SELECT 1 FROM rails_patents p WHERE r.allotment_number IS NOT NULL AND p.indian_allotment_number = r.allotment_number AND upper(trim(p.glo_tribe_name, ' ')) = upper(trim(r.tribe_reservation, ' '))) AS has_patent FROM circular_2464_records r""")
def testimony_has_match(spark: SparkSession, d: str) -> DataFrame:
    patents = _rails(spark, d).select(F.col("indian_allotment_number").alias("a"), F.upper(F.trim("glo_tribe_name")).alias("t"))
    base = table(spark, d, "circular_2464_records").withColumn("t", F.upper(F.trim("tribe_reservation")))
    return with_flag(base, patents, {"allotment_number": "a", "t": "t"}, "has_patent").select(F.col("id").cast("long").alias("id"), "has_patent")


@query("SELECT DISTINCT accession_number FROM rails_patents WHERE (indian_allotment_number, state) IN (SELECT allotment_number, state FROM federal_register_claims WHERE allotment_number IS NOT NULL AND state IS NOT NULL)")
def tuple_in_semi(spark: SparkSession, d: str) -> DataFrame:
    pairs = _claims(spark, d).select(F.col("allotment_number").alias("indian_allotment_number"), "state")
    return _rails(spark, d).join(pairs, ["indian_allotment_number", "state"], "left_semi").select("accession_number").distinct()


@query("""SELECT CAST(a.id AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS siblings FROM circular_2464_records a JOIN circular_2464_records b ON a.document_id = b.document_id AND a.id <> b.id GROUP BY 1""")
def siblings_self_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "circular_2464_records").select("id", "document_id")
    pairs = r.join(r.withColumnRenamed("id", "other"), "document_id").where("id != other")
    return pairs.groupBy(F.col("id").cast("long").alias("id")).agg(F.count("*").alias("siblings"))




@query(f"""WITH j AS (SELECT CAST(r.id AS BIGINT) AS ref_id, l.context_label, l.patent_accession, p.state, p.signature_date FROM patent_file_references r LEFT JOIN patent_file_ref_links l ON r.id = l.file_ref_id LEFT JOIN (SELECT accession_number, min(state) AS state, min(signature_date) AS signature_date FROM rails_patents GROUP BY 1) p ON l.patent_accession = p.accession_number),
m AS (SELECT ref_id, context_label FROM (SELECT ref_id, context_label, row_number() OVER (PARTITION BY ref_id ORDER BY count(*) DESC, context_label) AS rn FROM j WHERE context_label IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)
SELECT j.ref_id, CAST(count(DISTINCT patent_accession) AS BIGINT) AS patents, string_agg(DISTINCT state, '; ' ORDER BY state) AS states, m.context_label AS top_label, min(signature_date) AS first_date, max(signature_date) AS last_date FROM j LEFT JOIN m ON j.ref_id = m.ref_id GROUP BY j.ref_id, m.context_label""")
def file_ref_rollup(spark: SparkSession, d: str) -> DataFrame:
    patents = _rails(spark, d).groupBy(F.col("accession_number").alias("patent_accession")).agg(F.min("state").alias("state"), F.min("signature_date").alias("signature_date"))
    links = table(spark, d, "patent_file_ref_links").select("file_ref_id", "patent_accession", "context_label").join(patents, "patent_accession", "left")
    out = table(spark, d, "patent_file_references").select("id").join(links, F.col("id") == F.col("file_ref_id"), "left").groupBy(F.col("id").cast("long").alias("ref_id"))
    return out.agg(F.countDistinct("patent_accession").alias("patents"), F.nullif(F.array_join(F.array_sort(F.collect_set("state")), "; "), F.lit("")).alias("states"), F.mode("context_label", True).alias("top_label"), F.min("signature_date").alias("first_date"), F.max("signature_date").alias("last_date"))


@query("""SELECT CAST(file_ref_id AS BIGINT) AS ref_id, CASE WHEN bool_or(io_labeled = 'yes') AND bool_or(io_labeled = 'no') THEN 'mixed' WHEN bool_or(io_labeled = 'yes') THEN 'yes' WHEN bool_or(io_labeled = 'no') THEN 'no' WHEN bool_or(io_labeled = 'unknown') THEN 'unknown' END AS io_labeled FROM patent_file_ref_links GROUP BY 1""")
def file_ref_io_label(spark: SparkSession, d: str) -> DataFrame:
    has = lambda v: F.coalesce(F.bool_or(F.col("io_labeled") == v), F.lit(False))
    flags = table(spark, d, "patent_file_ref_links").groupBy(F.col("file_ref_id").cast("long").alias("ref_id")).agg(has("yes").alias("y"), has("no").alias("n"), has("unknown").alias("u"))
    return flags.select("ref_id", F.expr("CASE WHEN y AND n THEN 'mixed' WHEN y THEN 'yes' WHEN n THEN 'no' WHEN u THEN 'unknown' END").alias("io_labeled"))


@query("""SELECT CASE WHEN year < 1907 THEN 'pre-1907' WHEN year <= 1942 THEN '1907-1942' WHEN year <= 1975 THEN '1943-1975' WHEN year > 1975 THEN 'post-1975' END AS era, CAST(count(*) AS BIGINT) AS refs, CAST(count(*) FILTER (WHERE nara_verified) AS BIGINT) AS verified FROM patent_file_references GROUP BY 1""")
def file_ref_era_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patent_file_references").groupBy(era(F.col("year")).alias("era")).agg(F.count("*").alias("refs"), F.count_if("nara_verified").alias("verified"))


@query("""WITH c AS (SELECT l.file_ref_id, p.accession_number, p.state, p.authority, p.signature_date, p.cancelled_doc FROM patent_file_ref_links l JOIN rails_patents p ON l.patent_accession = p.accession_number
  QUALIFY row_number() OVER (PARTITION BY l.file_ref_id, p.accession_number ORDER BY p.signature_date NULLS LAST, p.id, l.id) = 1)
SELECT CAST(file_ref_id AS BIGINT) AS ref_id, CAST(count(*) AS BIGINT) AS patents, CAST(count(DISTINCT state) AS BIGINT) AS states, CAST(count(DISTINCT authority) AS BIGINT) AS authorities, min(signature_date) AS first_date, max(signature_date) AS last_date, CAST(count(*) FILTER (WHERE cancelled_doc) AS BIGINT) AS cancelled FROM c GROUP BY 1""")
def file_ref_cohort(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "patent_file_ref_links").select("file_ref_id", F.col("patent_accession").alias("accession_number"), F.col("id").alias("link_id"))
    cohort = links.join(_rails(spark, d).select("id", "accession_number", "state", "authority", "signature_date", "cancelled_doc"), "accession_number")
    cohort = first_per_key(cohort, ["file_ref_id", "accession_number"], F.col("signature_date").asc_nulls_last(), F.col("id"), F.col("link_id"))
    return cohort.groupBy(F.col("file_ref_id").cast("long").alias("ref_id")).agg(F.count("*").alias("patents"), F.countDistinct("state").alias("states"), F.countDistinct("authority").alias("authorities"), F.min("signature_date").alias("first_date"), F.max("signature_date").alias("last_date"), F.count_if("cancelled_doc").alias("cancelled"))


_FILE_RE = FILE_REFERENCE.replace("'", "''")


@query(f"""WITH m AS (SELECT CAST(id AS BIGINT) AS id, unnest(regexp_extract_all(remarks, '{_FILE_RE}', 0)) AS matched FROM rails_patents WHERE remarks IS NOT NULL),
s AS (SELECT id, matched, regexp_replace(regexp_replace(upper(regexp_extract(matched, '{_FILE_RE}', 1)), '[.\\s]+', '', 'g'), '^ADDTIONAL', 'ADDITIONAL') AS raw, regexp_extract(matched, '{_FILE_RE}', 2) AS letter, 1900 + CAST(regexp_extract(matched, '{_FILE_RE}', 3) AS INTEGER) AS year FROM m)
SELECT id, matched, CASE WHEN starts_with(raw, 'ADDITIONAL') THEN 'ADDITIONAL ' ELSE '' END || CASE WHEN contains(raw, 'DOCUMENT') THEN 'DOCUMENT' WHEN contains(raw, 'BIA') THEN 'BIA' ELSE 'IO' END AS label, letter, CAST(year AS BIGINT) AS year FROM s""")
def file_refs_from_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("remarks IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.explode(file_references(F.col("remarks"))).alias("r"))
    return rows.select("id", "r.matched", "r.label", "r.letter", F.col("r.year").cast("long").alias("year"))


@query("""SELECT state, glo_tribe_name AS label, CAST(n AS BIGINT) AS n FROM (SELECT state, glo_tribe_name, count(*) AS n, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, glo_tribe_name) AS rn FROM rails_patents WHERE state IS NOT NULL AND glo_tribe_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def dominant_mapping(spark: SparkSession, d: str) -> DataFrame:
    return dominant(_rails(spark, d), "state", "glo_tribe_name").withColumnRenamed("glo_tribe_name", "label")


@query("""SELECT CAST(id AS BIGINT) AS id, CAST(count(*) OVER (PARTITION BY state, indian_allotment_number) - 1 AS BIGINT) AS others FROM rails_patents WHERE indian_allotment_number IS NOT NULL AND state IS NOT NULL""")
def patent_dossier_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("indian_allotment_number IS NOT NULL AND state IS NOT NULL")
    return rows.select(F.col("id").cast("long").alias("id"), (F.count("*").over(Window.partitionBy("state", "indian_allotment_number")) - 1).alias("others"))
