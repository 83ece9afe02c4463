"""Grids, name search, evidence tiers, flow network and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlark.functions.dates import parse_date
from ledgerlark.functions.text import FEE_AUTHORITIES, TRUST_AUTHORITIES, blank_to_null, in_claim_group, key_variants, patent_class
from ledgerlark.functions.trigram import span_similarity
from ledgerlark.operators.bridge import bridge_join
from ledgerlark.operators.linkage import composite_links, evidence_tier
from ledgerlark.operators.search import SearchSpec, person_search, relevance_first, search
from ledgerlark.operators.stats import cumulative, flow, flow_nodes, timeline, top_counts
from ledgerlark.operators.unify import first_per_key
from ledgerlark.plans.catalogue_queries import PATENT_GRID, _duck_grams, _duck_span, _FEE, _TRUST
from ledgerlark.plans.record_queries import _BRIDGE, _bridge
from ledgerlark.plans.registry import Registry
from ledgerlark.runtime import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _id():
    return F.col("id").cast("long").alias("id")


TESTIMONY_GRID = SearchSpec(
    equal={"tribe": "authoritative_tribe", "doc_type": "source_layer", "part": "record_index"}, contains={"name": "name"}, like={"allotment": "allotment_number"},
    sortable=("name", "tribe_reservation", "allotment_number", "fee_patent_date", "source_layer", "record_index"), default=(("name", "asc"),), ties=("id",),
)
FILE_GRID = SearchSpec(
    integers={"patents": "patent_count", "year": "year"}, buckets={"era": {"pre_1907": "year < 1907", "ccf_1907_1942": "year BETWEEN 1907 AND 1942", "ccf_1943_1975": "year BETWEEN 1943 AND 1975", "post_1975": "year > 1975"}, "io_labeled": {v: f"io_labeled = '{v}'" for v in ("yes", "no", "mixed", "unknown")}},
    search=("letter_number", "year_raw", "state_list"), sortable=("letter_number", "year", "patent_count", "min_date", "state_list", "io_labeled", "nara_verified"), default=(("patent_count", "desc"),), ties=("letter_number", "year_raw", "id"),
)
LINKAGE_GRID = SearchSpec(
    equal={"match_type": "match_type", "state": "fee_state", "source": "source"}, integers={"gap": "date_gap_years"},
    buckets={"name_consistent": {"yes": "coalesce(name_consistent, false)", "no": "NOT coalesce(name_consistent, false)"}, "direction": {"plausible": "coalesce(date_gap_years >= 0, true)"}},
    search=("trust_accession", "fee_accession", "name_overlap"), sortable=("trust_accession", "trust_date", "fee_accession", "fee_date", "date_gap_years", "match_type", "name_consistent", "fee_authority", "fee_state", "source"), default=(("date_gap_years", "asc"),), ties=("trust_accession", "fee_accession", "id"),
)
TRIBE_CLAIM_GRID = SearchSpec(equal={"tribe": "tribe_identified"}, search=("case_number", "allottee_name", "allotment_number"), sortable=("case_number", "allottee_name", "allotment_number", "min_date", "patent_count"), default=(("case_number", "asc"),), ties=("id",))


@query("""SELECT CAST(id AS BIGINT) AS id, name, fee_patent_date FROM circular_2464_records WHERE name ILIKE '%an%' AND allotment_number ILIKE '1%' AND source_layer = 'sonnet_text' ORDER BY fee_patent_date DESC NULLS LAST, name ASC NULLS LAST, id LIMIT 25""")
def testimony_page(spark: SparkSession, d: str) -> DataFrame:
    page = search(table(spark, d, "circular_2464_records"), TESTIMONY_GRID, {"name": "an", "allotment": "1%", "doc_type": "sonnet_text"}, [(3, "desc"), (0, "asc")], 0, 25).page
    return page.select(_id(), "name", "fee_patent_date")


def _file_rows(spark: SparkSession, d: str) -> DataFrame:
    """File references with the aggregates their grid shows."""
    patents = table(spark, d, "rails_patents").groupBy(F.col("accession_number").alias("patent_accession")).agg(F.min("state").alias("state"), F.min("signature_date").alias("signed"))
    links = table(spark, d, "patent_file_ref_links").select("file_ref_id", "patent_accession", "io_labeled").join(patents, "patent_accession", "left")
    has = lambda v: F.coalesce(F.bool_or(F.col("io_labeled") == v), F.lit(False))
    io = F.when(has("yes") & has("no"), "mixed").when(has("yes"), "yes").when(has("no"), "no").when(has("unknown"), "unknown")
    sums = links.groupBy(F.col("file_ref_id").alias("id")).agg(F.countDistinct("patent_accession").alias("patent_count"), F.nullif(F.array_join(F.array_sort(F.collect_set("state")), "; "), F.lit("")).alias("state_list"), F.min("signed").alias("min_date"), io.alias("io_labeled"))
    return table(spark, d, "patent_file_references").join(sums, "id", "left").withColumn("patent_count", F.coalesce("patent_count", F.lit(0)))


_FILES = """(SELECT r.id, letter_number, year, year_raw, nara_verified, coalesce(patent_count, 0) AS patent_count, state_list, min_date, io_labeled FROM patent_file_references r LEFT JOIN (SELECT file_ref_id, count(DISTINCT patent_accession) AS patent_count, string_agg(DISTINCT state, '; ' ORDER BY state) AS state_list, min(signed) AS min_date,
CASE WHEN bool_or(io_labeled = 'yes') AND bool_or(io_labeled = 'no') THEN 'mixed' WHEN bool_or(io_labeled = 'yes') THEN 'yes' WHEN bool_or(io_labeled = 'no') THEN 'no' WHEN bool_or(io_labeled = 'unknown') THEN 'unknown' END AS io_labeled
FROM patent_file_ref_links l LEFT JOIN (SELECT accession_number, min(state) AS state, min(signature_date) AS signed FROM rails_patents GROUP BY 1) p ON l.patent_accession = p.accession_number GROUP BY 1) a ON r.id = a.file_ref_id)"""


@query(f"SELECT CAST(id AS BIGINT) AS id, letter_number, CAST(patent_count AS BIGINT) AS patent_count, state_list, io_labeled FROM {_FILES} WHERE year BETWEEN 1907 AND 1942 AND patent_count >= 2 AND (coalesce(letter_number ILIKE '%1%', FALSE) OR coalesce(year_raw ILIKE '%1%', FALSE) OR coalesce(state_list ILIKE '%1%', FALSE)) ORDER BY patent_count DESC, letter_number, year_raw NULLS LAST, id LIMIT 50")
def file_refs_page(spark: SparkSession, d: str) -> DataFrame:
    rows = search(_file_rows(spark, d), FILE_GRID, {"search": "1", "era": "ccf_1907_1942", "min_patents": "2", "max_year": "unknown", "io_labeled": "any"}, [], 0, 50)
    return rows.page.select(_id(), "letter_number", F.col("patent_count").cast("long").alias("patent_count"), "state_list", "io_labeled")


@query("""SELECT CAST(id AS BIGINT) AS id, trust_accession, fee_accession FROM trust_fee_linkages_recovered WHERE NOT coalesce(name_consistent, FALSE) AND date_gap_years >= 5 AND date_gap_years <= 40 AND (coalesce(trust_accession ILIKE '%1%', FALSE) OR coalesce(fee_accession ILIKE '%1%', FALSE) OR coalesce(name_overlap ILIKE '%1%', FALSE)) ORDER BY date_gap_years NULLS LAST, trust_accession NULLS LAST, fee_accession NULLS LAST, id LIMIT 50 OFFSET 10""")
def linkages_page(spark: SparkSession, d: str) -> DataFrame:
    page = search(table(spark, d, "trust_fee_linkages_recovered"), LINKAGE_GRID, {"name_consistent": "no", "min_gap": 5, "max_gap": "40", "search": "1"}, [], 10, 50).page
    return page.select(_id(), "trust_accession", "fee_accession")


@query(f"""SELECT CAST(c.id AS BIGINT) AS id, c.case_number, CAST(count(b.bc) AS BIGINT) AS patent_count, min(b.signature_date) AS min_date FROM federal_register_claims c LEFT JOIN {_BRIDGE} b ON ltrim(c.case_number, '0') = b.bc AND c.allottee_name = b.bn WHERE c.tribe_identified = (SELECT min(tribe_identified) FROM federal_register_claims WHERE trim(tribe_identified, ' ') <> '') GROUP BY c.id, c.case_number ORDER BY patent_count DESC, case_number NULLS LAST, id LIMIT 25""")
def tribe_claims_page(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "federal_register_claims")
    tribe = claims.where(blank_to_null(F.col("tribe_identified")).isNotNull()).agg(F.min("tribe_identified")).first()[0]
    rows = bridge_join(claims, _bridge(spark, d).withColumn("b", F.lit(True))).groupBy("id", "case_number", "allottee_name", "allotment_number", "tribe_identified").agg(F.count("b").alias("patent_count"), F.min("signature_date").alias("min_date"))
    return search(rows, TRIBE_CLAIM_GRID, {"tribe": tribe}, [(4, "desc"), (0, "asc")], 0, 25).page.select(_id(), "case_number", "patent_count", "min_date")


_PERSONS = "(SELECT id, trim(regexp_extract(p, '^(\\S+)\\s', 1), ' ') AS first, trim(regexp_extract(p, '^\\S+\\s+(.*)$', 1), ' ') AS last FROM (SELECT id, trim(unnest(string_split(full_name, ';')), ' ') AS p FROM rails_patents WHERE full_name IS NOT NULL))"


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """First and last names of everybody named in a patent."""
    p = table(spark, d, "rails_patents").where("full_name IS NOT NULL").select(F.col("id"), F.explode(F.split("full_name", ";")).alias("p")).withColumn("p", F.trim("p"))
    return p.select("id", F.trim(F.regexp_extract("p", r"^(\S+)\s", 1)).alias("first"), F.trim(F.regexp_extract("p", r"^\S+\s+(.*)$", 1)).alias("last"))


def _duck_sim(a: str, b: str) -> str:
    g, h = _duck_grams(a), _duck_grams(b)
    return f"(coalesce(len(list_intersect({g}, {h})) / nullif(CAST(len({g}) + len({h}) - len(list_intersect({g}, {h})) AS DOUBLE), 0), 0) >= 0.65)"


def _searched(fit: str, q: str) -> str:
    return f"SELECT CAST(p.id AS BIGINT) AS id, CASE WHEN full_name ILIKE '%{q}%' THEN 'exact' ELSE 'fuzzy' END AS match_type, round({_duck_span(chr(39) + q.lower() + chr(39), 'full_name')}, 6) AS sim FROM rails_patents p WHERE coalesce(full_name ILIKE '%{q}%', FALSE) OR p.id IN (SELECT id FROM {_PERSONS} WHERE {fit})"


@query(_searched(_duck_sim("first", "'KEZIAH'") + " OR " + _duck_sim("last", "'KEZIAH'"), "KEZIAH"))
def name_search_one_word(spark: SparkSession, d: str) -> DataFrame:
    return person_search(table(spark, d, "rails_patents"), _persons(spark, d), "id", "full_name", "KEZIAH").select(_id(), "match_type", F.round("sim_score", 6).alias("sim"))


@query("SELECT * FROM (" + _searched(_duck_sim("first", "'ISAAC'") + " AND " + _duck_sim("last", "'KUDUVEPOKO'"), "ISAAC KUDUVEPOKO") + ") ORDER BY match_type, sim DESC, id LIMIT 20")
def name_search_page(spark: SparkSession, d: str) -> DataFrame:
    """A first and a last name of one person, the literal matches first, then the more similar, twenty of them."""
    found = person_search(table(spark, d, "rails_patents"), _persons(spark, d), "id", "full_name", "ISAAC KUDUVEPOKO")
    spec = SearchSpec(sortable=PATENT_GRID.sortable, default=(("id", "asc"),))
    return found.orderBy(*relevance_first(spec, [])).limit(20).select(_id(), "match_type", F.round("sim_score", 6).alias("sim"))


@query(_searched(_duck_sim("first", "'SAMUEL'") + " AND " + _duck_sim("last", "'TADO TIVUNE'"), "SAMUEL TADO TIVUNE"))
def name_search_three_words(spark: SparkSession, d: str) -> DataFrame:
    return person_search(table(spark, d, "rails_patents"), _persons(spark, d), "id", "full_name", "SAMUEL TADO TIVUNE").select(_id(), "match_type", F.round("sim_score", 6).alias("sim"))


_EVIDENCE = f"""(SELECT CAST(a.id AS BIGINT) AS id, CAST(b.id AS BIGINT) AS sibling, b.glo_tribe_name AS label, round({_duck_span('a.full_name', 'b.full_name')}, 6) AS s, coalesce(a.land_office = b.land_office, FALSE) AS same, b.signature_date AS dt
FROM rails_patents a JOIN rails_patents b ON a.state = b.state AND a.indian_allotment_number = b.indian_allotment_number AND a.accession_number <> b.accession_number WHERE a.glo_tribe_name IS NULL AND trim(a.full_name, ' ') <> '' AND trim(a.indian_allotment_number, ' ') <> '' AND trim(b.full_name, ' ') <> '' AND trim(b.glo_tribe_name, ' ') <> '')"""


@query(f"""WITH e AS (SELECT * FROM {_EVIDENCE} WHERE s >= 0.65), t AS (SELECT *, CASE WHEN same AND s = 1 THEN 1 WHEN same AND s >= 0.7 THEN 2 WHEN same THEN 3 WHEN s = 1 THEN 4 ELSE 5 END AS tier FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, CASE WHEN tier = 2 THEN -s ELSE 0 END, dt NULLS LAST, sibling) AS rn, count(DISTINCT label) OVER (PARTITION BY id) > 1 AS several FROM t)
SELECT id, CASE WHEN several THEN 'disagreement' ELSE 'T' || tier END AS tier, CASE WHEN NOT several AND tier <= 2 THEN label END AS label, CASE WHEN NOT several AND tier <= 2 THEN sibling END AS sibling FROM r WHERE rn = 1""")
def sibling_evidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Patents without a label beside labelled ones of one state and number, whose name holds a run of words like theirs; the tier of the evidence."""
    p = table(spark, d, "rails_patents").where("trim(full_name) != '' AND trim(indian_allotment_number) != ''")
    key = ["state", "indian_allotment_number"]
    a = p.where("glo_tribe_name IS NULL").select(_id(), *key, F.col("accession_number").alias("acc"), F.col("full_name").alias("name"), F.col("land_office").alias("office"))
    b = p.where("trim(glo_tribe_name) != ''").select(F.col("id").cast("long").alias("sibling"), *key, "accession_number", "full_name", F.col("glo_tribe_name").alias("label"), "land_office", "signature_date")
    pairs = a.join(b, key).where("acc != accession_number").withColumn("sim", span_similarity(F.col("name"), F.col("full_name"))).where(F.round("sim", 6) >= 0.65)
    return evidence_tier(pairs.withColumn("same", F.col("office") == F.col("land_office")), "id", "label", "sim", "same", "signature_date", "sibling")


_NINE = ["state", "number", "tribe", "township", "township_dir", "range_", "range_dir", "office", "serial"]
_NINE_SQL = "coalesce(state, ''), coalesce(indian_allotment_number, ''), coalesce(glo_tribe_name, ''), coalesce(regexp_extract(geographic_name, '^T ([0-9]+)', 1), ''), coalesce(regexp_extract(geographic_name, '^T [0-9]+([NS])', 1), ''), coalesce(regexp_extract(geographic_name, 'R ([0-9]+)', 1), ''), coalesce(regexp_extract(geographic_name, 'R [0-9]+([EW])$', 1), ''), coalesce(land_office, ''), coalesce(left(blm_serial_number, 2), '')"
_TOK = "list_filter(list_distinct(list_filter(string_split_regex(upper(full_name), '[\\s;,./-]+'), lambda t: length(t) >= 2)), lambda t: t NOT IN ('JR', 'SR', 'II', 'III', 'IV', 'MRS', 'MR', 'MISS', 'DR'))"


@query(f"""WITH p AS (SELECT CAST(id AS BIGINT) AS id, [{_NINE_SQL}] AS k, signature_date AS dt, authority, {_TOK} AS tok FROM rails_patents WHERE full_name IS NOT NULL)
SELECT t.id AS trust_id, f.id AS fee_id, CAST(floor(date_diff('day', t.dt, f.dt) / 365) AS BIGINT) AS gap FROM p t JOIN p f ON t.k = f.k WHERE t.authority IN ({_TRUST}) AND f.authority IN ({_FEE}) AND coalesce(f.dt >= t.dt, TRUE) AND list_has_any(t.tok, f.tok)""")
def linkage_parcel_nine(spark: SparkSession, d: str) -> DataFrame:
    """The parcel join on nine columns."""
    part = lambda r: F.regexp_extract("geographic_name", r, 1)
    p = table(spark, d, "rails_patents").where("full_name IS NOT NULL").select(
        _id(), "state", F.col("indian_allotment_number").alias("number"), F.col("glo_tribe_name").alias("tribe"), part("^T ([0-9]+)").alias("township"), part("^T [0-9]+([NS])").alias("township_dir"), part("R ([0-9]+)").alias("range_"), part("R [0-9]+([EW])$").alias("range_dir"),
        F.col("land_office").alias("office"), F.left("blm_serial_number", F.lit(2)).alias("serial"), "signature_date", "full_name", "authority",
    )
    return composite_links(p.where(F.col("authority").isin(TRUST_AUTHORITIES)), p.where(F.col("authority").isin(FEE_AUTHORITIES)), _NINE, "signature_date", "full_name")


_AMOUNTS = f"""(SELECT count(*) AS total, count(*) FILTER (WHERE authority IN ({_TRUST})) AS trust, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee, count(*) FILTER (WHERE authority IN ({_TRUST}) AND cancelled_doc) AS cancelled, count(*) FILTER (WHERE authority IN ({_FEE}) AND cancelled_doc) AS fee_cancelled,
(SELECT count(DISTINCT l.trust_accession) FROM trust_fee_linkages_recovered l WHERE l.fee_accession IS NOT NULL AND l.trust_accession IN (SELECT accession_number FROM rails_patents WHERE authority IN ({_TRUST}))) AS converted FROM rails_patents)"""
_FLOWS = f"""(SELECT * FROM (SELECT unnest(['patents', 'patents', 'patents', 'trust', 'trust', 'trust', 'fee', 'fee', 'fee']) AS source, unnest(['trust', 'fee', 'other', 'converted', 'trust_cancelled', 'remained', 'fee_cancelled', 'fee_standing', 'unheard']) AS target,
unnest([trust, fee, greatest(total - trust - fee, 0), converted, cancelled, greatest(trust - converted - cancelled, 0), fee_cancelled, fee - fee_cancelled, 0]) AS value FROM {_AMOUNTS}) WHERE value > 0)"""


def _network(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("authority")
    trust, fee = a.isin(TRUST_AUTHORITIES), a.isin(FEE_AUTHORITIES)
    rails = table(spark, d, "rails_patents")
    counts = rails.agg(F.count("*").alias("total"), F.count_if(trust).alias("trust"), F.count_if(fee).alias("fee"), F.count_if(trust & F.col("cancelled_doc")).alias("trust_cancelled"), F.count_if(fee & F.col("cancelled_doc")).alias("fee_cancelled"))
    linked = table(spark, d, "trust_fee_linkages_recovered").where("fee_accession IS NOT NULL").join(rails.where(trust).select(F.col("accession_number").alias("trust_accession")), "trust_accession", "left_semi").agg(F.countDistinct("trust_accession").alias("converted"))
    rest = lambda x: F.greatest(x, F.lit(0))
    stages = counts.join(F.broadcast(linked)).withColumns({"other": rest(F.col("total") - F.col("trust") - F.col("fee")), "remained": rest(F.col("trust") - F.col("converted") - F.col("trust_cancelled")), "fee_standing": F.col("fee") - F.col("fee_cancelled"), "unheard": F.lit(0)})  # one row each
    return flow(stages, [("patents", c, c) for c in ("trust", "fee", "other")] + [("trust", c, c) for c in ("converted", "trust_cancelled", "remained")] + [("fee", c, c) for c in ("fee_cancelled", "fee_standing", "unheard")])


@query(f"SELECT source, target, CAST(value AS BIGINT) AS value FROM {_FLOWS}")
def flow_network(spark: SparkSession, d: str) -> DataFrame:
    return _network(spark, d)


@query(f"SELECT node, CAST(coalesce(sum(v) FILTER (WHERE side = 'out'), 0) AS BIGINT) AS outflow, CAST(coalesce(sum(v) FILTER (WHERE side = 'in'), 0) AS BIGINT) AS inflow FROM (SELECT source AS node, value AS v, 'out' AS side FROM {_FLOWS} UNION ALL SELECT target, value, 'in' FROM {_FLOWS}) GROUP BY 1")
def flow_network_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flow_nodes(_network(spark, d))


_COHORT = "(SELECT l.file_ref_id, p.accession_number, p.state, p.authority, p.glo_tribe_name, l.context_label FROM patent_file_ref_links l JOIN rails_patents p ON l.patent_accession = p.accession_number QUALIFY row_number() OVER (PARTITION BY l.file_ref_id, p.accession_number ORDER BY p.signature_date NULLS LAST, p.id, l.id) = 1)"


@query(f"""SELECT CAST(file_ref_id AS BIGINT) AS ref_id, field, value, CAST(n AS BIGINT) AS n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_ref_id, field ORDER BY n DESC, value) AS place FROM (SELECT file_ref_id, field, value, count(*) AS n FROM (UNPIVOT (SELECT file_ref_id, state, authority, glo_tribe_name, context_label FROM {_COHORT}) ON state, authority, glo_tribe_name, context_label INTO NAME field VALUE value) WHERE trim(value, ' ') <> '' GROUP BY 1, 2, 3)) WHERE place <= 10""")
def file_ref_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent states, authorities, tribes and labels of each reference's cohort of patents."""
    links = table(spark, d, "patent_file_ref_links").select("file_ref_id", F.col("patent_accession").alias("accession_number"), F.col("id").alias("link_id"), "context_label")
    cohort = links.join(table(spark, d, "rails_patents").select("id", "accession_number", "state", "authority", "glo_tribe_name", "signature_date"), "accession_number")
    cohort = first_per_key(cohort, ["file_ref_id", "accession_number"], F.col("signature_date").asc_nulls_last(), F.col("id"), F.col("link_id"))
    return top_counts(cohort.withColumn("ref_id", F.col("file_ref_id").cast("long")), ["ref_id"], ["state", "authority", "glo_tribe_name", "context_label"], 10)


@query(f"""WITH c AS (SELECT year(signature_date) AS year, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee, count(*) FILTER (WHERE authority IN ({_FEE}) AND cancelled_doc) AS forced FROM rails_patents WHERE signature_date IS NOT NULL GROUP BY 1), s AS (SELECT unnest(range(CAST((SELECT min(year) - 10 FROM c) AS BIGINT), CAST((SELECT max(year) + 1 FROM c) AS BIGINT))) AS year),
k AS (SELECT s.year, sum(coalesce(fee, 0)) OVER w AS cf, sum(coalesce(forced, 0)) OVER w AS cx FROM s LEFT JOIN c ON s.year = c.year WINDOW w AS (ORDER BY s.year)) SELECT year, CAST(cf AS BIGINT) AS cum_fee, CAST(cx AS BIGINT) AS cum_forced, CAST(cf - cx AS BIGINT) AS cum_voluntary, round(cf * 100.0 / max(cf) OVER (), 2) AS share FROM k""")
def cumulative_shares(spark: SparkSession, d: str) -> DataFrame:
    fee = F.col("authority").isin(FEE_AUTHORITIES)
    counts = timeline(table(spark, d, "rails_patents"), F.year("signature_date"), {"fee": fee, "forced": fee & F.col("cancelled_doc")})
    rows = cumulative(counts, "year", ["fee", "forced"], lead=10)
    total = F.max("cum_fee").over(Window.partitionBy(F.lit(1)))  # a row per year
    return rows.select("year", "cum_fee", "cum_forced", (F.col("cum_fee") - F.col("cum_forced")).alias("cum_voluntary"), F.round(F.col("cum_fee") * F.lit(100.0) / total, 2).alias("share"))


@query(f"""WITH y AS (SELECT glo_tribe_name AS tribe, CASE WHEN authority IN ({_FEE}) THEN 'fee' WHEN authority IN ({_TRUST}) THEN 'trust' ELSE 'other' END AS class, year(signature_date) AS year FROM rails_patents WHERE glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL),
m AS (SELECT tribe, quantile_cont(year, 0.5) FILTER (WHERE class = 'fee') - quantile_cont(year, 0.5) FILTER (WHERE class = 'trust') AS lag FROM y GROUP BY 1 HAVING count(*) FILTER (WHERE class = 'trust') >= 3 AND count(*) FILTER (WHERE class = 'fee') >= 3)
SELECT CAST(count(*) AS BIGINT) AS tribes, round(avg(lag), 6) AS average_lag, CAST(count(*) FILTER (WHERE lag > 0 AND lag < 10) AS BIGINT) AS fast, CAST(count(*) FILTER (WHERE lag <= 0) AS BIGINT) AS backwards FROM m""")
def velocity_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rails_patents").where("glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL").select(F.col("glo_tribe_name").alias("tribe"), patent_class(F.col("authority")).alias("class"), F.year("signature_date").alias("year"))
    of = lambda c: F.when(F.col("class") == c, F.col("year"))
    lags = rows.groupBy("tribe").agg((F.percentile(of("fee"), 0.5) - F.percentile(of("trust"), 0.5)).alias("lag"), F.count(of("trust")).alias("nt"), F.count(of("fee")).alias("nf")).where("nt >= 3 AND nf >= 3")
    return lags.agg(F.count("*").alias("tribes"), F.round(F.avg("lag"), 6).alias("average_lag"), F.count_if((F.col("lag") > 0) & (F.col("lag") < 10)).alias("fast"), F.count_if(F.col("lag") <= 0).alias("backwards"))


@query("""SELECT id, unnest(range(1, len(vs) + 1)) AS place, unnest(vs) AS variant FROM (SELECT id, list_filter([a, b, CASE WHEN dg THEN nullif(ltrim(b, '0'), '') END, CASE WHEN dg THEN lpad(b, CAST(greatest(5, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(6, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(7, length(b)) AS INTEGER), '0') END, CASE WHEN dg THEN lpad(b, CAST(greatest(8, length(b)) AS INTEGER), '0') END,
CASE WHEN dg AND length(b) >= 5 THEN substr(b, 1, length(b) - 3) || '-' || right(b, 3) END, CASE WHEN dg AND length(b) >= 5 THEN substr(b, 1, length(b) - 4) || '-' || right(b, 4) END], lambda v, i: v IS NOT NULL AND v <> '') AS vs0, list_filter(vs0, lambda v, i: list_position(vs0, v) = i) AS vs FROM (SELECT CAST(id AS BIGINT) AS id, accession_number AS a, regexp_replace(upper(accession_number), '[^A-Z0-9]', '', 'g') AS b, regexp_full_match(regexp_replace(upper(accession_number), '[^A-Z0-9]', '', 'g'), '[0-9]+') AS dg FROM rails_patents))""")
def accession_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rails_patents").select(_id(), F.posexplode(key_variants(F.col("accession_number"))).alias("p", "variant"))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("place"), "variant")


_YEAR = "CASE WHEN regexp_full_match(trim(publication_date, ' '), '\\d{4}-\\d{2}-\\d{2}') THEN year(try_cast(trim(publication_date, ' ') AS DATE)) WHEN regexp_full_match(trim(publication_date, ' '), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN year(try_strptime(trim(publication_date, ' '), '%m/%d/%Y')) END"


@query(f"""SELECT tribe_identified AS tribe, CAST({_YEAR} AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE claim_type ILIKE '%TRESPASS%' OR claim_type ILIKE '%ENCROACHMENT%') AS BIGINT) AS trespass FROM federal_register_claims WHERE trim(tribe_identified, ' ') <> '' GROUP BY 1, 2""")
def claim_portraits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "federal_register_claims").where("trim(tribe_identified) != ''")
    return rows.groupBy(F.col("tribe_identified").alias("tribe"), F.year(parse_date(F.col("publication_date"))).cast("long").alias("year")).agg(F.count("*").alias("claims"), F.count_if(in_claim_group(F.col("claim_type"), "TRESPASS")).alias("trespass"))
