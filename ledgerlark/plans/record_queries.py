"""Queries over record fields, the claims bridge, mapped labels, evidence tiers, grids and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ledgerlark.functions import records as R
from ledgerlark.functions.dates import parse_date
from ledgerlark.functions.text import FEE_AUTHORITIES, TRUST_AUTHORITIES, blank_to_null, fee_references, slugify, strip_zeros
from ledgerlark.operators.bridge import bridge_join, label_map, mapped_rates, match_reservations
from ledgerlark.operators.quality import gap_audit, gap_rollup, sequence_gaps
from ledgerlark.operators.unify import first_per_key
from ledgerlark.plans.catalogue_queries import _FEE, _TRUST
from ledgerlark.plans.linkage_queries import _REFS
from ledgerlark.plans.registry import Registry
from ledgerlark.runtime import table
from ledgerlark.sources.readers import feature_rows, model_outputs, spreadsheet_rows, wanted_rows

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _id():
    return F.col("id").cast("long").alias("id")


_T = lambda c: f"trim({c}, ' ')"


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


_rails, _claims, _links, _circular, _crosswalk, _reference, _files, _file_links, _cloud = map(
    _t, ("rails_patents", "federal_register_claims", "trust_fee_linkages_recovered", "circular_2464_records", "tribe_crosswalk", "tribe_reference", "patent_file_references", "patent_file_ref_links", "rails_patents_cloud")
)
_CODE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CLASS_CODES.items())


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN accession_number <> '' THEN '{R.RECORD_ADDRESS}?accession=' || accession_number || '&docClass=' || CASE WHEN length(c) <= 5 THEN c ELSE 'SER' END END AS url
FROM (SELECT id, accession_number, CASE document_class {_CODE_CASES} ELSE nullif(document_class, '') END AS c FROM rails_patents)""")
def record_links(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).select(_id(), R.record_url(F.col("accession_number"), F.col("document_class")).alias("url"))


@query(rf"""SELECT CAST(id AS BIGINT) AS id, regexp_replace(remarks, '((?:NR\.?|AND)\s+)(\d{{4,}})', '\1<a href="{R.RECORD_ADDRESS}?accession=\2&docClass=SER" target="_blank">\2</a>', 'g') AS html FROM rails_patents WHERE remarks IS NOT NULL""")
def remarks_linked(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).where("remarks IS NOT NULL").select(_id(), R.linked_remarks(F.col("remarks")).alias("html"))


_SLUG = "trim(regexp_replace(regexp_replace(lower(trim({c}, ' ')), '[''\"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH l AS (SELECT {_SLUG.format(c='tribe_name')} AS slug, min(tribe_name) AS label FROM tribe_reference GROUP BY 1), c AS (SELECT DISTINCT {_SLUG.format(c='tribe_identified')} AS slug FROM federal_register_claims WHERE {_T('tribe_identified')} <> '')
SELECT c.slug, l.label FROM c LEFT JOIN l ON c.slug = l.slug""")
def slug_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = _reference(spark, d).groupBy(slugify(F.col("tribe_name")).alias("slug")).agg(F.min("tribe_name").alias("label"))
    return _claims(spark, d).where(blank_to_null(F.col("tribe_identified")).isNotNull()).select(slugify(F.col("tribe_identified")).alias("slug")).distinct().join(labels, "slug", "left")


@query("""SELECT coalesce(CASE WHEN contains(replace(replace(upper(context_label), '.', ''), ' ', ''), 'IO') THEN 'yes' WHEN contains(upper(context_label), 'BIA') OR contains(upper(context_label), 'DOCUMENT') THEN 'unknown' END, 'other') AS io, context_label, CAST(count(*) AS BIGINT) AS n FROM patent_file_ref_links GROUP BY 1, 2""")
def io_labels(spark: SparkSession, d: str) -> DataFrame:
    return _file_links(spark, d).groupBy(F.coalesce(R.io_label(F.col("context_label")), F.lit("other")).alias("io"), "context_label").agg(F.count("*").alias("n"))


_STRUCTURED = "SELECT id, '{c}' AS field, '{io}' AS io, regexp_extract({t}, '^([0-9]{{4,6}})-([0-9]{{2}})$', 1) AS letter, regexp_extract({t}, '^([0-9]{{4,6}})-([0-9]{{2}})$', 2) AS yy FROM rails_patents WHERE regexp_matches({t}, '^[0-9]{{4,6}}-[0-9]{{2}}$')"


@query("SELECT CAST(id AS BIGINT) AS id, field, io, letter, CAST(1900 + CAST(yy AS INTEGER) AS BIGINT) AS year FROM (" + " UNION ALL ".join(_STRUCTURED.format(c=c, t=_T(c), io=io) for c, io in (("misc_document_number", "yes"), ("document_number", "no"), ("accession_number", "no"))) + ")")
def structured_file_refs(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"^([0-9]{4,6})-([0-9]{2})$"
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(io).alias("io"), F.trim(c).alias("v")) for c, io in (("misc_document_number", "yes"), ("document_number", "no"), ("accession_number", "no"))])
    rows = _rails(spark, d).select(_id(), F.explode(cells).alias("c")).where(F.col("c.v").rlike(pattern))
    return rows.select("id", "c.field", "c.io", F.regexp_extract("c.v", pattern, 1).alias("letter"), (1900 + F.regexp_extract("c.v", pattern, 2).cast("int")).cast("long").alias("year"))


@query(r"""SELECT printed, nullif(trim(regexp_extract(printed, ':\s*(.+?)\s*\(', 1), ' '), '') AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([authority, 'February 8, 1887: ' || authority || ' (24 Stat. 388)']) AS printed FROM rails_patents WHERE authority IS NOT NULL) GROUP BY 1, 2""")
def authority_names(spark: SparkSession, d: str) -> DataFrame:
    printed = F.explode(F.array("authority", F.concat(F.lit("February 8, 1887: "), "authority", F.lit(" (24 Stat. 388)")))).alias("printed")
    rows = _rails(spark, d).where("authority IS NOT NULL").select(printed)
    return rows.groupBy("printed", R.authority_name(F.col("printed")).alias("name")).agg(F.count("*").alias("n"))


_REASON = """CASE WHEN r IS NULL OR r = '' THEN NULL WHEN regexp_matches(r, '1927\\s*and\\s*1931\\s*act') THEN '1927_and_1931_acts'
WHEN (contains(r, 'issued w/o application') OR contains(r, 'issued without application')) AND contains(r, 'refus') THEN 'issued_without_application_and_acceptance_refused'
WHEN contains(r, 'issued w/o application') OR contains(r, 'issued without application') THEN 'issued_without_application' WHEN contains(r, 'refus') THEN 'acceptance_refused' WHEN contains(r, 'caster patent') THEN 'caster_patent_letter'
WHEN contains(r, 'decree') THEN 'court_decree' WHEN contains(r, 'incompetent') THEN 'incompetency_determination' WHEN regexp_matches(r, '\\b1927\\b') THEN '1927_act' WHEN regexp_matches(r, '\\b1931\\b') THEN '1931_act'
WHEN contains(r, 'canceled by order') OR contains(r, 'cancelled by order') THEN 'individual_order' ELSE 'other' END"""


@query(f"""SELECT field, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT field, {_REASON} AS reason FROM (SELECT 'remarks' AS field, lower({_T('remarks')}) AS r FROM rails_patents UNION ALL SELECT 'refused', lower({_T('refused_protested')}) FROM circular_2464_records UNION ALL SELECT 'notes', lower({_T('notes')}) FROM circular_2464_records)) GROUP BY 1, 2""")
def cancellation_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = _circular(spark, d)
    texts = _rails(spark, d).select(F.lit("remarks").alias("field"), F.col("remarks").alias("t")).unionByName(c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(x).alias("t")) for n, x in (("refused", "refused_protested"), ("notes", "notes"))])).alias("x")).select("x.*"))
    return texts.groupBy("field", R.cancellation_reason(F.col("t")).alias("reason")).agg(F.count("*").alias("n"))


_NUMBERS = """SELECT id, t, try_cast(nullif(regexp_replace(CASE WHEN c1 NOT IN ('—', '-', '…', '') THEN c1 END, '[^0-9]', '', 'g'), '') AS DECIMAL(38,0)) AS counted,
try_cast(CASE WHEN c2 NOT IN ('—', '-', '…', 'No answer', '0', '') THEN c2 END AS DOUBLE) AS tailed, try_cast(CASE WHEN c3 NOT IN ('—', '-', '…', '') THEN c3 END AS DOUBLE) AS amount
FROM (SELECT id, t, trim(replace(regexp_replace(regexp_replace(t, '^(\\d{1,2})\\s+(\\d{1,3}(?:,\\d{3})+)', '\\2'), '^(\\d{1,2})\\s+(\\d+)$', '\\2'), ',', ''), ' ') AS c1, regexp_replace(trim(replace(t, ',', ''), ' '), '\\s+\\d+$', '') AS c2, trim(replace(replace(t, ',', ''), '$', ''), ' ') AS c3
FROM (SELECT id, unnest([occupation_income, age, allotment_number, '22 ' || allotment_number, allotment_number || ' 3']) AS t FROM circular_2464_records))"""


@query(f"SELECT t, CAST(counted AS VARCHAR) AS counted, tailed, amount, CAST(count(*) AS BIGINT) AS n FROM ({_NUMBERS}) WHERE t IS NOT NULL AND NOT regexp_matches(t, '[0-9][eEdDfF]|(?i)nan|inf') GROUP BY ALL")
def printed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The three ways to read printed numbers; texts that only a float parser takes for numbers (1e5, nan) aside, which engines read differently."""
    texts = F.explode(F.array("occupation_income", "age", "allotment_number", F.concat(F.lit("22 "), "allotment_number"), F.concat("allotment_number", F.lit(" 3")))).alias("t")
    rows = _circular(spark, d).select(texts).where(F.col("t").isNotNull() & ~F.col("t").rlike("[0-9][eEdDfF]|(?i)nan|inf"))
    t = F.col("t")
    return rows.groupBy("t", R.footnoted_count(t).cast("string").alias("counted"), R.tailnoted_number(t).alias("tailed"), R.money(t).alias("amount")).agg(F.count("*").alias("n"))


@query(r"""SELECT replace(replace(regexp_replace(trim(a, ' '), '\s+\d+$', ''), ' consolidated', ''), ' area field office', '') AS agency, year, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([land_office, land_office || ' consolidated 2', land_office || ' area field office']) AS a, try_cast(nullif(regexp_extract(trim(survey_date, ' '), '^(\d{4})', 1), '') AS INTEGER) AS year FROM rails_patents) WHERE a IS NOT NULL GROUP BY 1, 2""")
def agency_years(spark: SparkSession, d: str) -> DataFrame:
    a = F.explode(F.array("land_office", F.concat("land_office", F.lit(" consolidated 2")), F.concat("land_office", F.lit(" area field office")))).alias("a")
    return _rails(spark, d).select(a, "survey_date").where("a IS NOT NULL").groupBy(R.agency_name(F.col("a")).alias("agency"), R.leading_year(F.col("survey_date")).alias("year")).agg(F.count("*").alias("n"))


_MANUAL = {"mixed": None, "unknown": None, "not stated": None}


@query("""WITH l AS (SELECT DISTINCT t AS label, coalesce(nullif(trim(regexp_extract(t, '^.+\\(A\\.\\):\\s*(.+?)\\s*\\(R\\.\\)', 1), ' '), ''), nullif(trim(regexp_extract(t, '^(.+?)\\s*\\(A\\. and R\\.\\)', 1), ' '), ''), t) AS core
FROM (SELECT unnest([tribe_reservation, CASE WHEN post_office_address = tribe_reservation THEN tribe_reservation || ' (A. and R.)' ELSE post_office_address || ' (A.): ' || tribe_reservation || ' (R.)' END]) AS t FROM circular_2464_records) WHERE trim(t, ' ') <> ''),
n AS (SELECT reservation_name AS name, count(*) AS n FROM tribe_reference GROUP BY 1),
p AS (SELECT l.label, first(n.name ORDER BY n.n DESC, n.name) AS name FROM l JOIN n ON contains(lower(l.core), lower(n.name)) OR contains(lower(n.name), lower(l.core)) WHERE l.core <> '' GROUP BY 1),
w AS (SELECT l.label, min(n.name) AS name FROM l JOIN n ON starts_with(lower(n.name), regexp_extract(lower(l.core), '^\\s*(\\S+)', 1)) WHERE length(regexp_extract(lower(l.core), '^\\s*(\\S+)', 1)) >= 4 GROUP BY 1 HAVING count(*) = 1)
SELECT l.label, l.core, CASE WHEN l.label IN ('mixed', 'unknown', 'not stated') THEN NULL ELSE coalesce(p.name, w.name) END AS name, CASE WHEN l.label IN ('mixed', 'unknown', 'not stated') THEN 'no_match' WHEN p.name IS NOT NULL THEN 'substring' WHEN w.name IS NOT NULL THEN 'first_word' ELSE 'unmatched' END AS method FROM l LEFT JOIN p ON l.label = p.label LEFT JOIN w ON l.label = w.label""")
def reservation_labels(spark: SparkSession, d: str) -> DataFrame:
    t, a = F.col("tribe_reservation"), F.col("post_office_address")
    labels = _circular(spark, d).select(F.explode(F.array(t, R.reservation_label(a, t))).alias("label")).where(F.trim("label") != "")
    names = _reference(spark, d).groupBy(F.col("reservation_name").alias("name")).agg(F.count("*").alias("n"))
    return match_reservations(labels.withColumn("core", R.reservation_core(F.col("label"))), names, _MANUAL)


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN {_T('authoritative_reservation')} <> '' AND upper({_T('authoritative_reservation')}) <> 'FRN' THEN replace({_T('authoritative_reservation')}, 'Seltathod Creek Res.', 'Seltathod Creek Reservation') END AS canonical FROM tribe_crosswalk""")
def canonical_reservations(spark: SparkSession, d: str) -> DataFrame:
    return _crosswalk(spark, d).select(_id(), R.canonical_label(F.col("authoritative_reservation"), {"Seltathod Creek Res.": "Seltathod Creek Reservation"}).alias("canonical"))


@query(r"""SELECT doc_id, CAST(try_cast(nullif(regexp_extract(t, '(?i)^part(\d+)_', 1), '') AS INTEGER) AS INTEGER) AS part, CASE WHEN k = '' THEN 'unknown' WHEN starts_with(k, 'ledger') THEN 'ledger' ELSE k END AS kind FROM (SELECT doc_id, t, lower(regexp_extract(coalesce(t, ''), '(?i)_(agency_narrative|questionnaire|affidavit|ledger(?:_page|_entry)?|shawnee)', 1)) AS k FROM (SELECT doc_id, 'Part' || CAST(doc_id % 7 AS VARCHAR) || '_' || CASE doc_id % 3 WHEN 0 THEN 'Ledger_Page' WHEN 1 THEN doc_type ELSE 'x' END AS t FROM documents))""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "Ledger_Page").when(F.col("doc_id") % 3 == 1, F.col("doc_type")).otherwise("x")
    t = F.concat(F.lit("Part"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), kind)
    return table(spark, d, "documents").select("doc_id", R.document_part(t).alias("part"), R.document_kind(t).alias("kind"))


_OFFICES = {"female": "F", "male": "M", "F": "F", "M": "M", "not stated": None}


@query("""SELECT gender, CASE gender WHEN 'female' THEN 'F' WHEN 'male' THEN 'M' WHEN 'F' THEN 'F' WHEN 'M' THEN 'M' END AS label, coalesce(gender IN ('female', 'male', 'F', 'M', 'not stated'), FALSE) AS is_mapped, CAST(count(*) AS BIGINT) AS n FROM circular_2464_records GROUP BY ALL""")
def mapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return _circular(spark, d).groupBy("gender", R.mapped(F.col("gender"), _OFFICES).alias("m")).agg(F.count("*").alias("n")).select("gender", "m.label", "m.is_mapped", "n")


@query("""SELECT c.bia_agency_code AS code, coalesce(r.label, 'Unidentified (' || c.bia_agency_code || ')') AS agency, CAST(count(*) AS BIGINT) AS n FROM federal_register_claims c LEFT JOIN (SELECT agency_code, min(reservation_name) AS label FROM tribe_reference WHERE agency_code < 'H' GROUP BY 1) r ON c.bia_agency_code = r.agency_code GROUP BY 1, 2""")
def agency_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = _reference(spark, d).where("agency_code < 'H'").groupBy(F.col("agency_code").alias("code")).agg(F.min("reservation_name").alias("label"))
    rows = _claims(spark, d).groupBy(F.col("bia_agency_code").alias("code")).agg(F.count("*").alias("n")).join(labels, "code", "left")
    return rows.select("code", R.code_label(F.col("code"), F.col("label")).alias("agency"), "n")


_PLACE = r"'(?:SEC\s+([0-9]+)\s+)?T\s+([0-9]+)\s*([NS])\s+R\s+([0-9]+)\s*([EW])'"


@query(rf"""SELECT CAST(id AS BIGINT) AS id, state || '17' || lpad(t, CAST(greatest(3, length(t)) AS INTEGER), '0') || '0' || td || lpad(r, CAST(greatest(3, length(r)) AS INTEGER), '0') || '0' || rd || '0SN' || CASE WHEN s = '' THEN '' ELSE lpad(s, CAST(greatest(2, length(s)) AS INTEGER), '0') END || '0' AS key
FROM (SELECT id, state, ltrim(regexp_extract(remarks, {_PLACE}, 1), '0') AS s, ltrim(regexp_extract(remarks, {_PLACE}, 2), '0') AS t, regexp_extract(remarks, {_PLACE}, 3) AS td, ltrim(regexp_extract(remarks, {_PLACE}, 4), '0') AS r, regexp_extract(remarks, {_PLACE}, 5) AS rd FROM rails_patents WHERE regexp_matches(remarks, {_PLACE}))""")
def section_keys(spark: SparkSession, d: str) -> DataFrame:
    pattern = _PLACE.strip("'")
    part = lambda i: F.regexp_extract("remarks", pattern, i)
    key = R.section_key(F.col("state"), F.lit("17.0"), part(2), part(3), part(4), part(5), part(1))
    return _rails(spark, d).where(F.col("remarks").rlike(pattern)).select(_id(), key.alias("key"))


_ALIQUOT = "(SELECT id, nullif(trim(unnest([document_number, regexp_extract(remarks, '^\\s*([NSEW]) 1/2', 1) || '½', regexp_extract(remarks, '^\\s*([NSEW]) 1/2 ([NSEW]{2}) ', 1) || '½' || regexp_extract(remarks, '^\\s*([NSEW]) 1/2 ([NSEW]{2}) ', 2)]), ' '), '') AS a FROM rails_patents)"


@query(f"""SELECT kind, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'empty' WHEN l <> '' THEN CASE WHEN CAST(l AS HUGEINT) <= 16 THEN 'lot' ELSE 'large_lot' END WHEN regexp_full_match(a, '[NSEW]{{4}}') OR length(h) = 4 THEN 'qqsec' WHEN regexp_full_match(a, '[NSEW]{{2}}') OR length(h) = 2 THEN 'qsec' WHEN regexp_full_match(a, '[NSEW]½') THEN 'half_section' ELSE 'partial' END AS kind,
CASE WHEN regexp_full_match(a, '[0-9]+') THEN a WHEN l <> '' THEN CAST(CAST(l AS HUGEINT) AS VARCHAR) WHEN h <> '' THEN h ELSE a END AS value FROM (SELECT a, regexp_extract(a, '^([0-9]+)(?:[NSEW]{{1,2}})?$', 1) AS l, regexp_extract(a, '^[NSEW]½((?:[NSEW]{{2}}){{1,2}})$', 1) AS h FROM {_ALIQUOT})) GROUP BY 1, 2""")
def aliquot_classes(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p, i: F.regexp_extract("remarks", p, i)
    two = r"^\s*([NSEW]) 1/2 ([NSEW]{2}) "
    a = F.explode(F.array("document_number", F.concat(part(r"^\s*([NSEW]) 1/2", 1), F.lit("½")), F.concat(part(two, 1), F.lit("½"), part(two, 2)))).alias("a")
    return _rails(spark, d).select(a).select(R.aliquot(F.col("a")).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


# The bridge of claims and patents: rows of one allotment number and state, under the claim's case number and allottee.
_BRIDGE = "(SELECT DISTINCT ltrim(c.case_number, '0') AS bc, c.allottee_name AS bn, p.accession_number, p.signature_date, p.glo_tribe_name FROM federal_register_claims c JOIN rails_patents p ON nullif(ltrim(trim(c.allotment_number, ' '), '0'), '') = nullif(ltrim(trim(p.indian_allotment_number, ' '), '0'), '') AND c.state = p.state)"


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.nullif(strip_zeros(F.trim(c)), F.lit(""))
    c = _claims(spark, d).select(number("allotment_number").alias("k"), "state", strip_zeros(F.col("case_number")).alias("bridge_case"), F.col("allottee_name").alias("bridge_name"))
    p = _rails(spark, d).select(number("indian_allotment_number").alias("k"), "state", "accession_number", "signature_date", "glo_tribe_name")
    return c.join(p, ["k", "state"]).drop("k", "state").distinct()


_JOINED = f"federal_register_claims c {{how}} JOIN {_BRIDGE} b ON ltrim(c.case_number, '0') = b.bc AND c.allottee_name = b.bn"


@query(f"""SELECT CAST(c.id AS BIGINT) AS id, min(b.signature_date) AS first_date, CAST(count(b.bc) AS BIGINT) AS patents, coalesce(bool_or(m.k IS NOT NULL), FALSE) AS on_map FROM {_JOINED.format(how='LEFT')} LEFT JOIN (SELECT DISTINCT accession_number AS k FROM rails_patents_cloud) m ON b.accession_number = m.k GROUP BY 1""")
def claims_bridge(spark: SparkSession, d: str) -> DataFrame:
    on_map = _cloud(spark, d).select("accession_number").distinct().withColumn("m", F.lit(True))
    rows = bridge_join(_claims(spark, d), _bridge(spark, d).withColumn("b", F.lit(True))).join(on_map, "accession_number", "left")
    return rows.groupBy(_id()).agg(F.min("signature_date").alias("first_date"), F.count("b").alias("patents"), F.coalesce(F.bool_or(F.col("m").isNotNull()), F.lit(False)).alias("on_map"))


@query(f"SELECT CAST(year(b.signature_date) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c.id) AS BIGINT) AS claims FROM {_JOINED.format(how='')} WHERE b.signature_date IS NOT NULL GROUP BY 1")
def claims_bridge_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge_join(_claims(spark, d), _bridge(spark, d), "inner").where("signature_date IS NOT NULL")
    return rows.groupBy(F.year("signature_date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("claims"))


_OVERRIDES = {"Peezewink": "PEEZEWINK", "Mission Indians (CA)": None, "Brunitrark": None}
_LABELS = f"""SELECT fr, min_by(g, (-n, g)) AS mapped FROM (SELECT c.tribe_identified AS fr, upper(trim(m.glo_tribe_name, ' ')) AS g, count(DISTINCT c.id) AS n FROM {_JOINED.format(how='')} JOIN rails_patents_cloud m ON b.accession_number = m.accession_number WHERE trim(m.glo_tribe_name, ' ') <> '' AND c.tribe_identified IS NOT NULL GROUP BY 1, 2) WHERE fr NOT IN ('Peezewink', 'Mission Indians (CA)', 'Brunitrark') GROUP BY 1
UNION ALL SELECT unnest(['Peezewink', 'Mission Indians (CA)', 'Brunitrark']), unnest(['PEEZEWINK', NULL, NULL])"""


def _label_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per claim, label and target: claims by way of the bridge with the patents of the second catalogue."""
    on_map = _cloud(spark, d).where("trim(glo_tribe_name) != ''").select("accession_number", F.upper(F.trim("glo_tribe_name")).alias("target"))
    return bridge_join(_claims(spark, d), _bridge(spark, d).drop("glo_tribe_name"), "inner").join(on_map, "accession_number").select("id", "tribe_identified", "target").distinct()


@query(f"SELECT fr AS label, mapped FROM ({_LABELS})")
def claim_label_map(spark: SparkSession, d: str) -> DataFrame:
    return label_map(_label_links(spark, d), "tribe_identified", "target", _OVERRIDES)


@query(f"""WITH m AS ({_LABELS}), f AS (SELECT tribe_identified AS fr, count(*) AS claims, count(*) FILTER (WHERE claim_type ILIKE '%FORCED FEE%') AS forced FROM federal_register_claims WHERE tribe_identified IS NOT NULL GROUP BY 1),
s AS (SELECT CASE WHEN m.fr IS NOT NULL THEN m.mapped ELSE f.fr END AS tribe, string_agg(f.fr, '; ' ORDER BY f.fr) AS labels, sum(claims) AS claims, sum(forced) AS forced FROM f LEFT JOIN m ON f.fr = m.fr GROUP BY 1),
p AS (SELECT upper(trim(glo_tribe_name, ' ')) AS tribe, count(*) AS patents, count(*) FILTER (WHERE authority IN ({_TRUST})) AS trust, count(*) FILTER (WHERE authority IN ({_FEE})) AS fee FROM rails_patents WHERE trim(glo_tribe_name, ' ') <> '' GROUP BY 1)
SELECT p.tribe, CAST(patents AS BIGINT) AS patents, CAST(trust AS BIGINT) AS trust, CAST(fee AS BIGINT) AS fee, coalesce(labels, '') AS labels, CAST(coalesce(claims, 0) AS BIGINT) AS claims, CAST(coalesce(forced, 0) AS BIGINT) AS forced, least(round(coalesce(forced, 0) * 100.0 / fee, 1), 100.0) AS rate FROM p LEFT JOIN s ON p.tribe = s.tribe WHERE fee >= 20""")
def claims_rate_by_tribe(spark: SparkSession, d: str) -> DataFrame:
    counts = _claims(spark, d).where("tribe_identified IS NOT NULL").groupBy(F.col("tribe_identified").alias("label")).agg(F.count("*").alias("claims"), F.count_if(F.col("claim_type").ilike("%FORCED FEE%")).alias("forced"))
    a = F.col("authority")
    patents = _rails(spark, d).where("trim(glo_tribe_name) != ''").groupBy(F.upper(F.trim("glo_tribe_name")).alias("tribe")).agg(F.count("*").alias("patents"), F.count_if(a.isin(TRUST_AUTHORITIES)).alias("trust"), F.count_if(a.isin(FEE_AUTHORITIES)).alias("fee"))
    return mapped_rates(counts, patents, label_map(_label_links(spark, d), "tribe_identified", "target", _OVERRIDES))


_FORCED = f"(SELECT DISTINCT b.accession_number AS k FROM {_JOINED.format(how='')} WHERE c.claim_type ILIKE '%FORCED FEE%')"
_MAP_CLASS = "CASE WHEN contains(authority, 'Fee') THEN 'fee' WHEN contains(authority, 'Trust') OR contains(authority, 'Reissue') OR contains(authority, 'Allotment') OR contains(authority, 'Partition') THEN 'trust' ELSE 'other' END"


def _with_forced(spark: SparkSession, d: str) -> DataFrame:
    """Patents with whether a claim of forced fee reaches them by the bridge."""
    forced = bridge_join(_claims(spark, d).where(F.col("claim_type").ilike("%FORCED FEE%")), _bridge(spark, d).drop("glo_tribe_name", "signature_date"), "inner").select("accession_number").distinct().withColumn("_f", F.lit(True))
    return _rails(spark, d).join(forced, "accession_number", "left").withColumn("forced", F.coalesce("_f", F.lit(False))).drop("_f")


@query(f"""SELECT glo_tribe_name AS tribe, issued, CASE WHEN forced THEN 'fee' ELSE issued END AS class, forced, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN class_w THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS weight FROM (SELECT p.glo_tribe_name, {_MAP_CLASS} AS issued, f.k IS NOT NULL AS forced, f.k IS NOT NULL AS class_w FROM rails_patents p LEFT JOIN {_FORCED} f ON p.accession_number = f.k) GROUP BY ALL""")
def map_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_forced(spark, d)
    return rows.groupBy(F.col("glo_tribe_name").alias("tribe"), R.map_class(F.col("authority")).alias("issued"), R.map_class(F.col("authority"), F.col("forced")).alias("class"), "forced").agg(F.count("*").alias("n"), F.sum(F.when(F.col("forced"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("weight"))


_PEAKS = f"(SELECT glo_tribe_name AS tribe, y, count(*) FILTER (WHERE c = 'trust') AS t, count(*) FILTER (WHERE c = 'fee') AS f FROM (SELECT glo_tribe_name, year(signature_date) AS y, {_MAP_CLASS} AS c FROM rails_patents WHERE glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL) GROUP BY 1, 2)"


@query(f"""SELECT tribe, CAST(min_by(y, (-t, y)) FILTER (WHERE t > 0) AS BIGINT) AS trust_peak, CAST(min_by(y, (-f, y)) FILTER (WHERE f > 0) AS BIGINT) AS fee_peak, CAST(min_by(y, (-f, y)) FILTER (WHERE f > 0) - min_by(y, (-t, y)) FILTER (WHERE t > 0) AS BIGINT) AS lag FROM {_PEAKS} GROUP BY 1""")
def peak_lag(spark: SparkSession, d: str) -> DataFrame:
    kind = R.map_class(F.col("authority"))
    counts = _rails(spark, d).where("glo_tribe_name IS NOT NULL AND signature_date IS NOT NULL").groupBy(F.col("glo_tribe_name").alias("tribe"), F.year("signature_date").cast("long").alias("y")).agg(F.count_if(kind == "trust").alias("t"), F.count_if(kind == "fee").alias("f"))
    peak = lambda c: F.min_by(F.when(F.col(c) > 0, F.col("y")), F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("a"), F.col("y").alias("b"))))
    return counts.groupBy("tribe").agg(peak("t").alias("trust_peak"), peak("f").alias("fee_peak")).withColumn("lag", F.col("fee_peak") - F.col("trust_peak"))


@query(f"""SELECT land_office, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT full_name) FILTER (WHERE f.k IS NOT NULL) AS BIGINT) AS allottees, CAST(count(*) FILTER (WHERE f.k IS NOT NULL) AS BIGINT) AS forced FROM rails_patents p LEFT JOIN {_FORCED} f ON p.accession_number = f.k GROUP BY 1""")
def forced_by_office(spark: SparkSession, d: str) -> DataFrame:
    return _with_forced(spark, d).groupBy("land_office").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("forced"), F.col("full_name"))).alias("allottees"), F.count_if("forced").alias("forced"))


@query("""WITH y AS (SELECT year(signature_date) AS y, sum(total_acres) AS a, count(*) AS n FROM rails_patents WHERE signature_date >= DATE '1900-01-01' AND signature_date < DATE '1936-01-01' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS tracts, CAST(sum(a) AS DOUBLE) AS acres, CAST(min_by(y, (-a, y)) AS BIGINT) AS peak_year, CAST(max(a) AS DOUBLE) AS peak_acres FROM y""")
def annual_totals(spark: SparkSession, d: str) -> DataFrame:
    years = _rails(spark, d).where("signature_date >= DATE'1900-01-01' AND signature_date < DATE'1936-01-01'").groupBy(F.year("signature_date").cast("long").alias("y")).agg(F.sum("total_acres").alias("a"), F.count("*").alias("n"))
    peak = F.min_by("y", F.when(F.col("a").isNotNull(), F.struct((-F.col("a")).alias("a"), F.col("y").alias("b"))))
    return years.agg(F.sum("n").alias("tracts"), F.sum("a").cast("double").alias("acres"), peak.alias("peak_year"), F.max("a").cast("double").alias("peak_acres"))


_SEEN = f"(SELECT p.id, l.fee_accession AS num, l.fee_accession IS NOT NULL AS fee, string_split(r.refs, ' ')[1] AS ref FROM rails_patents p LEFT JOIN (SELECT trust_accession, min(fee_accession) AS fee_accession FROM trust_fee_linkages_recovered GROUP BY 1) l ON p.accession_number = l.trust_accession LEFT JOIN {_REFS} r ON p.id = r.id)"
_BARE = "coalesce(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '')"


@query(f"""SELECT class, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN fee AND coalesce(ref, '') <> '' THEN CASE WHEN n = '' AND r <> '' THEN 'rescue' WHEN n <> '' AND r <> '' AND (contains(r, n) OR contains(n, r)) THEN 'both_yes_match' ELSE 'both_yes_mismatch' END
WHEN fee THEN 'model_yes_remarks_no' WHEN coalesce(ref, '') <> '' THEN 'model_no_remarks_yes' ELSE 'both_no' END AS class FROM (SELECT fee, ref, {_BARE.format(c='num')} AS n, {_BARE.format(c='ref')} AS r FROM {_SEEN})) GROUP BY 1""")
def evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    found = _links(spark, d).groupBy(F.col("trust_accession").alias("accession_number")).agg(F.min("fee_accession").alias("number"))
    rows = _rails(spark, d).join(found, "accession_number", "left").select(F.col("number").isNotNull().alias("fee"), "number", F.get(fee_references(F.col("remarks")), F.lit(0)).alias("ref"))
    return rows.groupBy(R.evidence_class(F.col("fee"), F.col("number"), F.col("ref")).alias("class")).agg(F.count("*").alias("n"))


_VOLUMES = "(SELECT regexp_extract(accession_number, '^([A-Z]{2})', 1) AS state, regexp_extract(accession_number, '^[A-Z]{2}([0-9]+)__', 1) AS volume, count(*) AS entries, max(CAST(regexp_extract(accession_number, '\\.([0-9]+)$', 1) AS BIGINT)) AS highest FROM rails_patents WHERE document_class = 'State Land Patent' AND regexp_full_match(accession_number, '[A-Z]{2}[0-9]+__\\.[0-9]+') GROUP BY 1, 2)"


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    return gap_audit(sequence_gaps(_rails(spark, d).where("document_class = 'State Land Patent'"), "accession_number"))


@query(f"SELECT state, volume, CAST(entries AS BIGINT) AS entries, highest, CAST(highest - entries AS BIGINT) AS gap, round(entries * 100.0 / highest, 1) AS complete_pct, highest - entries >= 50 AS gappy FROM {_VOLUMES} WHERE highest >= 100")
def volume_gap_audit(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d)


@query(f"SELECT state, CAST(count(*) AS BIGINT) AS volumes, CAST(count(*) FILTER (WHERE highest - entries >= 50) AS BIGINT) AS gappy, CAST(coalesce(sum(highest - entries) FILTER (WHERE highest - entries >= 50), 0) AS BIGINT) AS missing FROM {_VOLUMES} WHERE highest >= 100 GROUP BY 1")
def volume_gap_rollup(spark: SparkSession, d: str) -> DataFrame:
    return gap_rollup(_volumes(spark, d)).withColumn("missing", F.col("missing").cast("long"))


@query("""SELECT CAST(c.id AS BIGINT) AS id, CAST(r.id AS BIGINT) AS file_id, c.typed FROM (SELECT id, unnest([matched_text, CAST(file_ref_id AS VARCHAR), regexp_extract(matched_text, '([0-9]+-[0-9]+)$', 1)]) AS typed FROM patent_file_ref_links) c
LEFT JOIN patent_file_references r ON (regexp_full_match(trim(c.typed, ' '), '[0-9]+-[0-9]+') AND r.letter_number = string_split(trim(c.typed, ' '), '-')[1] AND r.year_raw = string_split(trim(c.typed, ' '), '-')[2]) OR (regexp_full_match(trim(c.typed, ' '), '[0-9]+') AND r.id = CAST(trim(c.typed, ' ') AS BIGINT))
WHERE c.typed IS NOT NULL""")
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    typed = F.explode(F.array("matched_text", F.col("file_ref_id").cast("string"), F.regexp_extract("matched_text", "([0-9]+-[0-9]+)$", 1))).alias("typed")
    asked = _file_links(spark, d).select(_id(), typed).where("typed IS NOT NULL").withColumn("k", R.reference_key(F.col("typed")))
    files = _files(spark, d).select(F.col("id").cast("long").alias("file_id"), "letter_number", "year_raw")
    by_id = asked.where("k.letter IS NULL").join(files.select("file_id"), F.col("k.id") == F.col("file_id"), "left").select("id", "file_id", "typed")
    by_letter = asked.where("k.letter IS NOT NULL").join(files, (F.col("k.letter") == F.col("letter_number")) & (F.col("k.year") == F.col("year_raw")), "left").select("id", "file_id", "typed")
    return by_id.unionByName(by_letter)


@query("""WITH b AS (SELECT CAST(id AS BIGINT) AS id, accession_number FROM rails_patents_cloud QUALIFY row_number() OVER (PARTITION BY id ORDER BY synced_at, accession_number) = 1)
SELECT a.asked, a.source AS wanted, CASE WHEN a.source = 'rails' AND r.id IS NOT NULL AND b.id IS NULL THEN 'catalogue' WHEN a.source <> 'rails' AND b.id IS NOT NULL THEN 'mapped' WHEN a.source <> 'rails' AND r.id IS NOT NULL THEN 'catalogue' ELSE 'missing' END AS found, CASE WHEN a.source <> 'rails' AND b.id IS NOT NULL THEN b.accession_number WHEN r.id IS NOT NULL AND (a.source <> 'rails' OR b.id IS NULL) THEN r.accession_number END AS accession_number
FROM (SELECT CAST(id AS BIGINT) AS asked, unnest(['', 'rails']) AS source FROM rails_patents UNION SELECT CAST(id AS BIGINT) + 3, unnest(['', 'rails']) FROM rails_patents_cloud) a LEFT JOIN b ON a.asked = b.id LEFT JOIN rails_patents r ON a.asked = r.id""")
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every id asked for without a source (mapped, then catalogue, then missing) and as a catalogue id (only where it isn't mapped)."""
    both = F.explode(F.array(F.lit(""), F.lit("rails"))).alias("wanted")
    asked = _rails(spark, d).select(F.col("id").cast("long").alias("asked"), both).union(_cloud(spark, d).select((F.col("id").cast("long") + 3).alias("asked"), both)).distinct()
    mapped = first_per_key(_cloud(spark, d), ["id"], F.col("synced_at"), F.col("accession_number")).select(F.col("id").cast("long").alias("asked"), F.col("accession_number").alias("m"), F.lit(True).alias("is_m"))
    own = _rails(spark, d).select(F.col("id").cast("long").alias("asked"), F.col("accession_number").alias("r"), F.lit(True).alias("is_r"))
    rows = asked.join(mapped, "asked", "left").join(own, "asked", "left")
    rails, is_m, is_r = F.col("wanted") == "rails", F.coalesce("is_m", F.lit(False)), F.coalesce("is_r", F.lit(False))
    found = F.when(rails, F.when(is_r & ~is_m, "catalogue").otherwise("missing")).when(is_m, "mapped").when(is_r, "catalogue").otherwise("missing")
    return rows.withColumn("found", found).select("asked", "wanted", "found", F.when(F.col("found") == "mapped", F.col("m")).when(F.col("found") == "catalogue", F.col("r")).alias("accession_number"))


@query("""SELECT CAST(id AS BIGINT) AS id, accession_number, signature_date AS signed, CASE WHEN total_acres IS NOT NULL THEN CAST(total_acres AS DOUBLE) END AS lon, CASE WHEN total_acres IS NOT NULL THEN CAST(id AS DOUBLE) END AS lat, CASE WHEN total_acres IS NULL THEN 'none' WHEN id % 2 = 0 THEN 'Point' ELSE 'Polygon' END AS kind FROM rails_patents""")
def features_to_rows(spark: SparkSession, d: str) -> DataFrame:
    """Patents written as feature JSON (points and rings around made-up places) and read back."""
    x, y = F.col("total_acres").cast("double"), F.when(F.col("total_acres").isNotNull(), F.col("id").cast("double"))
    even = F.col("id") % 2 == 0
    ring = F.array(F.array(*[F.array(x + a, y + b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))
    geometry = F.struct(F.when(even, x).alias("x"), F.when(even, y).alias("y"), F.when(~even & x.isNotNull(), ring).alias("rings"))
    signed = F.unix_millis(F.col("signature_date").cast("timestamp"))
    text = F.to_json(F.struct(F.struct("id", "accession_number", signed.alias("signed")).alias("attributes"), F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).alias("centroid"), F.when(x.isNotNull(), geometry).alias("geometry")))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("accession_number", T.StringType()), T.StructField("signed", T.LongType())])
    rows = feature_rows(_rails(spark, d).select(text.alias("t")), "t", schema, ("signed",))
    return rows.select("id", "accession_number", "signed", "lon", "lat", F.coalesce(F.get_json_object("geometry", "$.type"), F.lit("none")).alias("kind"))


@query("""SELECT CAST(id AS BIGINT) AS source_row, nullif(trim(full_name, ' '), '') AS name, nullif(trim(indian_allotment_number, ' '), '') AS allotment, nullif(trim(glo_tribe_name, ' '), '') AS tribe FROM rails_patents WHERE nullif(trim(full_name, ' '), '') IS NOT NULL OR nullif(trim(indian_allotment_number, ' '), '') IS NOT NULL OR nullif(trim(glo_tribe_name, ' '), '') IS NOT NULL""")
def spreadsheet_import(spark: SparkSession, d: str) -> DataFrame:
    sheet = _rails(spark, d).select(F.col("id").cast("long").alias("source_row"), F.col("full_name").alias("_c0"), F.col("indian_allotment_number").alias("_c1"), F.col("glo_tribe_name").alias("_c2"))
    return spreadsheet_rows(sheet, ["name", "allotment", "tribe"])


@query("SELECT CAST(id AS BIGINT) AS id, accession_number FROM rails_patents WHERE accession_number IN (SELECT patent_accession FROM patent_file_ref_links)")
def bulk_wanted(spark: SparkSession, d: str) -> DataFrame:
    return wanted_rows(_rails(spark, d), "accession_number", _file_links(spark, d).select("patent_accession")).select(_id(), "accession_number")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events GROUP BY 1""")
def model_output_index(spark: SparkSession, d: str) -> DataFrame:
    """Outputs in files of one record (even ids) or a list; a user's last stays."""
    one = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "event_id"))
    text = F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(F.lit("[ "), one, F.lit("]")))
    out = model_outputs(table(spark, d, "events").select(text.alias("t"), F.struct("ts", "event_id").alias("at")), "t", "user_id", "at")
    return out.select("user_id", F.get_json_object("output", "$.event_id").cast("long").alias("event_id"))


@query("""SELECT CAST(r.id AS BIGINT) AS id, CAST(coalesce(a.n, 0) AS BIGINT) AS patent_count, a.labels FROM patent_file_references r LEFT JOIN (SELECT file_ref_id, count(DISTINCT patent_accession) AS n, string_agg(DISTINCT context_label, '; ' ORDER BY context_label) AS labels FROM patent_file_ref_links GROUP BY 1) a ON r.id = a.file_ref_id""")
def aggregates_updated(spark: SparkSession, d: str) -> DataFrame:
    """A table's columns replaced by aggregates of another."""
    sums = _file_links(spark, d).groupBy(F.col("file_ref_id").alias("id")).agg(F.countDistinct("patent_accession").alias("patent_count"), F.array_join(F.array_sort(F.collect_set("context_label")), "; ").alias("labels"))
    return _files(spark, d).select("id").join(sums, "id", "left").select(_id(), F.coalesce("patent_count", F.lit(0)).alias("patent_count"), F.nullif("labels", F.lit("")).alias("labels"))


@query(f"""SELECT CAST(id AS BIGINT) AS id, coalesce(full_name, '') AS name, coalesce(strftime(signature_date, '%Y-%m-%d'), '') AS signed FROM rails_patents WHERE length(full_name) > 2 AND upper({_T('full_name')}) NOT IN ('TRIBAL', 'NA', 'N/A') AND coalesce(authority, full_name, land_office, geographic_name) IS NOT NULL AND signature_date >= DATE '1900-01-01' AND signature_date < DATE '1921-01-01'""")
def presentable_names(spark: SparkSession, d: str) -> DataFrame:
    """Names fit to show, of records that aren't empty shells, from a half-open span of years, as text."""
    name = F.col("full_name")
    fit = (F.length(name) > 2) & ~F.upper(F.trim(name)).isin("TRIBAL", "NA", "N/A") & F.coalesce("authority", "full_name", "land_office", "geographic_name").isNotNull()
    rows = _rails(spark, d).where(fit & (F.col("signature_date") >= "1900-01-01") & (F.col("signature_date") < "1921-01-01"))
    return rows.select(_id(), R.rendered(name).alias("name"), R.rendered(F.col("signature_date"), True).alias("signed"))


@query(f"""SELECT CAST(p.id AS BIGINT) AS id FROM rails_patents p WHERE p.authority IN ({_TRUST}) OR (p.document_class = 'Serial Land Patent' AND NOT EXISTS (SELECT 1 FROM rails_patents_cloud c WHERE c.accession_number = p.accession_number) AND NOT EXISTS (SELECT 1 FROM trust_fee_linkages_recovered l WHERE l.fee_accession = p.accession_number))""")
def trust_scan(spark: SparkSession, d: str) -> DataFrame:
    """Patents of trust, by authority, or unmapped ones that are no fee patent of a link."""
    on_map = _cloud(spark, d).select("accession_number").where("accession_number IS NOT NULL").distinct().withColumn("_m", F.lit(True))
    fee = _links(spark, d).select(F.col("fee_accession").alias("accession_number")).where("accession_number IS NOT NULL").distinct().withColumn("_f", F.lit(True))
    rows = _rails(spark, d).join(on_map, "accession_number", "left").join(fee, "accession_number", "left")
    trust = F.coalesce(F.col("authority").isin(TRUST_AUTHORITIES), F.lit(False))
    return rows.where(trust | ((F.col("document_class") == "Serial Land Patent") & F.col("_m").isNull() & F.col("_f").isNull())).select(_id())


@query("""SELECT CAST(id AS BIGINT) AS id, coalesce(e.tribe_name, a.tribe_name, i.tribe_name) AS resolved, CASE WHEN e.tribe_name IS NOT NULL THEN 'exact' WHEN a.tribe_name IS NOT NULL THEN 'alias' WHEN i.tribe_name IS NOT NULL THEN 'any_case' ELSE 'none' END AS how FROM circular_2464_records c LEFT JOIN tribe_reference e ON c.tribe_reservation = e.tribe_name
LEFT JOIN (SELECT also_known_as, min(tribe_name) AS tribe_name FROM tribe_reference WHERE also_known_as IS NOT NULL GROUP BY 1) a ON c.tribe_reservation = a.also_known_as LEFT JOIN (SELECT lower(tribe_name) AS low, min(tribe_name) AS tribe_name FROM tribe_reference GROUP BY 1) i ON lower(trim(c.tribe_reservation, ' ')) = i.low""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    ref, typed = _reference(spark, d), F.col("tribe_reservation")
    exact = ref.select(F.col("tribe_name").alias("k1"), F.col("tribe_name").alias("exact"))
    alias = ref.where("also_known_as IS NOT NULL").groupBy(F.col("also_known_as").alias("k2")).agg(F.min("tribe_name").alias("alias"))
    any_case = ref.groupBy(F.lower("tribe_name").alias("k3")).agg(F.min("tribe_name").alias("any_case"))
    rows = _circular(spark, d).join(exact, typed == F.col("k1"), "left").join(alias, typed == F.col("k2"), "left").join(any_case, F.lower(F.trim(typed)) == F.col("k3"), "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("any_case").isNotNull(), "any_case").otherwise("none")
    return rows.select(_id(), F.coalesce("exact", "alias", "any_case").alias("resolved"), how.alias("how"))


@query("""SELECT CAST(id AS BIGINT) AS id, CAST(CASE WHEN year(d) >= 2000 THEN d - INTERVAL 100 YEAR ELSE d END AS DATE) AS fixed FROM (SELECT id, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE) WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN CAST(try_strptime(t, '%m/%d/%Y') AS DATE) WHEN regexp_full_match(t, '[A-Z][a-z]+ \\d{1,2}, \\d{4}') THEN CAST(try_strptime(t, '%B %d, %Y') AS DATE) END AS d FROM (SELECT id, trim(unnest([trust_patent_date, fee_patent_date]), ' ') AS t FROM circular_2464_records UNION ALL SELECT id, trim(replace(publication_date, '19', '20'), ' ') FROM federal_register_claims)) WHERE d IS NOT NULL""")
def century_fix(spark: SparkSession, d: str) -> DataFrame:
    from ledgerlark.functions.dates import fix_century

    typed = _circular(spark, d).select(_id(), F.explode(F.array("trust_patent_date", "fee_patent_date")).alias("t")).unionByName(_claims(spark, d).select(_id(), F.replace("publication_date", F.lit("19"), F.lit("20")).alias("t")))
    return typed.select("id", fix_century(parse_date(F.col("t"))).alias("fixed")).where("fixed IS NOT NULL")


_WIDE = ", ".join(f"count(*) FILTER (WHERE year(signature_date) = {y}) AS \"{y}\"" for y in range(1900, 1910))


@query(f"""SELECT land_office, CAST(year AS BIGINT) AS year, CAST(v AS BIGINT) AS value FROM (UNPIVOT (SELECT land_office, {_WIDE} FROM rails_patents WHERE land_office IS NOT NULL GROUP BY 1) ON COLUMNS(* EXCLUDE land_office) INTO NAME year VALUE v) WHERE v > 0""")
def positional_series(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a printed table, a cell per year by position, as a long series without zeros; the total's row is left out."""
    year = F.year("signature_date")
    wide = _rails(spark, d).where("land_office IS NOT NULL").groupBy("land_office").agg(*[F.count_if(year == y).cast("string").alias(str(y)) for y in range(1900, 1910)])
    cells = wide.select(F.array("land_office", *[F.col(f"`{y}`") for y in range(1900, 1910)]).alias("cells")).unionByName(wide.agg(F.array(F.lit("Total"), *[F.lit("1")] * 10).alias("cells")))
    rows = cells.where(~F.lower(F.element_at("cells", 1)).isin("total", "grand total")).select(F.element_at("cells", 1).alias("land_office"), F.posexplode(F.slice("cells", 2, 10)).alias("p", "v"))
    return rows.select("land_office", (F.col("p") + 1900).cast("long").alias("year"), R.footnoted_count(F.col("v")).cast("long").alias("value")).where("value > 0")


@query(f"""SELECT CAST(p.id AS BIGINT) AS id, CAST(first(q.id ORDER BY coalesce(q.authority IN ({_FEE}), FALSE) DESC, q.id) AS BIGINT) AS shown FROM rails_patents p JOIN rails_patents q ON p.indian_allotment_number = q.indian_allotment_number AND p.state = q.state AND p.id <> q.id WHERE trim(p.indian_allotment_number, ' ') <> '' GROUP BY 1""")
def sibling_shown_first(spark: SparkSession, d: str) -> DataFrame:
    """For each patent the one of the same number and state that is shown first: fee patents, then the smallest id; ranked once per number, not per pair."""
    rows = _rails(spark, d).where("trim(indian_allotment_number) != '' AND state IS NOT NULL").select(_id(), "state", "indian_allotment_number", F.coalesce(F.col("authority").isin(FEE_AUTHORITIES), F.lit(False)).alias("fee"))
    order = F.struct((~F.col("fee")).alias("a"), F.col("id").alias("b"))
    two = rows.groupBy("state", "indian_allotment_number").agg(F.min(order).alias("first"))
    rest = rows.join(two, ["state", "indian_allotment_number"]).where(F.col("id") != F.col("first.b")).groupBy("state", "indian_allotment_number").agg(F.min(order).alias("second"))
    out = rows.join(two, ["state", "indian_allotment_number"]).join(rest, ["state", "indian_allotment_number"])
    return out.select("id", F.when(F.col("id") == F.col("first.b"), F.col("second.b")).otherwise(F.col("first.b")).alias("shown"))


@query("""SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / 4e6 * 3.0 + count(*) * 200 / 1e6 * 15.0, 6) AS cost FROM documents GROUP BY 1""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of reading documents at a price per million tokens, of four characters in, two hundred tokens out."""
    return table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars") / 4e6 * 3.0 + F.count("*") * 200 / 1e6 * 15.0, 6).alias("cost"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT state) AS BIGINT) AS states, CAST(sum(CASE WHEN cancelled_doc THEN 1 ELSE 0 END) AS BIGINT) AS cancelled, CAST(count(geographic_name) AS BIGINT) AS placed, min(signature_date) AS first_date, max(signature_date) AS last_date FROM rails_patents""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rails(spark, d).agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"), F.sum(F.when(F.col("cancelled_doc"), 1).otherwise(0)).alias("cancelled"), F.count("geographic_name").alias("placed"), F.min("signature_date").alias("first_date"), F.max("signature_date").alias("last_date"))


@query("""SELECT CAST(id AS BIGINT) AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', name, tribe_reservation, notes)), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS words FROM circular_2464_records""")
def testimony_words(spark: SparkSession, d: str) -> DataFrame:
    return _circular(spark, d).select(_id(), R.search_tokens(F.col("name"), F.col("tribe_reservation"), F.col("notes")).alias("words"))


@query("""SELECT CAST(id AS BIGINT) AS id, CAST(json_array_length(recovery_notes_json) AS INTEGER) AS notes, coalesce(list_has_any(list_transform(from_json(recovery_notes_json, '["JSON"]'), lambda x: json_extract_string(x, '$.type')), ['corrected']), FALSE) AS corrected FROM circular_2464_records WHERE recovery_notes_json LIKE '[%'""")
def note_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _circular(spark, d).where("recovery_notes_json LIKE '[%'")
    notes = F.from_json("recovery_notes_json", "array<struct<type: string>>")
    return rows.select(_id(), F.json_array_length("recovery_notes_json").alias("notes"), F.coalesce(F.exists(notes, lambda x: x["type"] == "corrected"), F.lit(False)).alias("corrected"))


@query(f"""WITH s AS (SELECT count(*) AS n FROM rails_patents), r AS (SELECT state, count(*) AS n FROM rails_patents WHERE document_class = 'State Land Patent' GROUP BY 1) SELECT state, CAST(r.n AS BIGINT) AS n, CAST(floor(6.0 * sqrt(r.n / CAST((SELECT max(n) FROM r) AS DOUBLE)) * 0.9999) AS BIGINT) AS bin FROM r""")
def colour_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = _rails(spark, d).where("document_class = 'State Land Patent'").groupBy("state").agg(F.count("*").alias("n"))
    most = rows.agg(F.max("n").alias("most"))
    return rows.join(F.broadcast(most)).select("state", "n", F.floor(6.0 * F.sqrt(F.col("n") / F.col("most").cast("double")) * 0.9999).cast("long").alias("bin"))  # a single row


@query(f"""SELECT land_office, family, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY land_office) AS BIGINT) AS office_total, CAST(dense_rank() OVER (PARTITION BY land_office ORDER BY n DESC, family) AS INTEGER) AS place FROM (SELECT land_office, {_MAP_CLASS} AS family, count(*) AS n FROM rails_patents WHERE land_office IS NOT NULL GROUP BY 1, 2)""")
def mechanism_families(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each family of authorities by office, with the office's total and the family's place in it."""
    counts = _rails(spark, d).where("land_office IS NOT NULL").groupBy("land_office", R.map_class(F.col("authority")).alias("family")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("land_office")
    return counts.select("land_office", "family", "n", F.sum("n").over(w).alias("office_total"), F.dense_rank().over(w.orderBy(F.desc("n"), "family")).alias("place"))
