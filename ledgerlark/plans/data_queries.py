"""Queries of the general data operators (packed fields, copy differences, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators.copy_diff import diff_copies
from ledgerlark.operators.orphans import find_orphans, orphan_report
from ledgerlark.operators.packed_values import delimiter_scores, split_packed
from ledgerlark.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "rails_patents"), "remarks", ["id"], source="land_office").select(F.col("id").cast("long").alias("id"), "pos", "note")


def p3_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimiter_scores(table(spark, sf_dir, "rails_patents"), "remarks", source="land_office")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff_copies(table(spark, sf_dir, "rails_patents"), table(spark, sf_dir, "rails_patents_cloud"), "id", "missing_in_cloud", "missing_in_rails")
    return out.select(F.col("id").cast("long").alias("id"), "kind", "field")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, files, rails, cloud = (table(spark, sf_dir, t) for t in ("trust_fee_linkages_recovered", "patent_file_ref_links", "rails_patents", "rails_patents_cloud"))
    references = [("trust_fee_linkages_recovered", links, "id", "fee_accession", "created_at"), ("patent_file_ref_links", files, "id", "patent_accession", "created_at")]
    return find_orphans(references, rails, "accession_number", "created_at", cloud, "accession_number")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_delimiters": p3_delimiters, "p4_found": p4_found, "p7_found": p7_found, "p7_report": p7_report}

_RAILS_FIELDS = (
    "accession_number document_class document_code state glo_tribe_name indian_allotment_number signature_date total_acres land_office remarks "
    "cancelled_doc blm_serial_number document_number misc_document_number authority full_name survey_date geographic_name metes_bounds"
).split()

_P7 = """
WITH refs AS (
  SELECT 'trust_fee_linkages_recovered' AS src, CAST(id AS BIGINT) AS id, fee_accession AS k, created_at FROM trust_fee_linkages_recovered WHERE fee_accession IS NOT NULL
  UNION ALL
  SELECT 'patent_file_ref_links', CAST(id AS BIGINT), patent_accession, created_at FROM patent_file_ref_links WHERE patent_accession IS NOT NULL),
own AS (SELECT accession_number AS k, min(created_at) AS first FROM rails_patents WHERE accession_number IS NOT NULL GROUP BY 1),
other AS (SELECT DISTINCT accession_number AS k FROM rails_patents_cloud WHERE accession_number IS NOT NULL),
judged AS (
  SELECT r.src, r.id, CASE WHEN o.k IS NOT NULL AND o.first > r.created_at THEN 'late' WHEN o.k IS NOT NULL THEN NULL WHEN c.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind,
         strftime(r.created_at, '%Y-%m') AS ref_month
  FROM refs r LEFT JOIN own o ON r.k = o.k LEFT JOIN other c ON r.k = c.k)
"""

ORACLES = {
    "p4_found": "WITH c AS (SELECT DISTINCT * EXCLUDE (synced_at) FROM rails_patents_cloud)\n"
    "SELECT CAST(id AS BIGINT) AS id, 'missing_in_cloud' AS kind, '' AS field FROM rails_patents WHERE id NOT IN (SELECT id FROM c)\n"
    "UNION ALL SELECT CAST(id AS BIGINT), 'missing_in_rails', '' FROM (SELECT DISTINCT id FROM c) WHERE id NOT IN (SELECT id FROM rails_patents)\n"
    + "\n".join(f"UNION ALL SELECT DISTINCT CAST(r.id AS BIGINT), 'value', '{f}' FROM rails_patents r JOIN c ON r.id = c.id WHERE r.{f} IS DISTINCT FROM c.{f}" for f in _RAILS_FIELDS),
    "p7_found": _P7 + "SELECT src, id, kind, ref_month FROM judged WHERE kind IS NOT NULL",
    "p7_report": _P7 + "SELECT src, ref_month, kind, count(*) AS orphans FROM judged WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
}
