"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.llm.components import components
from ledgerlark.llm.labels import map_tables
from ledgerlark.llm.leaks import find_leaks
from ledgerlark.llm.matching import match, records
from ledgerlark.llm.mojibake import find_garbled
from ledgerlark.llm.tokens import encode_corpus
from ledgerlark.llm.variants import person_variants, spelling_pairs, tribe_variants
from ledgerlark.llm.words import PATENT_NAMES, TRIBE_LABELS
from ledgerlark.runtime import finished, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "trust_fee_linkages_recovered"), "trust_accession", "fee_accession", "accession")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), restored=False).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rails = records("patent", table(spark, sf_dir, "rails_patents"), "id", "full_name", "glo_tribe_name", "state", "indian_allotment_number")
    people = person_variants(rails, PATENT_NAMES).select(F.lit("rails_patents.full_name").alias("src"), "id", "entity", "name")
    tribes = tribe_variants(table(spark, sf_dir, "tribe_crosswalk"), "id", "glo_name", TRIBE_LABELS).select(F.lit("tribe_crosswalk.glo_name").alias("src"), "id", "entity", "name")
    return people.unionByName(tribes)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = finished(lambda: p1_entities(spark, sf_dir))
    out = None
    for src in ("rails_patents.full_name", "tribe_crosswalk.glo_name"):
        one = spelling_pairs(both.where(F.col("src") == src)).select(F.lit(src).alias("src"), "id_a", "id_b")
        out = one if out is None else out.unionByName(one)
    return out


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = records("claim", table(spark, sf_dir, "federal_register_claims"), "id", "allottee_name", "tribe_identified", "state", "allotment_number")
    patents = records("patent", table(spark, sf_dir, "rails_patents"), "id", "full_name", "glo_tribe_name", "state", "indian_allotment_number")
    return finished(lambda: match(claims, patents, "claim", "patent", PATENT_NAMES)).withColumnsRenamed({"left_id": "claim_id", "right_id": "patent_id"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("claim_id", "patent_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    crosswalk, circular = table(spark, sf_dir, "tribe_crosswalk"), table(spark, sf_dir, "circular_2464_records")
    tables = [("tribe_crosswalk.glo_name", crosswalk, "id", "glo_name"), ("tribe_crosswalk.authoritative_tribe", crosswalk, "id", "authoritative_tribe"), ("circular_2464_records.tribe_reservation", circular, "id", "tribe_reservation")]
    return map_tables(tables, table(spark, sf_dir, "tribe_reference"), TRIBE_LABELS)


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p5_found": p5_found, "p2_found": p2_found, "p2_matches": p2_matches, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_restored": p10_restored}

_WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{Nd}}]+')"
_RUNS = "(SELECT {k} AS k, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run FROM (SELECT {k}, {w} AS w FROM {t} WHERE {c} IS NOT NULL) WHERE len(w) >= 13)"

ORACLES: dict[str, str] = {
    "p6_found": """WITH RECURSIVE e AS (SELECT trust_accession AS a, fee_accession AS b FROM trust_fee_linkages_recovered WHERE trust_accession IS NOT NULL AND fee_accession IS NOT NULL UNION SELECT fee_accession, trust_accession FROM trust_fee_linkages_recovered WHERE trust_accession IS NOT NULL AND fee_accession IS NOT NULL),
n AS (SELECT trust_accession AS a FROM trust_fee_linkages_recovered WHERE trust_accession IS NOT NULL UNION SELECT fee_accession FROM trust_fee_linkages_recovered WHERE fee_accession IS NOT NULL),
r(a, b) AS (SELECT a, a FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS accession, min(b) AS group_id FROM r GROUP BY 1""",
    "p9_found": "SELECT DISTINCT CAST(d.k AS BIGINT) AS doc_id, CAST(i.k AS BIGINT) AS item_id FROM "
    + _RUNS.format(k="doc_id", t="documents", c="text", w=_WORDS.format(c="text")) + " d JOIN " + _RUNS.format(k="item_id", t="eval_items", c="passage", w=_WORDS.format(c="passage")) + " i ON d.run = i.run",
}
