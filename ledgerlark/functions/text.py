"""Text functions as Column expressions: keys, names, references in free text, classifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words around a number in a reference that are not the number.
REFERENCE_WORDS = ["AND", "OR", "&", "NR", "NO", "NUMBER", "NOS", "SERIAL", "PATENT", "PATENTS", "MISCELLANEOUS", "VOLUME", "FEE", "TO", "FOR", "OF", "ALSO", "SEE"]
# Forms in which a remark refers to one or several fee patents.
REFERENCE_CLUSTERS = [
    r"SEE\s+SERIAL\s+PATENT\s+(?:NR\.?|NO\.?|NUMBER)?\s*([0-9][0-9A-Z\-\s]*?)\s+FOR\s+FEE\s+PATENT",
    r"SEE\s+MISCELLANEOUS\s+VOLUME\s+(?:NR\.?|NO\.?|NUMBER)?\s*([0-9][0-9A-Z\-\s]*?)\s+FOR\s+FEE\s+PATENT",
    r"SEE\s+ACCESSION\s+(?:NR\.?|NO\.?|NUMBER)?\s*([0-9][0-9A-Z\-\.\s]*?)\s+FOR\s+FEE\s+PATENT",
    r"SERIAL\s+PATENT\s+(?:NR\.?|NO\.?|NUMBER)?\s*([0-9][0-9A-Z\-\s]*?)\s+FOR\s+FEE\s+PATENT",
]
# Forms that count only where none of the above is found.
REFERENCE_FALLBACKS = [
    r"SEE\s+FEE\s+PATENT\s+(?:NR\.?|NO\.?|NUMBER)?\s*([A-Z0-9\-]+)",
    r"FEE\s+PATENT\s+(?:NR\.?|NO\.?|NUMBER)?\s*([A-Z0-9\-]+)\s+(?:ISSUED|GRANTED)",
    r"^FEE\s+PATENT\s+(?:NR\.?|NO\.?|NUMBER)?\s*([A-Z0-9\-]+)",
    r"\bPATENT\s*#\s*([A-Z0-9\-]+)",
]
# Fixed value: forms of a cancellation in a remark.
CANCELLED = r"CANCELL?ED\s+(?:DOCUMENT|PATENT)"
# Fixed value: a file reference, label, four to six digits and a year of two.
FILE_REFERENCE = r"(?i)((?:ADDI?TIONAL\s+)?(?:I\.?\s*O\.?|B\.?\s*I\.?\s*A\.?|DOCUMENT))\s*#?\s*([0-9]{4,6})-([0-9]{2})\b"
# Generation marks and titles that are no names.
NAME_STOPS = ["JR", "SR", "II", "III", "IV", "MRS", "MR", "MISS", "DR"]


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def strip_zeros(c: Column) -> Column:
    """Text without leading zeros."""
    return F.regexp_replace(c, "^0+", "")


def slugify(c: Column) -> Column:
    """Lower-case words joined by '-', without quotes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "['\"]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bare_key(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def key_variants(c: Column) -> Column:
    """Ways to write an accession, the likelier first: as is, bare, without zeros, padded, dashed before the last three or four digits."""
    bare = bare_key(c)
    digits = bare.rlike("^[0-9]+$")
    padded = [F.when(digits, F.lpad(bare, F.greatest(F.lit(n), F.length(bare)), F.lit("0"))) for n in (5, 6, 7, 8)]
    dashed = [F.when(digits & (F.length(bare) >= 5), F.concat(F.substring(bare, F.lit(1), F.length(bare) - n), F.lit("-"), F.right(bare, F.lit(n)))) for n in (3, 4)]
    return F.array_distinct(F.filter(F.array(c, bare, F.when(digits, strip_zeros(bare)), *padded, *dashed), lambda v: v.isNotNull() & (v != "")))


def name_tokens(c: Column, stops: bool = True) -> Column:
    """Distinct tokens of a name with two letters at least: split at blanks, ; , . / - and without titles; or, plain, at anything but letters and digits."""
    parts = F.split(F.upper(c), r"[\s;,./-]+" if stops else "[^A-Z0-9]+")
    parts = F.filter(parts, lambda t: F.length(t) >= 2)
    return F.array_distinct(F.array_except(parts, F.array(*map(F.lit, NAME_STOPS))) if stops else parts)


def fee_references(remarks: Column) -> Column:
    """References to fee patents in a remark, in order of the forms, each once."""
    s = F.trim(F.regexp_replace(F.upper(remarks), r"\s+", " "))
    found = lambda p: F.coalesce(F.regexp_extract_all(s, F.lit(p), F.lit(1)), F.array().cast("array<string>"))
    clusters = F.flatten(F.array(*[F.flatten(F.transform(found(p), lambda t: F.split(t, " "))) for p in REFERENCE_CLUSTERS]))
    clusters = F.filter(F.transform(clusters, lambda t: F.regexp_replace(t, r"^[,.;:]+|[,.;:]+$", "")), lambda t: t.rlike("[0-9]"))
    clusters = F.array_distinct(F.array_except(clusters, F.array(*map(F.lit, REFERENCE_WORDS))))
    others = F.array_distinct(F.filter(F.flatten(F.array(*map(found, REFERENCE_FALLBACKS))), lambda t: t.rlike("[0-9]")))
    return F.when(F.size(clusters) > 0, clusters).otherwise(others)


def is_cancelled(remarks: Column) -> Column:
    """Whether a remark says that the document is cancelled."""
    return F.coalesce(F.upper(remarks).rlike(CANCELLED), F.lit(False))


def file_references(remarks: Column) -> Column:
    """Array of (matched, label, letter, year) of the file references in a text."""

    def one(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, FILE_REFERENCE, i)
        return F.struct(m.alias("matched"), file_label(part(1)).alias("label"), part(2).alias("letter"), (F.lit(1900) + part(3).cast("int")).alias("year"))

    return F.transform(F.regexp_extract_all(remarks, F.lit(FILE_REFERENCE), F.lit(0)), one)


def file_label(raw: Column) -> Column:
    """A label's family, with ADDITIONAL where it says so (also misspelt)."""
    s = F.regexp_replace(F.regexp_replace(F.upper(raw), r"[.\s]+", ""), "^ADDTIONAL", "ADDITIONAL")
    family = F.when(s.contains("DOCUMENT"), "DOCUMENT").when(s.contains("BIA"), "BIA").otherwise("IO")
    return F.when(s.startswith("ADDITIONAL"), F.concat(F.lit("ADDITIONAL "), family)).otherwise(family)


def flip_names(c: Column) -> Column:
    """'LAST, FIRST' turned to 'FIRST LAST' in every part between semicolons."""
    turn = lambda p: F.trim(F.when(p.contains(","), F.concat(F.trim(F.regexp_extract(p, r"^[^,]*,(.*)$", 1)), F.lit(" "), F.trim(F.regexp_extract(p, r"^([^,]*),", 1)))).otherwise(p))
    return F.array_join(F.transform(F.split(c, r";\s*"), turn), "; ")


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether any of the texts occurs in ``c``, in any case."""
    return reduce(lambda a, b: a | b, [c.ilike(f"%{p}%") for p in patterns])


# Groups of claim types, by texts one of which must occur, and texts that must not.
CLAIM_GROUPS = {
    "ALL FORCED FEE": (["FORCED FEE"], []), "TRESPASS": (["TRESPASS", "IN TRESPASS", "ENCROACHMENT"], []), "UNAPPROVED": (["UNAPPROVED", "WITHOUT APPROVAL"], []),
    "WELFARE": (["WELFARE"], ["FORCED FEE"]), "TIMBER": (["TIMBER"], []), "RECOVERY": (["RECOVERY"], []), "ALLOTMENT NEVER ISSUED": (["ALLOTMENT NEVER ISSUED"], []),
}
# Claim types about loss of title.
LOSS_OF_TITLE = ["FORCED FEE", "SECRETARIAL TRANSFER", "UNAPPROVED", "WITHOUT APPROVAL", "TAX FORFEITURE", "TAXATION", "RECOVERY"]
# Authorities of fee and of trust patents.
FEE_AUTHORITIES = [
    "Indian Fee Patent", "Indian Fee Patent (Heir)", "Indian Fee Patent (IRA)", "Indian Fee Patent (Non-IRA)", "Indian Fee Patent-Misc.", "Indian Fee Patent-Term or Non", "Indian Homestead Fee Patent", "Indian Trust to Fee",
]
TRUST_AUTHORITIES = [
    "Indian Trust Patent", "Indian Trust Patent (Wind R)", "Indian Homestead Trust", "Indian Reissue Trust", "Indian Allotment - General", "Indian Allotment in Nat. Forest", "Indian Allotment-Wyandotte", "Indian Partition", "Timber Culture",
]


def in_claim_group(claim_type: Column, group: str) -> Column:
    """Whether a claim type belongs to a named group; an unnamed group is a text that must occur."""
    must, never = CLAIM_GROUPS.get(group, ([group], []))
    yes = any_of(claim_type, must)
    return yes & ~any_of(claim_type, never) if never else yes


def patent_class(authority: Column) -> Column:
    """'fee', 'trust' or 'other' by authority."""
    return F.when(authority.isin(FEE_AUTHORITIES), "fee").when(authority.isin(TRUST_AUTHORITIES), "trust").otherwise("other")
