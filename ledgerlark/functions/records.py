"""Fields of patent and agency records as Column expressions: links, labels, reasons, printed numbers, land keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class names and their codes in a record's address; other classes have SER.
CLASS_CODES = {
    "Serial Land Patent": "SER", "State Land Patent": "STA", "Indian Allotment Patent": "IA", "Indian Allotment - General": "IA", "Indian Fee Patent": "IF", "Indian Trust Patent": "SER",
    "Indian Trust to Fee": "SER", "Indian Homestead Fee Patent": "SER", "Miscellaneous Volume Patent": "MV", "Sioux Scrip Patent": "SS", "Chippewas Treaty Patent": "CT",
}
# Fixed value: where the General Land Office's records are shown.
RECORD_ADDRESS = "https://glorecords.blm.gov/details/patent/default.aspx"
# Reasons of cancellation, in the order in which they are tried, by pattern of the lower-case text.
REASONS = [
    ("1927_and_1931_acts", r"1927\s*and\s*1931\s*act"),
    ("issued_without_application_and_acceptance_refused", r"(?s)^(?=.*issued (?:w/o|without) application)(?=.*refus)"),
    ("issued_without_application", r"issued (?:w/o|without) application"),
    ("acceptance_refused", "refus"),
    ("caster_patent_letter", "caster patent"),
    ("court_decree", "decree"),
    ("incompetency_determination", "incompetent"),
    ("1927_act", r"\b1927\b"),
    ("1931_act", r"\b1931\b"),
    ("individual_order", "cancell?ed by order"),
]
# Pages that say that a record doesn't exist (any case; the last as written).
MISSING_PAGES = ["a document does not exist in our database", "could not be located", "no records found"]
MISSING_PAGE_AS_WRITTEN = "Object reference not set"
# Fixed value: kinds of documents named in their ids.
DOCUMENT_KIND = r"(?i)_(agency_narrative|questionnaire|affidavit|ledger(?:_page|_entry)?|shawnee)"


def lookup(c: Column, values: dict[str, str | None]) -> Column:
    """The value of a key in a small map; null where there is none."""
    if not values:
        return F.lit(None).cast("string")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("string"))])[c]


def mapped(c: Column, values: dict[str, str | None]) -> Column:
    """Struct (label, is_mapped): a key's label, which the map may say to be none, and whether the map has the key."""
    known = F.coalesce(c.isin(list(values)), F.lit(False)) if values else F.lit(False)
    return F.struct(lookup(c, values).alias("label"), known.alias("is_mapped"))


def code_label(c: Column, label: Column) -> Column:
    """A code's label, or 'Unidentified (code)'."""
    return F.coalesce(label, F.concat(F.lit("Unidentified ("), c, F.lit(")")))


def record_url(accession: Column, document_class: Column) -> Column:
    """Address of a record; a class goes by its code, and one without a code of five letters at most is SER."""
    code = F.coalesce(lookup(document_class, CLASS_CODES), F.nullif(document_class, F.lit("")))
    code = F.when(F.length(code) <= 5, code).otherwise("SER")
    return F.when(accession != "", F.concat(F.lit(f"{RECORD_ADDRESS}?accession="), accession, F.lit("&docClass="), code))


def linked_remarks(remarks: Column) -> Column:
    """Remarks with the numbers behind NR and AND made links."""
    return F.regexp_replace(remarks, r"((?:NR\.?|AND)\s+)(\d{4,})", rf'$1<a href="{RECORD_ADDRESS}?accession=$2&docClass=SER" target="_blank">$2</a>')


def authority_name(c: Column) -> Column:
    """NAME in 'DATE: NAME (STATUTE)', null for anything else."""
    return F.nullif(F.trim(F.regexp_extract(c, r":\s*(.+?)\s*\(", 1)), F.lit(""))


def io_label(label: Column) -> Column:
    """Whether a reference's label calls it an IO: yes, unknown, or null for other labels."""
    up = F.upper(label)
    return F.when(F.regexp_replace(up, "[. ]", "").contains("IO"), "yes").when(up.contains("BIA") | up.contains("DOCUMENT"), "unknown")


def cancellation_reason(c: Column) -> Column:
    """Class of a typed reason by the first rule that fits, 'other' if none does, null for blank."""
    low = F.lower(F.trim(c))
    out = F.when(low == "", None)
    for name, pattern in REASONS:
        out = out.when(low.rlike(pattern), name)
    return F.when(c.isNotNull(), out.otherwise("other"))


def page_says_missing(c: Column) -> Column:
    """Whether a page says that its record doesn't exist."""
    low = F.lower(c)
    out = c.contains(MISSING_PAGE_AS_WRITTEN)
    for text in MISSING_PAGES:
        out = out | low.contains(text)
    return out


def _number_or_dash(t: Column, nothing: list[str]) -> Column:
    return F.when(~t.isin([*nothing, ""]), t)


def footnoted_count(c: Column) -> Column:
    """A printed count behind a footnote's number: '22 34,380,726' is 34380726; what is left of letters goes; a dash is null, 0 is 0."""
    t = F.regexp_replace(c, r"^(\d{1,2})\s+(\d{1,3}(?:,\d{3})+)", "$2")
    t = F.regexp_replace(t, r"^(\d{1,2})\s+(\d+)$", "$2")
    t = _number_or_dash(F.trim(F.replace(t, F.lit(","), F.lit(""))), ["—", "-", "…"])
    return F.nullif(F.regexp_replace(t, "[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")


def tailnoted_number(c: Column) -> Column:
    """A printed number before a footnote's number: '1,234.5 2' is 1234.5; dashes, 'No answer' and 0 are null."""
    t = F.regexp_replace(F.trim(F.replace(c, F.lit(","), F.lit(""))), r"\s+\d+$", "")
    return _number_or_dash(t, ["—", "-", "…", "No answer", "0"]).try_cast("double")


def money(c: Column) -> Column:
    """A printed amount without commas and dollar signs; dashes are null, 0 is 0."""
    t = F.trim(F.regexp_replace(c, "[,$]", ""))
    return _number_or_dash(t, ["—", "-", "…"]).try_cast("double")


def agency_name(c: Column) -> Column:
    """A printed agency without the footnote's number behind it and without words of its form."""
    t = F.regexp_replace(F.trim(c), r"\s+\d+$", "")
    return F.replace(F.replace(t, F.lit(" consolidated"), F.lit("")), F.lit(" area field office"), F.lit(""))


def leading_year(c: Column) -> Column:
    """The four digits a text begins with, as a year."""
    return F.regexp_extract(F.trim(c), r"^(\d{4})", 1).try_cast("int")


def reservation_core(c: Column) -> Column:
    """The reservation in 'Agency (A.): Reservation (R.)', the name in 'Name (A. and R.)', else the text."""
    pair = F.regexp_extract(c, r"^.+\(A\.\):\s*(.+?)\s*\(R\.\)", 1)
    both = F.regexp_extract(c, r"^(.+?)\s*\(A\. and R\.\)", 1)
    return F.coalesce(F.nullif(F.trim(pair), F.lit("")), F.nullif(F.trim(both), F.lit("")), c)


def reservation_label(agency: Column, reservation: Column) -> Column:
    """Label of an agency's reservation, as ``reservation_core`` reads it."""
    return F.when(agency == reservation, F.concat(agency, F.lit(" (A. and R.)"))).otherwise(F.concat(agency, F.lit(" (A.): "), reservation, F.lit(" (R.)")))


def canonical_label(c: Column, overrides: dict[str, str]) -> Column:
    """A label in its canonical spelling; blank and FRN (further research needed) are null."""
    t = F.trim(c)
    return F.when((t != "") & (F.upper(t) != "FRN"), F.coalesce(lookup(t, overrides), t))


def document_part(document_id: Column) -> Column:
    """Number of the part a document's id begins with."""
    return F.regexp_extract(document_id, r"(?i)^part(\d+)_", 1).try_cast("int")


def document_kind(document_id: Column) -> Column:
    """Kind of document its id names; all ledgers are one kind; 'unknown' if none is named."""
    kind = F.lower(F.regexp_extract(F.coalesce(document_id, F.lit("")), DOCUMENT_KIND, 1))
    return F.when(kind == "", "unknown").when(kind.startswith("ledger"), "ledger").otherwise(kind)


def map_class(authority: Column, forced: Column | None = None) -> Column:
    """'fee', 'trust' or 'other' by words of the authority; a forced patent is fee whatever its authority. Without ``forced``: as issued."""
    has = lambda *words: F.coalesce(sum((authority.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    kind = F.when(has("Fee"), "fee").when(has("Trust", "Reissue", "Allotment", "Partition"), "trust").otherwise("other")
    return kind if forced is None else F.when(F.coalesce(forced, F.lit(False)), "fee").otherwise(kind)


def padded(c: Column, n: int) -> Column:
    """A number's whole part with zeros in front, not cut if it is longer; '' for what is no number."""
    whole = c.cast("string").try_cast("double").cast("long").cast("string")
    return F.coalesce(F.lpad(whole, F.greatest(F.lit(n), F.length(whole)), F.lit("0")), F.lit(""))


def section_key(state: Column, meridian: Column, township: Column, township_dir: Column, range_: Column, range_dir: Column, section: Column) -> Column:
    """Key of a section: state, meridian of two digits, township and range of three each with direction, section of two."""
    zero = F.lit("0")
    return F.concat(state, padded(meridian, 2), padded(township, 3), zero, township_dir, padded(range_, 3), zero, range_dir, F.lit("0SN"), padded(section, 2), zero)


def aliquot(a: Column) -> Column:
    """Struct (kind, value) of a land description; value is what a parcel is looked up by: lot, quarter or quarter-quarter, null if empty."""
    t = F.nullif(F.trim(a), F.lit(""))
    lot, half = F.regexp_extract(t, "^([0-9]+)(?:[NSEW]{1,2})?$", 1), F.regexp_extract(t, "^[NSEW]½((?:[NSEW]{2}){1,2})$", 1)
    whole = t.rlike("^[0-9]+$")
    number = lot.try_cast("decimal(38,0)")
    kind = (
        F.when(t.isNull(), "empty").when(lot != "", F.when(number <= 16, "lot").otherwise("large_lot")).when(t.rlike("^[NSEW]{4}$") | (F.length(half) == 4), "qqsec")
        .when(t.rlike("^[NSEW]{2}$") | (F.length(half) == 2), "qsec").when(t.rlike("^[NSEW]½$"), "half_section").otherwise("partial")
    )
    value = F.when(whole, t).when(lot != "", number.cast("string")).when(half != "", half).otherwise(t)
    return F.struct(kind.alias("kind"), value.alias("value"))


def rendered(c: Column, is_date: bool = False) -> Column:
    """A field as text: null is '', a date its ISO form."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd") if is_date else c.cast("string"), F.lit(""))


def search_tokens(*columns: Column) -> Column:
    """Distinct sorted lower-case words of several fields."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return F.array_sort(F.array_distinct(F.filter(F.split(joined, r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def reference_key(c: Column) -> Column:
    """Struct (letter, year, id) of 'letter-year' or of a numeric id."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^\s*(\d+)-(\d+)\s*$", i), F.lit(""))
    return F.struct(part(1).alias("letter"), part(2).alias("year"), F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c)).try_cast("bigint").alias("id"))


def evidence_class(flag: Column, number: Column, reference: Column) -> Column:
    """Agreement of a model's finding (flag, number) with a remark's reference, compared by letters and digits, either within the other."""
    bare = lambda c: F.coalesce(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))
    yes, n, r = F.coalesce(flag, F.lit(False)), bare(number), bare(reference)
    has = F.coalesce(reference != "", F.lit(False))
    both = F.when((n == "") & (r != ""), "rescue").when((n != "") & (r != "") & (r.contains(n) | n.contains(r)), "both_yes_match").otherwise("both_yes_mismatch")
    return F.when(yes & has, both).when(yes, "model_yes_remarks_no").when(has, "model_no_remarks_yes").otherwise("both_no")
