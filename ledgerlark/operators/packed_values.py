"""Several values packed in one field: infer each source's delimiters from its data, split, explode with position.

Candidates are drawn from the texts: every sign, or run of one sign, that is no letter, digit or blank, bare and between
blanks, line breaks and tabs among them. They are scored per source on two grounds: *piece types* (what share of the
pieces has a shape, digits folded, that also occurs as a whole value in the table, or is quoted) and *piece counts* (how
concentrated the numbers of pieces of the rows that hold the candidate are). A source's scores are pulled towards the scores
over all sources by ``pull`` rows, so that a source with few rows is not judged on chance, while one with many
goes by its own. Sources may mix delimiters; every candidate whose score reaches ``threshold`` splits, and where none
does, nothing is split.

Text in double quotes is one piece; doubled inner quotes stand for one. A quote that never closes is an
ordinary character. List numbers ("1) ... 2) ...") separate pieces where the text starts with "1)".

Defined cases: null, empty and blank texts have no pieces; pieces are trimmed and empty ones dropped before
positions 1, 2, ... are given; repeated rows stay repeated. A null source is a source of its own. The private-use
characters U+E001-U+E004 serve as marks and are removed from the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.runtime import Kept, small

_OPEN, _CLOSE, _CUT, _QUOTE = "", "", "", ""
_QUOTED = r'("(?:[^"]++|"")*+")'
#: A sign that may separate; a run of one sign counts as one. Not quotes, brackets, or what joins words and numbers.
_SIGN = r"""([^\p{L}\p{N}\p{M} "'’()\[\]""" + _QUOTE + r"""])\1*"""
_ENDS = r"^(?:[^\p{L}\p{N}" + _QUOTE + r"(\"]|\b\d{1,3}\)\s)+|[^\p{L}\p{N}" + _QUOTE + r")\"]+$"


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_OPEN}{_CLOSE}{_CUT}{_QUOTE}]", "")


def _cut(text: Column, pattern: Column) -> Column:
    """Pieces of a text at a pattern outside quotes; not trimmed."""
    marked = F.regexp_replace(_clean(text), _QUOTED, f"{_OPEN}$1{_CLOSE}")
    cut = F.regexp_replace(marked, F.concat(F.lit(f"({_OPEN}[^{_CLOSE}]*+{_CLOSE})|(?:"), pattern, F.lit(")")), F.lit(f"$1{_CUT}"))
    return F.split(F.regexp_replace(F.regexp_replace(cut, _CLOSE + _CUT, ""), _OPEN, ""), _CUT)


def _folded(text: Column) -> Column:
    """A text with its numbers and keys made alike."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Z]{2}\d+_+", "9"), r"\d+(?:[-.]\d+)*", "9")


def candidates(masked: Column) -> Column:
    """Distinct candidates of a text whose quoted parts are masked: signs, and signs between blanks."""
    bare = F.regexp_extract_all(masked, F.lit(_SIGN), F.lit(0))
    spaced = F.regexp_extract_all(masked, F.lit(f" {_SIGN}(?= )"), F.lit(0))
    return F.array_distinct(F.concat(bare, F.transform(spaced, lambda s: F.concat(s, F.lit(" ")))))


def delimiter_scores(df: DataFrame, text: str, source: str | None = None, pull: float = 20.0, common: float = 1e-4) -> DataFrame:
    """Scores (source, delimiter, rows, types, counts, score) of every candidate in every source, over all rows."""
    rows = df.where(F.trim(F.col(f"`{text}`")) != "").select((F.col(f"`{source}`").cast("string") if source else F.lit("")).alias("source"), F.regexp_replace(_clean(F.col(f"`{text}`")), _QUOTED, _QUOTE).alias("text"))
    # Equal (source, number-folded) texts score equally, so they are counted once with their number.
    rows = Kept(rows.groupBy("source", _folded(F.col("text")).alias("text")).agg(F.count("*").alias("n"))).df
    whole = rows.groupBy(F.regexp_replace("text", _ENDS, "").alias("shape")).agg(F.sum("n").alias("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = small(whole.where(F.col("n") >= max(2.0, common * total)).select("shape", F.lit(True).alias("known")))
    long = rows.select("source", "n", "text", F.explode(candidates(F.col("text"))).alias("delimiter"))
    pieces = F.filter(F.transform(F.split(F.replace("text", "delimiter", F.lit(_CUT)), _CUT), lambda p: F.regexp_replace(p, _ENDS, "")), lambda p: p != "")
    long = long.select("source", "delimiter", "n", pieces.alias("pieces")).where(F.size("pieces") > 1).withColumn("size", F.size("pieces"))
    # Type regularity: pieces grouped by shape first, so the look-up meets each shape once.
    shapes = long.select("source", "delimiter", "n", F.explode("pieces").alias("shape")).groupBy("source", "delimiter", "shape").agg(F.sum("n").alias("n"))
    types = shapes.join(known, "shape", "left").groupBy("source", "delimiter").agg(F.sum(F.when((F.col("shape") == _QUOTE) | F.col("known").isNotNull(), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("pieces"))
    # Count consistency: chance that two rows have numbers of pieces that differ by one at most.
    sizes = long.groupBy("source", "delimiter", "size").agg(F.sum("n").alias("n"))
    near = sizes.select("source", "delimiter", "n", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).groupBy("source", "delimiter", "size").agg(F.sum("n").alias("around"))
    counts = _consistency(sizes, near)
    both = Kept(types.join(counts, [types["source"].eqNullSafe(counts["source"]), types["delimiter"] == counts["delimiter"]]).select(types["source"], types["delimiter"], "good", "pieces", "rows", "pairs")).df
    overall = both.groupBy("delimiter").agg((F.sum("good") / F.sum("pieces")).alias("all_types"), (F.sum(F.col("pairs") / F.col("rows")) / F.sum("rows")).alias("all_counts"), F.sum("rows").alias("all_rows"))
    # A source that holds a candidate too rarely to judge it goes by what holds everywhere; so every source gets the frequent ones.
    frequent = overall.where(F.col("all_rows") >= max(1.0, common * total)).agg(F.collect_list("delimiter").alias("d"))  # at most some 1 / common
    named = rows.select("source").distinct().join(F.broadcast(frequent), how="inner").select("source", F.explode("d").alias("delimiter"))  # a row of one list
    base = named.unionByName(both.select("source", "delimiter")).distinct().join(small(overall), "delimiter").alias("s")
    own = both.alias("o")
    both = base.join(own, F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.delimiter") == F.col("o.delimiter")), "left").select("s.*", F.coalesce("rows", F.lit(0)).alias("rows"), "good", "pieces", "pairs")
    mix = lambda value, general: (F.coalesce(value, F.lit(0.0)) * F.col("rows") + general * pull) / (F.col("rows") + pull)
    both = both.withColumn("types", mix(F.col("good") / F.col("pieces"), F.col("all_types"))).withColumn("counts", mix(F.try_divide(F.col("pairs"), F.col("rows").cast("double") * F.col("rows")), F.col("all_counts")))
    return both.select("source", "delimiter", "rows", "types", "counts", (F.col("types") * (0.8 + 0.2 * F.col("counts"))).alias("score"))


def _consistency(sizes: DataFrame, near: DataFrame) -> DataFrame:
    s, t = sizes.alias("s"), near.alias("t")
    on = F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.delimiter") == F.col("t.delimiter")) & (F.col("s.size") == F.col("t.size"))
    return s.join(t, on).groupBy("s.source", "s.delimiter").agg(F.sum("s.n").alias("rows"), F.sum(F.col("s.n").cast("double") * F.col("t.around")).alias("pairs"))


def split_pieces(text: Column, delimiters: Column | list[str]) -> Column:
    """Trimmed, unquoted, non-empty pieces of ``text`` at the delimiters, longer ones first; without any, at list numbers only."""
    given = F.array(*map(F.lit, delimiters)).cast("array<string>") if isinstance(delimiters, list) else delimiters
    given = F.array_sort(given, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    # A delimiter between blanks leaves the second blank to the next one.
    literal = lambda d: F.when(d.rlike("^ .* $"), F.concat(F.lit(r"(?<=\s)\Q"), F.trim(d), F.lit(r"\E(?=\s)"))).otherwise(F.concat(F.lit(r"\Q"), d, F.lit(r"\E")))
    base = F.coalesce(F.nullif(F.array_join(F.transform(given, literal), "|"), F.lit("")), F.lit("(?!)"))
    number = F.concat(F.lit(r"(?:^|(?<=\s|"), base, F.lit(r"))\d{1,3}\)\s"))
    pieces = _cut(text, F.when(text.rlike(r"^\s*1\)\s"), F.concat(base, F.lit("|"), number)).otherwise(base))
    trim = lambda p: F.regexp_replace(p, r"^[\s\xa0]+|[\s\xa0]+$", "")
    bare = lambda p: F.when(p.rlike(r'(?s)^"(?:[^"]++|"")*+"$'), trim(F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"')))).otherwise(p)
    return F.filter(F.transform(F.transform(pieces, trim), bare), lambda p: p != "")


def split_packed(df: DataFrame, text: str, keys: list[str], source: str | None = None, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """Rows (*keys, pos, note): the pieces of every text that holds at least ``least``, with their position from 1."""
    scores = delimiter_scores(df, text, source).where(F.col("score") >= threshold)
    chosen = Kept(scores.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_set("delimiter")).alias("_d"))).df  # a row per source
    base = df.withColumn("_source", F.col(f"`{source}`").cast("string") if source else F.lit("")).where(F.trim(F.col(f"`{text}`")) != "")
    base = base.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").alias("_text"), "_source")
    base = base.join(small(chosen), F.col("_source").eqNullSafe(F.col("_s")), "left")
    signs = F.col("_text").rlike(r'[^\p{L}\p{N} ]')
    pieces = F.when(signs, split_pieces(F.col("_text"), F.coalesce("_d", F.array().cast("array<string>")))).otherwise(F.array(F.regexp_replace("_text", r"^\s+|\s+$", "")))
    out = base.select(*[f"_k{i}" for i in range(len(keys))], pieces.alias("p")).where(F.size("p") >= least)
    out = out.select(*[f"_k{i}" for i in range(len(keys))], F.posexplode("p").alias("pos", "note"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], (F.col("pos") + 1).cast("long").alias("pos"), "note")
