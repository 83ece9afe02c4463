"""Typed tribe and reservation labels: cleaning, and mapping to a canonical list by a pigeonhole join. SQL only.

A label is cut down to its name: notes, generic words and states go, shortened directions are written out, and
a direction stands first. The canonical list gives every way to name an entry (tribe, other name, reservation,
and tribe with reservation, in either order). Labels that equal a way are mapped at once. Of the others, those
within ``k`` edits of a way share at least one of its k + 1 segments, unchanged and moved by at most k places:
an equality join on (length, segment, text) finds the candidates, levenshtein verifies them, and an anti-join
reports what stays unmatched with ref_id 0. k grows with the length of the canonical text (1, 2, 3, 4).

Defined cases: null and blank labels have no row; a label as close to several entries as to the best one gets
the smallest ref_id, and ``ties`` says how many others there were; a label with another direction (Upper, Lower, ...) than an entry never means it; equal labels are mapped
once and joined back, so repeated labels cost nothing; an empty list leaves all unmatched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ledgerlark.runtime import Kept, small

DIRECTIONS = "UPPER|LOWER|NORTHERN|SOUTHERN|EASTERN|WESTERN"


@dataclass(frozen=True)
class LabelWords:
    """What is known of a corpus of labels beforehand; nothing by default."""

    states: dict[str, list[str]] = field(default_factory=dict)  # code -> names and abbreviations that follow a label
    generic: str = ""  # pattern of words that say what is named, not its name
    nothing: str = ""  # pattern of labels that name nothing
    short: tuple[tuple[str, str], ...] = ()  # (pattern of shortened words, word)
    letters: tuple[str, str] = ("", "")  # signs, and the letters they are mistaken for


def words_sql(column: str, words: LabelWords) -> str:
    """SQL text: the label's words, upper-cased, without notes, generic words and states; shortened words written out."""
    x = f"regexp_replace(upper({column}), '[’'']', '')"
    if words.letters[0]:
        x = f"translate({x}, '{words.letters[0]}', '{words.letters[1]}')"
    if words.states:
        names = sorted({n for v in words.states.values() for n in v}, key=len, reverse=True)
        state = "|".join(n.replace(" ", r"\\.? ?") for n in names)
        x = rf"regexp_replace({x}, '\\(({'|'.join(words.states)})\\)|[, ]+({state})\\.?\\s*(?=$|\\)|\\(|,|/| TRIBE| BAND)', ' ')"
    for short, long in words.short:
        x = rf"regexp_replace({x}, '(?<![A-Z0-9])({short})(?![A-Z0-9])\\.?', '{long}')"
    if words.generic:
        x = rf"regexp_replace({x}, '(?<![A-Z0-9])({words.generic})(?![A-Z0-9])\\.?', ' ')"
    return rf"trim(regexp_replace({x}, '\\s+', ' '))"


def compact_sql(words: str) -> str:
    """SQL text: the words run together, a direction first."""
    direction = rf"regexp_extract({words}, '(?<![A-Z0-9])({DIRECTIONS})(?![A-Z0-9])', 1)"
    return rf"concat({direction}, regexp_replace(regexp_replace(regexp_replace({words}, '(?<![A-Z0-9])({DIRECTIONS})(?![A-Z0-9])', ' '), '(?<![A-Z0-9])(AND|OF)(?![A-Z0-9])', ' '), '[^A-Z0-9]', ''))"


def direction_sql(words: str) -> str:
    """SQL text: the direction among the words, or ''."""
    return rf"regexp_extract({words}, '(?<![A-Z0-9])({DIRECTIONS})(?![A-Z0-9])', 1)"


def nothing_sql(text: str, words: LabelWords) -> str:
    """SQL text: whether the words name nothing."""
    bare = rf"trim(regexp_replace(regexp_replace({text}, '[^A-Z0-9]', ' '), '\\s+', ' '))"
    named = f" OR {bare} RLIKE '^({words.nothing})$'" if words.nothing else ""
    return rf"({bare} = ''{named} OR length({bare}) < 3)"


_K = "CASE WHEN length(way) < 6 THEN 1 WHEN length(way) < 9 THEN 2 WHEN length(way) < 14 THEN 3 ELSE 4 END"


def canonical_ways(reference: DataFrame, words: LabelWords) -> DataFrame:
    """Rows (ref_id, way, direction): every text that names an entry of the canonical list."""
    parts = f"""
      SELECT ref_id, {compact_sql('t')} AS tribe, {direction_sql('t')} AS direction, swapped, {compact_sql('a')} AS other, {compact_sql('r')} AS place,
             regexp_extract(r, '^[^A-Z0-9]*([A-Z0-9]+)', 1) AS place_word
      FROM (SELECT CAST(ref_id AS BIGINT) AS ref_id, {words_sql('tribe_name', words)} AS t, {words_sql("coalesce(also_known_as, '')", words)} AS a, {words_sql("coalesce(reservation_name, '')", words)} AS r,
                   regexp_replace(regexp_replace(upper(tribe_name), '^(.*) (AND|&) (.*)$', '$3 $1'), '[^A-Z]|\\\\b({DIRECTIONS})\\\\b', '') AS swapped
            FROM {{ref}} WHERE trim(tribe_name) != '')"""
    ways = f"""
      SELECT DISTINCT ref_id, direction, way FROM (
        SELECT ref_id, direction, explode(array(tribe, if(swapped = replace(tribe, direction, ''), tribe, concat(direction, replace(swapped, direction, ''))))) AS way FROM ({parts})
        UNION ALL SELECT ref_id, '', explode(array(other, place)) FROM ({parts})
        UNION ALL SELECT ref_id, direction, explode(array(concat(tribe, place), concat(tribe, place_word), concat(tribe, other), concat(direction, swapped, place))) FROM ({parts}) WHERE place != '' OR other != ''
        UNION ALL SELECT ref_id, direction, explode(array(concat(direction, place, replace(tribe, direction, '')), concat(direction, place_word, replace(tribe, direction, '')))) FROM ({parts}) WHERE place != '')
      WHERE length(way) > 2"""
    return reference.sparkSession.sql(ways, ref=reference)


def map_labels(labels: DataFrame, reference: DataFrame, column: str = "label", words: LabelWords = LabelWords()) -> DataFrame:
    """Rows (label, ref_id, edits, ties) of the distinct non-blank labels; ref_id 0, edits and ties null where the list has no entry meant."""
    spark = labels.sparkSession
    forms = Kept(spark.sql(rf"""
      SELECT label, form, direction FROM (
        SELECT label, explode(array_distinct(array({compact_sql('words')}, {compact_sql("regexp_replace(upper(label), '[(].*$', '')")}))) AS form, {direction_sql('words')} AS direction, {nothing_sql('words', words)} AS nothing
        FROM (SELECT label, {words_sql('label', words)} AS words FROM (SELECT DISTINCT `{column}` AS label FROM {{labels}} WHERE trim(`{column}`) != '')))
      WHERE NOT nothing AND length(form) > 2""", labels=labels)).df  # fmt: skip
    ways = Kept(spark.sql(f"SELECT ref_id, way, direction, {_K} AS k FROM {{ways}}", ways=canonical_ways(reference, words))).df
    exact = Kept(spark.sql("SELECT f.label, min(w.ref_id) AS ref_id, 0 AS edits, count(DISTINCT w.ref_id) - 1 AS ties FROM {forms} f JOIN {ways} w ON f.form = w.way AND (f.direction = w.direction OR w.direction = '') GROUP BY f.label", forms=forms, ways=ways)).df
    # Segments of the ways: segment i of k + 1 has the length (length + i) div (k + 1) and starts where the shorter ones end.
    segments = spark.sql("""
      SELECT ref_id, way, direction, k, length(way) AS len, i, substring(way, start, size) AS piece
      FROM (SELECT *, (length(way) + i) DIV (k + 1) AS size, 1 + aggregate(sequence(0, i), 0L, (s, j) -> s + if(j < i, (length(way) + j) DIV (k + 1), 0L)) AS start
            FROM (SELECT *, explode(sequence(0, k)) AS i FROM {ways}))""", ways=ways)  # fmt: skip
    # The segments' places by the length of the labels they can occur in: few rows, whatever the list's size.
    shapes = spark.sql("""
      SELECT DISTINCT length(way) AS len, explode(sequence(length(way) - k, length(way) + k)) AS form_len, k, i, (length(way) + i) DIV (k + 1) AS size, 1 + aggregate(sequence(0, i), 0L, (s, j) -> s + if(j < i, (length(way) + j) DIV (k + 1), 0L)) AS start
      FROM (SELECT way, k, explode(sequence(0, k)) AS i FROM {ways})""", ways=ways)  # fmt: skip
    # The labels still open are spread over the cluster before each is laid out into its pieces; a label's pieces go straight to the
    # list's segments, which are broadcast if they are small. Only what shares a segment is made distinct.
    spread = 2 * spark.sparkContext.defaultParallelism
    near = spark.sql(f"""
      WITH open AS (SELECT /*+ REPARTITION({spread}) */ f.* FROM {{forms}} f LEFT ANTI JOIN {{exact}} e ON f.label = e.label),
      probes AS (
        SELECT o.label, o.form, o.direction, s.len, s.i, substring(o.form, p.at, s.size) AS piece
        FROM open o JOIN {{shapes}} s ON length(o.form) = s.form_len AND length(o.form) >= s.size
        LATERAL VIEW explode(sequence(greatest(1L, s.start - s.k), greatest(1L, least(s.start + s.k, length(o.form) - s.size + 1)))) p AS at),
      found AS (
        SELECT DISTINCT p.label, p.form, s.ref_id, s.way, s.k FROM probes p JOIN {{segments}} s ON p.len = s.len AND p.i = s.i AND p.piece = s.piece AND (p.direction = s.direction OR p.direction = '' OR s.direction = '')),
      near AS (SELECT label, ref_id, min(edits) AS edits FROM (SELECT label, ref_id, levenshtein(form, way, k) AS edits FROM found) WHERE edits >= 0 GROUP BY label, ref_id),
      best AS (SELECT label, min(struct(edits, ref_id)) AS b FROM near GROUP BY label)
      SELECT n.label, min(n.ref_id) AS ref_id, min(n.edits) AS edits, count(*) - 1 AS ties FROM near n JOIN best b ON n.label = b.label AND n.edits = b.b.edits GROUP BY n.label""", forms=forms, exact=exact, shapes=small(shapes), segments=small(segments))  # fmt: skip
    known = Kept(spark.sql("SELECT label, ref_id, edits, ties FROM {exact} UNION ALL SELECT label, ref_id, edits, ties FROM {near}", exact=exact, near=near)).df
    return spark.sql(f"""
      WITH all_labels AS (SELECT DISTINCT `{column}` AS label FROM {{labels}} WHERE trim(`{column}`) != '')
      SELECT label, ref_id, edits, ties FROM {{known}}
      UNION ALL SELECT a.label, 0L, CAST(NULL AS INT), CAST(NULL AS BIGINT) FROM all_labels a LEFT ANTI JOIN {{known}} k ON a.label = k.label""", labels=labels, known=known)  # fmt: skip


def map_tables(tables: list[tuple[str, DataFrame, str, str]], reference: DataFrame, words: LabelWords = LabelWords()) -> DataFrame:
    """Rows (src, id, ref_id) of every record with a non-blank label; tables: (src, table, id column, label column)."""
    every = None
    for src, df, id_, column in tables:
        one = df.sparkSession.sql(f"SELECT '{src}' AS src, CAST(`{id_}` AS BIGINT) AS id, `{column}` AS label FROM {{t}} WHERE trim(`{column}`) != ''", t=df)
        every = one if every is None else every.unionByName(one)
    mapped = map_labels(every, reference, words=words)
    return every.sparkSession.sql("SELECT DISTINCT e.src, e.id, m.ref_id FROM {every} e JOIN {mapped} m ON e.label = m.label", every=every, mapped=mapped)
