"""Faceted, sorted, paged search over a table: predicates from parameters, never from SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.functions.trigram import may_reach, similarity, span_similarity

#: Rows of a page at most, and where none or nonsense is asked for.
MOST_ROWS, USUAL_ROWS = 500, 50


@dataclass(frozen=True)
class SearchSpec:
    """What a grid may be asked: which columns it filters and sorts by, and how."""

    equal: dict[str, str] = field(default_factory=dict)  # parameter -> column
    contains: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, str] = field(default_factory=dict)  # parameter_from, parameter_to -> column
    like: dict[str, str] = field(default_factory=dict)  # the whole text in any case; % and _ stand for others
    integers: dict[str, str] = field(default_factory=dict)  # min_parameter, max_parameter -> column; what is no number filters nothing
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)  # parameter -> value -> condition; an unknown value filters nothing
    search: tuple[str, ...] = ()
    sortable: tuple[str, ...] = ()
    default: tuple[tuple[str, str], ...] = ()
    ties: tuple[str, ...] = ()

    def predicate(self, params: dict[str, Any]) -> Column:
        """All filters that have a value; a parameter the grid doesn't know is an error."""
        known = {*self.equal, *self.contains, *self.like, *self.buckets, *(f"{r}{e}" for r in self.ranges for e in ("_from", "_to")), *(f"{e}_{i}" for i in self.integers for e in ("min", "max")), "search"}
        if unknown := set(params) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        parts = [F.lit(True)]
        for name, value in params.items():
            if value is None or value == "":
                continue
            if name in self.equal:
                parts.append(F.col(self.equal[name]) == F.lit(value))
            elif name in self.contains:
                parts.append(F.col(self.contains[name]).ilike(f"%{value}%"))
            elif name in self.like:
                parts.append(F.col(self.like[name]).ilike(str(value)))
            elif name in self.buckets:
                parts.append(F.expr(self.buckets[name][value]) if value in self.buckets[name] else F.lit(True))
            elif name[:4] in ("min_", "max_") and name[4:] in self.integers:
                if str(value).strip().lstrip("+-").isdigit():
                    column = F.col(self.integers[name[4:]])
                    parts.append(column >= int(value) if name.startswith("min") else column <= int(value))
            elif name == "search":
                parts.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{value}%"), F.lit(False)) for c in self.search]))
            else:
                column = F.col(self.ranges[name.rsplit("_", 1)[0]])
                parts.append(column >= F.lit(value) if name.endswith("_from") else column <= F.lit(value))
        return reduce(lambda a, b: a & b, parts)

    def order(self, wanted: list[tuple[int, str]]) -> list[Column]:
        """Sort columns by position in ``sortable``; positions are clamped, nulls come last, ties are broken by ``ties``."""
        pairs = [(self.sortable[min(max(i, 0), len(self.sortable) - 1)], d if d in ("asc", "desc") else "asc") for i, d in wanted] or list(self.default)
        named = {c for c, _ in pairs}
        pairs += [(t, "asc") for t in self.ties if t not in named]
        return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in pairs]


@dataclass(frozen=True)
class SearchResult:
    """Rows of all, rows that match, and the page."""

    total: DataFrame
    filtered: DataFrame
    page: DataFrame


def page_rows(length: Any) -> int:
    """A page's number of rows, clamped."""
    return min(int(length), MOST_ROWS) if str(length).lstrip("+").isdigit() and int(length) > 0 else USUAL_ROWS


def search(df: DataFrame, spec: SearchSpec, params: dict[str, Any], order: list[tuple[int, str]] = (), start: int = 0, length: Any = USUAL_ROWS) -> SearchResult:
    """The grid's answer; counts and page are lazy."""
    found = df.where(spec.predicate(params))
    page = found.orderBy(*spec.order(list(order))).offset(max(0, start)).limit(page_rows(length))
    return SearchResult(df.agg(F.count("*").alias("n")), found.agg(F.count("*").alias("n")), page)


def name_search(df: DataFrame, name: str, query: str, threshold: float = 0.65) -> DataFrame:
    """Rows whose ``name`` contains the query, or is similar to it, with sim_score and match_type; the exact ones score 1."""
    exact = F.coalesce(F.col(name).ilike(f"%{query}%"), F.lit(False))
    # The similarity is worked out only for texts with enough of the query's trigrams.
    rows = df.where(exact | may_reach(F.col(name), query, threshold))
    sim = similarity(F.col(name), F.lit(query))
    scored = rows.withColumn("sim_score", F.when(exact, F.lit(1.0)).otherwise(sim)).withColumn("match_type", F.when(exact, "exact").otherwise("fuzzy"))
    return scored.where(F.col("sim_score") >= threshold)


def person_search(df: DataFrame, persons: DataFrame, key: str, name: str, query: str, threshold: float = 0.65) -> DataFrame:
    """Rows of ``df`` whose ``name`` contains the query, or that have a person who fits it, with literal_match, sim_score and match_type.

    persons: (key, first, last). One word fits a first or a last name; of two or more the first is the first name and the rest the last name of
    one person. A name fits with a similarity of ``threshold`` or more. The score, for the order only, is the query's similarity
    to the closest run of the name's words.
    """
    words = query.split()
    fits = lambda c, q: may_reach(F.col(c), q, threshold) & (similarity(F.col(c), F.lit(q)) >= threshold)
    fit = (fits("first", words[0]) | fits("last", words[0])) if len(words) == 1 else fits("first", words[0]) & fits("last", " ".join(words[1:]))
    found = persons.where(fit).select(key).distinct().withColumn("_person", F.lit(True))
    literal = F.coalesce(F.col(name).ilike(f"%{query.strip()}%"), F.lit(False))
    rows = df.join(found, key, "left").withColumn("literal_match", literal.cast("int")).where(F.col("_person").isNotNull() | literal).drop("_person")
    return rows.withColumn("sim_score", span_similarity(F.lit(query.strip().lower()), F.col(name))).withColumn("match_type", F.when(F.col("literal_match") == 1, "exact").otherwise("fuzzy"))


def relevance_first(spec: SearchSpec, wanted: list[tuple[int, str]]) -> list[Column]:
    """The order of a search by name: literal matches, then the more similar, then as wanted."""
    return [F.col("literal_match").desc(), F.round("sim_score", 6).desc_nulls_last(), *spec.order(wanted)]


def facet(df: DataFrame, *columns: str) -> DataFrame:
    """Rows (field, value, n): how often each non-blank value of the columns occurs, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).where(F.trim("p.value") != "").groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))
