"""Dates typed in several ways, and differences in years."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_date(c: Column) -> Column:
    """ISO, M/D/YYYY and 'Month D, YYYY' dates; null for anything else."""
    t = F.trim(c)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy")),
        F.when(t.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), F.try_to_date(t, "MMMM d, yyyy")),
    )


def fix_century(d: Column) -> Column:
    """Dates from 2000 on moved back by a hundred years (29 February to the 28th where it has to)."""
    return F.when(F.year(d) >= 2000, F.add_months(d, -1200)).otherwise(d)


def years_between(later: Column, earlier: Column, signed: bool = True) -> Column:
    """Whole years of 365 days from ``earlier`` to ``later``; unsigned, of the distance."""
    days = F.date_diff(later, earlier)
    return F.floor((days if signed else F.abs(days)) / 365).cast("int")


def era(year: Column) -> Column:
    """Period of a year: before 1907, to 1942, to 1975, later."""
    return F.when(year < 1907, "pre-1907").when(year <= 1942, "1907-1942").when(year <= 1975, "1943-1975").when(year > 1975, "post-1975")
