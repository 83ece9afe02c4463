"""Typed person names taken apart: surname, given name, middle initial, suffix.

A name may be given first or surname first, with or without a comma, abbreviated, with a nickname, with
notes (heirs of, deceased) and typing errors. What a given name is, is learned from all names: a token is one
if it stands where given names stand in at least ``GIVEN_SHARE`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.runtime import Kept, small

#: Share of all names from which a leading token counts as a given name; so there are at most 1 / share.
GIVEN_SHARE = 0.002

#: Share of all names from which a learned short form is kept; so there are at most 1 / share.
SHORT_SHARE = 1e-5

_PLAIN = re.compile(r"[()\"]")
_OTHER = re.compile(r"[^A-Z0-9]")
_SUFFIXES = frozenset(("JR", "SR", "II", "III"))


def _letters(text: str) -> str:
    """An upper-case text without what is neither letter nor digit."""
    return text if text.isascii() and text.isalnum() else _OTHER.sub("", text)


def _tokens_of(text: str) -> list[str]:
    """What stands between blanks and full stops."""
    return text.replace(".", " ").split()


@dataclass(frozen=True)
class NameWords:
    """What is known of a corpus beforehand; nothing by default."""

    nobody: frozenset[str] = frozenset()  # entries that name nobody
    notes: str = ""  # pattern of notes around a name
    titles: frozenset[str] = frozenset()  # leading words that are no given names
    generic: str = ""  # pattern of words in a group's label that are not its name
    short_forms: dict[str, str] = field(default_factory=dict)  # short form -> given name, beside the learned ones


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit); most + 1 if beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _cuts(token: str, most: int) -> set[str]:
    """The token with up to ``most`` letters left out."""
    out = {token}
    last = out
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class NameParser:
    """Takes typed names apart, given the known given names and their short forms."""

    def __init__(self, given: list[str], short: dict[str, str] | None = None, words: NameWords = NameWords()):
        self.words, self.notes = words, re.compile(words.notes) if words.notes else None
        self.known = {**words.short_forms, **(short or {})}
        self.known.update({f: f for f in set(self.known.values())})
        self.known.update({g: self.known.get(g, g) for g in given if len(g) > 1})
        # Known names by what is left of them after up to two deletions, to look misspelt tokens up.
        self.targets = frozenset(self.known.values())
        self.cut: dict[str, set[str]] = {}
        for name in self.known:
            for c in _cuts(name, 2 if len(name) > 4 else 1):
                self.cut.setdefault(c, set()).add(name)
        self.memory: dict[str, str] = {}

    def exact(self, token: str) -> str:
        return self.known.get(token, "") if len(token) > 1 else ""

    def near(self, token: str) -> str:
        """The one known given name closest to a misspelt token, or ''."""
        found = self.memory.get(token)
        if found is None:
            most = 2 if len(token) > 4 else 1 if len(token) > 2 else 0
            best, ends = (most + 1, False), set()
            for name in {n for c in _cuts(token, most) for n in self.cut.get(c, ())} if most else ():
                d = edits(token, name, 2 if len(name) > 4 else 1), name != self.known[name]  # full names before short forms
                if d < best:
                    best, ends = d, {self.known[name]}
                elif d == best and d[0] <= most:
                    ends.add(self.known[name])
            found = ends.pop() if len(ends) == 1 else ""
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[token] = found
        return found

    def parse(self, typed: str | None) -> tuple[str, str, str, str, str] | None:
        """(surname, given name or '', its initial, middle initial, suffix), or None if the entry names nobody."""
        if typed is None:
            return None
        s = typed.upper()
        s = self.notes.sub(" ", s) if self.notes else s
        s = (_PLAIN.sub(" ", s) if "(" in s or ")" in s or '"' in s else s).strip(" ,.-")
        if not s or s in self.words.nobody or " ".join(s.split()) in self.words.nobody:
            return None
        left, comma, right = s.partition(",")
        suffix = ""
        rest = []
        for t in _tokens_of(right if comma else s):
            bare = t.strip(",-'")
            if bare in _SUFFIXES:
                suffix = bare
            elif bare:
                rest.append(bare)
        if comma and not rest:  # "GIVEN SURNAME, JR"
            comma, rest = "", [bare for t in _tokens_of(left) if (bare := t.strip(",-'"))]
        elif comma:
            kept = []
            for t in _tokens_of(left):
                bare = t.strip("-'")
                if bare in _SUFFIXES:
                    suffix = bare
                elif bare:
                    kept.append(bare)
            surname, names = "".join(kept), rest
        if not comma:
            if len(rest) < 2:
                return (_letters("".join(rest)), "", "", "", suffix) if rest else None
            surname, names = self._order(rest)
        surname = _letters(surname)
        first = _letters(names[0]) if names else ""
        middle = next((t for x in names[1:] if (t := _letters(x))), "")[:1] if len(names) > 1 else ""
        given = self.exact(first) or (self.near(first) if len(first) > 1 else "")
        if not given and len(first) > 1:
            given = first
        return surname, given, (given or first)[:1], middle, suffix

    def _order(self, t: list[str]) -> tuple[str, list[str]]:
        """Surname and given tokens of a name without a comma."""
        last = len(t) - 1
        while last and len(t[last]) < 2:  # before trailing initials
            last -= 1
        tail = len(t) - 1 - last
        if not self.exact(t[0]):
            misspelt = len(t[0]) > 4 and bool(self.near(t[0]))
            if last and tail <= 1 and self.exact(t[last]) and not (misspelt and t[last] not in self.targets):
                return "".join(t[:last]), t[last:]
            if len(t[0]) > 1:
                if tail and len(t) > tail:
                    near_last = last and self.near(t[last])
                    return ("".join(t[:last]), t[last:]) if near_last and tail == 1 else ("".join(t[: last + 1]), t[last + 1 :])
                if not self.near(t[0]) and self.near(t[last]):
                    return "".join(t[:last]), t[last:]
        # Given name first, then one-letter middle names, then the surname.
        at = 1
        while at < len(t) - 1 and len(t[at]) == 1:
            at += 1
        return "".join(t[at:]), [t[0], *t[1:at]]


def first_named(name: Column) -> Column:
    """The trimmed first name of an entry that may hold several."""
    return F.trim(F.substring_index(F.substring_index(name, ";", 1), "&", 1))


def _given_token(name: Column) -> Column:
    """The token where given names stand: the first, or the first after a comma; '' if it is no word."""
    return F.regexp_extract(F.upper(name), r"^(?:[^,;&]*+,\s*|\s*)([A-Z]{2,})(?=[\s.;&]|$)", 1)


def _tokens(rows: DataFrame) -> DataFrame:
    """Rows (t, k) of rows (name, state, allotment): the token where the given name stands, and a code of the number, state and other letters; null without a number or with three letters or fewer."""
    name = F.upper("name")
    rest = F.regexp_replace(F.regexp_replace(name, r"^([^,;&]*+,\s*|\s*)[A-Z]{2,}(?=[\s.;&]|$)", "$1 "), r"\b[A-Z]\b|[^A-Z]+", "")
    named = rows.where(F.col("name").isNotNull()).select(_given_token(F.col("name")).alias("t"), "state", "allotment", F.when(F.col("allotment").isNotNull(), rest).alias("rest"))
    return named.select("t", F.when(F.length("rest") > 3, F.xxhash64("state", "allotment", "rest")).alias("k"))


def _given(tokens: DataFrame, words: NameWords) -> list[str]:
    n = tokens.count()
    rows = tokens.groupBy("t").agg(F.count("*").alias("n")).where((F.col("t") != "") & (F.col("n") >= max(3, int(n * GIVEN_SHARE)))).select("t").collect()  # at most 1 / GIVEN_SHARE
    return sorted(r["t"] for r in rows if r["t"] not in words.titles)


def _short_forms(tokens: DataFrame, given: list[str], words: NameWords, least: int, share: float) -> dict[str, str]:
    if not given:
        return {}
    known = tokens.where("k IS NOT NULL AND t != ''")
    full = F.col("t").isin(given)
    # The minority of other tokens goes to the known names with the same code, by broadcast if it is small.
    pairs = known.where(full).select("k", F.col("t").alias("full")).join(small(known.where(~full).select("k", F.col("t").alias("short"))), "k").distinct()
    counts = pairs.groupBy("short", "full").agg(F.count("*").alias("n")).groupBy("short").agg(F.sum("n").alias("all"), F.max_by("full", F.struct("n", "full")).alias("full"), F.max("n").alias("n"))
    bound = max(least, int(tokens.count() * SHORT_SHARE))
    found = counts.where((F.col("n") >= bound) & (F.col("n") >= share * F.col("all"))).select("short", "full").collect()  # at most 1 / SHORT_SHARE
    return {r["short"]: r["full"] for r in found if r["short"] not in words.titles}


def learn_short_forms(rows: DataFrame, given: list[str] | None = None, words: NameWords = NameWords(), least: int = 2, share: float = 0.8) -> tuple[list[str], dict[str, str]]:
    """The given names known, and short forms of them, learned from rows (name, state, allotment).

    A token that stands where given names stand in at least GIVEN_SHARE of all names is a given name, unless they are given.
    Two entries with the same state, number and other letters name one person; where one of them has a known given name and
    the other another token in its place, that token is taken to stand for the name. A token that does so at ``least``
    times, and in ``share`` of the cases for the same name, is a short form. Names without a number, or with notes around them, teach nothing.
    """
    tokens = Kept(_tokens(rows)).df
    given = _given(tokens, words) if given is None else given
    return given, _short_forms(tokens, given, words, least, share)


def parse_names(df: DataFrame, column: str, given: list[str], short: dict[str, str] | None = None, words: NameWords = NameWords()) -> DataFrame:
    """``df`` with surname, given, initial, middle, suffix of the names in ``column``; rows that name nobody are left out."""
    parser = df.sparkSession.sparkContext.broadcast(NameParser(given, short, words))
    at = df.columns.index(column)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser.value.parse
        for batch in it:
            # Each spelling of a batch is taken apart once.
            coded = batch.column(at).dictionary_encode()
            spelt = [parse(x) for x in coded.dictionary.to_pylist()]
            spelt = [p if p is not None and p[0] != "" else None for p in spelt]
            index = coded.indices
            parts = [pa.array([p[i] if p is not None else None for p in spelt], pa.string()).take(index) for i in range(5)]
            keep = pc.is_valid(parts[0])
            out = pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, "surname", "given", "initial", "middle", "suffix"])
            yield out.filter(keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(batches, f"{schema}, surname string, given string, initial string, middle string, suffix string")


def number(allotment: Column) -> Column:
    """The first number of a typed allotment number, without leading zeros; letters for digits beside digits are read as such."""
    digits = F.regexp_replace(F.upper(allotment), "(?<![A-HJKM-Z])O(?=[0-9])", "0")
    digits = F.regexp_replace(digits, "(?<=[0-9])[IL]|[IL](?=[0-9])", "1")
    digits = F.regexp_replace(F.regexp_replace(digits, "(?<=[0-9])O", "0"), "(?<=[0-9])[IL]", "1")
    digits = F.when(allotment.rlike("(?i)[0-9][ILO]|[ILO][0-9]"), digits).otherwise(allotment)
    return F.nullif(F.regexp_extract(digits, r"0*([1-9][0-9]*)", 1), F.lit(""))
