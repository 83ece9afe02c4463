"""Text garbled by a wrong decoding: a hidden Markov model labels characters, labelled spans are reversed.

The states are *clean*, *lost* (U+FFFD, what a decoder leaves of bytes it can't read) and one per encoding
pair: bytes of UTF-8 read as a single-byte encoding. A pair's state also counts the continuation bytes still
due, so that its spans are whole UTF-8 sequences. In the clean state a character has the probability it has
among the corpus's characters that can't be part of a garbled sequence (those with no non-ASCII neighbour,
counted over all documents); in a pair's state a sequence has the probability of the character it restores
to. ASCII characters are clean under every pair, so the best path falls apart at them exactly: runs of other
characters are decoded one by one, and equal runs once. Text garbled repeatedly is restored by repetition; where both times by a Cyrillic
encoding, it is found, but what looks like Cyrillic words stays.

Defined cases: null, empty and ASCII texts are not garbled; a span with U+FFFD is garbled but can't be
restored and is left; legitimate accents, quotes, fractions and foreign letters keep their place; repeated
rows are judged alike; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Encodings that UTF-8 is taken for.
PAIRS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")
#: Chance of entering, and of staying in, a garbled span.
ENTER, STAY = 0.25, 0.5
#: Chance of a character never counted: at all; of a letter where it stands as it is; of a Latin letter as what a span
#: restores to; of a sign that the span's own encoding has, as what it restores to (text garbled twice).
UNSEEN, UNSEEN_LETTER, UNSEEN_LATIN, UNSEEN_AGAIN = 1e-7, 1e-3, 1e-4, 1e-5
_RUN = re.compile("[^\x00-\x7f]+")


def _byte_tables() -> dict[str, dict[str, int]]:
    out = {}
    for pair in PAIRS:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(pair)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b  # decoders for the web pass such bytes on as control characters
        out[pair] = table
    return out


_BYTES = _byte_tables()


def _due(byte: int) -> int:
    """Continuation bytes after a first byte of UTF-8, 0 if it is none."""
    return 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0


class GarbleModel:
    """The hidden Markov model, from counts of clean characters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        # Characters are counted among non-ASCII ones; UNSEEN is the floor.
        self.log = {c: math.log(max(n / total, UNSEEN)) for c, n in counts.items()}
        self.memory: dict[str, tuple[str, tuple[str, ...]]] = {}

    def _clean(self, c: str) -> float:
        return max(self.log.get(c, math.log(UNSEEN)), math.log(UNSEEN_LETTER if c.isalpha() else UNSEEN))

    def _restored(self, c: str, pair: str) -> float:
        return max(self.log.get(c, math.log(UNSEEN)), math.log(UNSEEN_AGAIN if c in _BYTES[pair] else UNSEEN), math.log(UNSEEN_LATIN if "\u00a1" <= c <= "\u017f" else UNSEEN))

    def label(self, run: str) -> list[tuple[int, int, str]]:
        """Viterbi: garbled spans (from, to, state) of a run of non-ASCII characters."""
        n = len(run)
        # Best score of a path that ends before character i with nothing due, by state; and where it came from.
        best: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(n + 1)]
        best[0]["clean"] = (0.0, 0, "")
        enter, stay = math.log(ENTER), math.log(STAY)

        def offer(i: int, state: str, score: float, start: int, before: str) -> None:
            if state not in best[i] or best[i][state][0] < score:
                best[i][state] = (score, start, before)

        for i in range(n):
            c = run[i]
            for before, (score, _, _) in list(best[i].items()):
                if c == "�":
                    offer(i + 1, "lost", score, i, before)
                    continue
                offer(i + 1, "clean", score + self._clean(c), i, before)
                for pair in PAIRS:
                    table = _BYTES[pair]
                    first = table.get(c)
                    due = _due(first) if first is not None else 0
                    if not due or i + due >= n:
                        continue
                    raw = [first, *(table.get(x, 0) for x in run[i + 1 : i + due + 1])]
                    try:
                        restored = bytes(raw).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    offer(i + due + 1, pair, score + (stay if before == pair else enter) + self._restored(restored, pair), i, before)
        spans, i = [], n
        state = max(best[n], key=lambda s: best[n][s][0])
        while i:
            _, start, before = best[i][state]
            if state != "clean":
                if spans and spans[-1][2] == state and spans[-1][0] == i:
                    spans[-1] = (start, spans[-1][1], state)
                else:
                    spans.append((start, i, state))
            i, state = start, before
        return spans[::-1]

    def restore_run(self, run: str) -> tuple[str, tuple[str, ...]]:
        """The restored run and the states of its garbled spans."""
        known = self.memory.get(run)
        if known is None:
            out, at, states = [], 0, []
            for start, end, state in self.label(run):
                span = run[start:end]
                if state != "lost":
                    span = bytes(_BYTES[state][c] for c in span).decode("utf-8")
                    span, again = self.restore(span)
                    states += [state, *again]
                else:
                    states.append(state)
                out += [run[at:start], span]
                at = end
            known = "".join([*out, run[at:]]), tuple(states)
            if len(self.memory) > 200_000:
                self.memory.clear()
            if len(run) < 200:
                self.memory[run] = known
        return known

    def restore(self, text: str) -> tuple[str, list[str]]:
        """The restored text and the states of all its garbled spans."""
        states: list[str] = []

        def one(m: re.Match) -> str:
            restored, found = self.restore_run(m.group())
            states.extend(found)
            return restored

        return _RUN.sub(one, text), states


def clean_counts(df: DataFrame, text: str) -> dict[str, int]:
    """How often each non-ASCII character stands between ASCII ones, over all texts: a row per distinct character."""
    alone = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<![^\x00-\x7F])([^\x00-\x7F])(?![^\x00-\x7F])"), F.lit(1))
    rows = df.where(F.col(f"`{text}`").rlike(r"[^\x00-\x7F]")).select(F.explode(alone).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def find_garbled(df: DataFrame, doc_id: str = "doc_id", text: str = "text", restored: bool = True) -> DataFrame:
    """Rows (doc_id, spans, lost, pairs, restored) of the texts with garbled spans; lost counts those that can't be restored."""
    model = df.sparkSession.sparkContext.broadcast(GarbleModel(clean_counts(df, text)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = model.value.restore
        for batch in it:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole, states = restore(t.as_py())
                if states:
                    rows.append((d, len(states), states.count("lost"), ",".join(sorted(set(states) - {"lost"})), whole if restored else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "spans", "lost", "pairs", "restored"])

    other = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return other.mapInArrow(batches, "doc_id long, spans long, lost long, pairs string, restored string")
