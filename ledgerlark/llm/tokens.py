"""Byte-level BPE encoding of a whole corpus by depth-first traversal of a trie of its distinct words.

Each batch of texts is cut into words by the tokenizer's pattern. The distinct words new to the worker are
visited in byte order, which is the depth-first order of their trie: the path from the root to the current
word is a stack, and a word pops back to the prefix it shares with the one before. Each node keeps one state,
the last token of its prefix's encoding. A prefix ends in exactly one token that may follow the last token
before it, so a node's state follows from its ancestors' and the encodings of shared prefixes are made once.
A word's ids are read back along the stack. There is no shuffle: the work is in proportion to the text.

Whether token b may follow token a (that is, whether encoding their joined bytes gives back a, b) is decided
by undoing merges from the newer side until a merge across the border would have come first, or not.

Defined cases: a null text and an empty text have no tokens (an empty list); strings that look like special
tokens are ordinary text; texts of any length are encoded whole; a null id is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the pattern by which this family of vocabularies cuts a text into words.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words that a worker keeps encoded between batches; beyond it the memory is emptied, which changes no result.
MEMORY_WORDS = 400_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return table


class Vocabulary:
    """Tokens by bytes, and the two parts each token was merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.id_of: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        self.length: dict[int, int] = {i: len(t) for t, i in self.id_of.items()}
        self.longest = max(self.length.values())
        self.rank: dict[int, int] = {i: -1 for t, i in self.id_of.items() if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            i, l, r = self.id_of[a + b], self.id_of[a], self.id_of[b]
            self.merged[l, r] = n
            if i not in self.parts:
                self.parts[i], self.rank[i] = (l, r), n
        self.id_of = {t: i for t, i in self.id_of.items() if i in self.rank}
        self._may: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a, b is what encoding their joined bytes gives."""
        known = self._may.get(a << 20 | b)
        if known is None:
            known = self._may[a << 20 | b] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        rank, parts, merged = self.rank, self.parts, self.merged
        # made_a, made_b: when the token to the left, right of the border stopped being the outermost one.
        until = float("inf")
        while True:
            n = merged.get((a, b))
            if n is not None and n < until:
                return False
            # Undo the newer of the two; on equal ranks the left occurrence was merged first.
            if rank[a] > rank[b]:
                until = rank[a]
                a = parts[a][1]
            elif rank[b] >= 0:
                until = rank[b] + 0.5  # a merge of the same rank across the border lies further left and comes first
                b = parts[b][0]
            else:
                return True


class TrieEncoder:
    """Encodes sets of words in depth-first order of their trie."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of every word; ``words`` needs no order."""
        v = self.vocabulary
        id_of, length, longest, may_follow = v.id_of, v.length, v.longest, v.may_follow
        out: dict[bytes, list[int]] = {}
        state: list[int] = [-1]  # state[i]: last token of the current word's first i bytes
        before = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = id_of.get(word[start:end])
                    if token is not None and (start == 0 or may_follow(state[start], token)):
                        state.append(token)
                        break
            ids, at = [], len(word)
            while at:
                ids.append(state[at])
                at -= length[state[at]]
            ids.reverse()
            out[word] = ids
            before = word
        return out


_encoders: dict[str, TrieEncoder] = {}
_memory: dict[str, dict[str, list[int]]] = {}
_word = regex.compile(WORD_PATTERN)


def encode_texts(texts: list[str | None], path: str = DEFAULT_VOCABULARY) -> list[list[int]]:
    """Ids of each text."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, TrieEncoder(path))
    memory = _memory.setdefault(path, {})
    cut = [_word.findall(t) if t else [] for t in texts]
    new = {w for words in cut for w in words if w not in memory}
    if new:
        by_bytes = {w.encode("utf-8"): w for w in new}
        for raw, ids in encoder.encode(list(by_bytes)).items():
            memory[by_bytes[raw]] = ids
    out = [[i for w in words for i in memory[w]] for words in cut]
    if len(memory) > MEMORY_WORDS or sum(map(len, new)) > 50_000_000:
        memory.clear()
        encoder.vocabulary._may.clear()
    return out


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, at_once: int = 256) -> DataFrame:
    """Rows (doc_id, ids) of every text, with ids by the vocabulary at ``path``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                ids = encode_texts(part.column(1).to_pylist(), path)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(batches, "doc_id long, ids array<int>")
