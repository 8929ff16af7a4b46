"""Operator 2, BPE encoding and decoding.

The encoding of a word is found by dynamic programming over its prefixes.
A suffix automaton of the vocabulary, fed the symbols of the word, gives all
tokens that end at each place.  Of these exactly one is the last token of
the prefix's encoding: the one that is compatible with the last token of the
prefix before it, where two tokens are compatible if their joined text
encodes to just these two.  Only that token is stored per prefix, and the
back-pointers give the ids.  Work is linear in the word (times the number of
tokens that can end at one place), whatever its length.

Merging proceeds by rank and, at equal rank, from the left.  Two tokens are
compatible if no merge across their border would come before both are
complete, which unfolds the merge that completed last, again and again.

Texts go through the file's own normalisation (composition, white space to
one space, lower case by character) and split pattern; the strings of
special tokens in a text are found first and become their ids.

Defined cases: a null text counts as empty and has no ids; rows that share
an id are rows of their own; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import whole_text

#: Distinct words and token pairs that a worker remembers.
WORDS_KEPT, PAIRS_KEPT = 500_000, 1_000_000
_END_SHIFT = 0x1000  # a symbol that ends a word, as one character
#: Anything but Latin letters and the usual dashes, quotes and signs.
_OTHER = re.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u203a\u20ac]")


class SuffixAutomaton:
    """All substrings of a set of strings; ``tokens[v]`` are the whole
    strings among those of state v, longest first, as (length, id)."""

    def __init__(self, strings: dict[str, int]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.tokens: list[list] = [[] for _ in self.next]
        for s, i in strings.items():
            v = 0
            for c in s:
                v = self.next[v][c]
            self.tokens[v].append((len(s), i))
        for found in self.tokens:
            found.sort(reverse=True)
        # nearest state on the way of suffix links that holds tokens
        self.up = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            p = self.link[v]
            self.up[v] = p if self.tokens[p] else self.up[p]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state for the strings of q that are as long as p and c."""
        half = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self._library = spec["model"], Tokenizer.from_file(path)
        self._suffix = model["end_of_word_suffix"] or ""
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self._byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

        vocab = model["vocab"]
        self.token = {i: t for t, i in (vocab | self._special).items()}
        self._name = {i: str(i) for i in self.token}
        self._merge: dict[tuple[int, int], int] = {}  # pair -> rank
        self._parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, (a, b) in enumerate(model["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self._merge.setdefault(pair, rank)
            self._parts.setdefault(whole, (rank, *pair))
        self._pairs: dict[int, bool] = {}
        reachable = {t: i for t, i in vocab.items() if i not in self._parts or self._compatible(self._parts[i][1], self._parts[i][2], self._parts[i][0], False)}
        self._automaton = SuffixAutomaton({self._symbols(t): i for t, i in reachable.items()})
        self._cache: dict[str, tuple[int, ...]] = {}

    def _symbols(self, token: str) -> str:
        """One character per symbol: the last of a word is shifted."""
        if self._suffix and token.endswith(self._suffix) and len(token) > len(self._suffix):
            core = token[: -len(self._suffix)]
            return core[:-1] + chr(_END_SHIFT + ord(core[-1]))
        return token

    def _compatible(self, left: int, right: int, limit: float = float("inf"), at_left: bool = True) -> bool:
        """Whether no merge across the border comes before ``limit``, the
        rank at which the later of the two sides is taken apart;
        ``at_left``: the border stands left of the merge with that rank."""
        parts, merge = self._parts, self._merge
        while True:
            rank = merge.get((left, right))
            if rank is not None and (rank < limit or rank == limit and at_left):
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # the merge of higher rank came last; of equal ones, the right
            if b is None or a is not None and a[0] > b[0]:
                limit, left, at_left = a[0], a[2], False
            else:
                limit, right, at_left = b[0], b[1], True

    def _follows(self, left: int, right: int) -> bool:
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs.clear()
        known = self._pairs[left << 32 | right] = self._compatible(left, right)
        return known

    def encode_symbols(self, s: str) -> tuple[int, ...]:
        """Ids of one word, given as symbols."""
        auto = self._automaton
        edges, link, length, tokens, up = auto.next, auto.link, auto.length, auto.tokens, auto.up
        pairs = self._pairs
        state = size = 0
        last: list[tuple[int, int]] = []  # per prefix: its last token and where that begins
        for j, c in enumerate(s):
            while state and c not in edges[state]:
                state = link[state]
                size = length[state]
            state, size = edges[state][c], size + 1
            v, room, found = state, size, None
            while found is None:
                for n, i in tokens[v]:
                    if n <= room:
                        begin = j + 1 - n
                        if begin:
                            before = last[begin - 1][0]
                            fits = pairs.get(before << 32 | i)
                            if fits is None:
                                fits = self._follows(before, i)
                        if not begin or fits:
                            found = (i, begin)
                            break
                else:
                    v = up[v]
                    room = length[v]
                    if not v:
                        raise ValueError("the vocabulary lacks a symbol of the word")
            last.append(found)
        out, at = [], len(s)
        while at:
            i, at = last[at - 1]
            out.append(i)
        return tuple(reversed(out))

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self._cache.get(word)
        if ids is None:
            if len(self._cache) > WORDS_KEPT:
                self._cache.clear()
            ids = self._cache[word] = self._mapped("".join(map(self._byte.__getitem__, word.encode())))
        return ids

    def _mapped(self, word: str) -> tuple[int, ...]:
        return self.encode_symbols(self._symbols(word + self._suffix))

    def _split(self, text: str) -> Iterable[tuple[int, ...]]:
        """Ids of each word of a text without special tokens."""
        if _OTHER.search(text) is None:  # nothing composes; the split drops white space
            return map(self._word, self._words.findall(text.lower()))
        # letter classes depend on the library's version of Unicode
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return (self._mapped(w) for w, _ in words)

    def encode(self, text: str) -> list[int]:
        parts = self._special_split.split(text) if self._special_split and "<|" in text else [text]
        out: list[int] = []
        for part in parts:
            if part in self._special:
                out.append(self._special[part])
            elif part:
                out.extend(chain.from_iterable(self._split(part)))
        return out

    def decode(self, ids) -> str:
        return " ".join(map(self.token.__getitem__, ids))

    def listed(self, ids) -> str:
        return " ".join(map(self._name.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


_COLUMNS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()),
            "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each text, decode its ids again: id and the columns asked for,
    out of n_tokens, ids, decoded, ids_sha256 (of the decimal ids joined by
    one space) and decoded_sha256."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = word_bpe(path)
        make = {"n_tokens": lambda ids: len(ids), "ids": lambda ids: ids, "decoded": bpe.decode,
                "ids_sha256": lambda ids: hashlib.sha256(bpe.listed(ids).encode()).hexdigest(),
                "decoded_sha256": lambda ids: hashlib.sha256(bpe.decode(ids).encode()).hexdigest()}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                for c in columns:
                    out[c].append(make[c](ids))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(out[c], _COLUMNS[c][1]) for c in columns)], ["row_id", *columns])

    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"row_id {id_type}, " + ", ".join(f"{c} {_COLUMNS[c][0]}" for c in columns)).withColumnRenamed("row_id", id_col)
