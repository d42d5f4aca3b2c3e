"""Token counts from a BPE vocabulary compiled to finite-state transducers.

Two deterministic transducers share the work:

* The *scanner* reads code-point classes and marks where pre-tokens start. It has five states, so a chunk of text of
  any content is a map of five states to five states. All chunks of a batch compute their maps at once; the maps compose
  (they form a monoid) by a parallel prefix scan, which gives every chunk its entry state without reading left to right.
* The *word* transducer reads the bytes of one pre-token. Its transitions carry the change of the number of tokens of
  the prefix read so far; the transition that reads the last byte adds the count of the word's end. It is compiled
  lazily: a state holds the open vocabulary prefixes, each with the token before it and the count there.

The second rests on a property of byte-pair encoding: a token sequence is the encoding of its text if and only if each
adjacent pair is the encoding of the pair's text. So the last token of each prefix follows from the ones before it.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, utf8_bytes

# Input classes and states of the scanner.
SPACE, LETTER, DIGIT, OTHER, QUOTE1, QUOTE2, RESET = range(7)
FREE, IN_LETTERS, IN_OTHER, LEFT2, LEFT1 = range(5)
CHUNK = 64
#: Code points of a batch that are scanned together; a longer text makes a batch of its own.
SCAN_POINTS = 1 << 20
#: Entries after which a worker's lazily compiled states and memoised words are dropped and built anew.
MAX_STATES, MAX_WORDS = 120_000, 150_000

# The white space of Unicode, and the endings that an apostrophe starts.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS1, ENDINGS2 = "stmd", ("re", "ve", "ll")

# Letters, digits and lower-case forms of Unicode 16, which the library knows and Python's tables may not.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_NEW_UPPER = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start-of-token mark, by state and class."""
    to, start = np.zeros((5, 7), np.uint8), np.zeros((5, 7), bool)
    goal = {SPACE: FREE, LETTER: IN_LETTERS, DIGIT: FREE, OTHER: IN_OTHER, QUOTE1: LEFT1, QUOTE2: LEFT2, RESET: FREE}
    for state in (FREE, IN_LETTERS, IN_OTHER):
        for kind, target in goal.items():
            to[state, kind], start[state, kind] = target, kind not in (SPACE, RESET)
    start[IN_LETTERS, LETTER] = False
    for kind in (OTHER, QUOTE1, QUOTE2):
        to[IN_OTHER, kind], start[IN_OTHER, kind] = IN_OTHER, False
    to[LEFT2], to[LEFT1] = LEFT1, FREE
    to[:, RESET] = FREE
    return to, start


TO, START = _scanner()


@cache
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(point))[0]
        if c == "L":
            kinds[point] = LETTER
        elif c == "N":
            kinds[point] = DIGIT
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_DIGITS, DIGIT)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    kinds[WHITE] = SPACE
    return kinds


def scan_maps(kinds: np.ndarray) -> np.ndarray:
    """State maps of the chunks, [chunk, state]; kinds: [chunk, position]."""
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (len(kinds), 5)).copy()
    for j in range(kinds.shape[1]):
        maps = TO[maps, kinds[:, j, None]]
    return maps


def prefix_compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps under composition, in log2(n) vector steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Marks where pre-tokens start."""
    n = len(kinds)
    grid = np.full((max(1, -(-n // CHUNK)), CHUNK), RESET, np.uint8)
    grid.reshape(-1)[:n] = kinds
    after = prefix_compose(scan_maps(grid))
    state = np.concatenate([[FREE], after[:-1, FREE]]).astype(np.uint8)
    marks = np.zeros(grid.shape, bool)
    for j in range(CHUNK):
        marks[:, j] = START[state, grid[:, j]]
        state = TO[state, grid[:, j]]
    return marks.reshape(-1)[:n]


# Odd multipliers of the two rolling hashes, modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


def distinct_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One span of each content, the content number of each span, and spans to be looked at one by one.

    Contents are told apart by a rolling hash; a second hash and the length check it, and spans that disagree with
    their representative are the third result, so a collision costs time and never a wrong count.
    """
    size = 1 << max(10, int(len(points)).bit_length())
    hashes = []
    for base in BASES:
        up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
        hashes.append((sums[ends] - sums[starts]) * down[starts])
    _, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
    size = ends - starts
    odd = np.flatnonzero((hashes[1] != hashes[1][first[which]]) | (size != size[first[which]]))
    return first, which, odd


class WordTransducer:
    """Counts the tokens of one pre-token; states are compiled when first reached."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.rank = {tuple(m if isinstance(m, (list, tuple)) else m.split(" ")): i for i, m in enumerate(merges)}
        self.suffix, self.symbol = suffix, byte_symbols()
        back = {s: b for b, s in self.symbol.items()}
        self.parts: dict[int, list[str]] = {}
        self.trie: list[tuple[dict[int, int], dict[int, int]]] = [({}, {})]  # children; tokens that end the word
        self.token: list[int] = [-1]
        for text, number in vocab.items():
            ends = bool(suffix) and text.endswith(suffix)
            body = text[: -len(suffix)] if ends else text
            if not body or any(c not in back for c in body):
                continue
            self.parts[number] = [*body[:-1], body[-1] + suffix * ends]
            if self.encode(self.parts[number]) != [text]:
                continue
            node = 0
            for c in body[:-1] if ends else body:
                node = self._child(node, back[c])
            if ends:
                self.trie[node][1][back[body[-1]]] = number
            else:
                self.token[node] = number
        self.pairs: dict[tuple[int, int], bool] = {}
        self.text = {number: text for text, number in vocab.items()}
        self.reset()

    def _child(self, node: int, byte: int) -> int:
        found = self.trie[node][0].get(byte)
        if found is None:
            found = self.trie[node][0][byte] = len(self.trie)
            self.trie.append(({}, {}))
            self.token.append(-1)
        return found

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, the leftmost first; used on single tokens and pairs while compiling."""
        parts, rank = list(symbols), self.rank
        while True:
            least, best = 1 << 60, -1
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                r = rank.get(pair)
                if r is not None and r < least:
                    least, best = r, i
            if best < 0:
                return parts
            parts[best : best + 2] = [parts[best] + parts[best + 1]]

    def fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            found = self.encode(self.parts[left] + self.parts[right]) == [self.text[left], self.text[right]]
            self.pairs[left, right] = found
        return found

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition that reads a byte inside the word: next state, change of the count."""
        grown, last, count = [], -1, 0
        for node, before, at in self.states[state]:
            child = self.trie[node][0].get(byte)
            if child is None:
                continue
            if last < 0 and self.token[child] >= 0 and self.fits(before, self.token[child]):
                last, count = self.token[child], at + 1
            if self.trie[child][0] or self.trie[child][1]:
                grown.append((child, before, at))
        entries = (*((node, before, at - count) for node, before, at in grown), (0, last, 0))
        target = self.number.get(entries)
        if target is None:
            target = self.number[entries] = len(self.states)
            self.states.append(entries)
        self.moves[state << 8 | byte] = target, count
        return target, count

    def end(self, state: int, byte: int) -> int:
        """Compile the transition that reads the word's last byte."""
        for node, before, at in self.states[state]:
            number = self.trie[node][1].get(byte) if self.suffix else self._plain(node, byte)
            if number is not None and self.fits(before, number):
                self.ends[state << 8 | byte] = at + 1
                return at + 1
        raise ValueError("the vocabulary has no token for a byte")

    def _plain(self, node: int, byte: int) -> int | None:
        child = self.trie[node][0].get(byte)
        return None if child is None or self.token[child] < 0 else self.token[child]

    def count(self, word: bytes) -> int:
        state = total = 0
        moves = self.moves
        for byte in word[:-1]:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            state = found[0]
            total += found[1]
        found = self.ends.get(state << 8 | word[-1])
        if found is None:
            found = self.end(state, word[-1])
        if len(self.states) > MAX_STATES:
            self.reset()
        return total + found


def byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others start at 256."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter:
    """Counts of whole texts under one tokenizer description (lower-casing BPE with word ends)."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model = spec["model"]
        self.words = WordTransducer(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if not text.isascii() and _NEW_UPPER.search(text):
            text = text.translate(NEW_LOWER)
        return text.replace("Σ", "σ").lower()

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        out: list[int] = []
        pieces: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            out.append(0)
            text = text or ""
            parts = [text]
            if self.special and "<" in text:
                parts = self.special.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                pieces.append(self.normal(part))
                owners.append(i)
                size += len(pieces[-1])
            if size >= SCAN_POINTS:
                self._scan(pieces, owners, out)
                pieces, owners, size = [], [], 0
        if pieces:
            self._scan(pieces, owners, out)
        return out

    def word(self, word: str) -> int:
        n = self.memo.get(word)
        if n is None:
            if len(self.memo) >= MAX_WORDS:
                self.memo.clear()
            n = self.memo[word] = self.words.count(word.encode("utf-8", "surrogatepass"))
        return n

    def _scan(self, pieces: list[str], owners: list[int], out: list[int]) -> None:
        flat = "\n".join(pieces)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[points]
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        kinds[ends[:-1]] = RESET
        quotes = np.flatnonzero(points == 0x27)
        for q in quotes.tolist():
            # The look-ahead is part of the input symbol; a piece's end stops it, as no ending has a line break.
            if flat[q + 1 : q + 2] and flat[q + 1] in ENDINGS1:
                kinds[q] = QUOTE1
            elif flat[q + 1 : q + 3] in ENDINGS2:
                kinds[q] = QUOTE2
        marks = token_starts(kinds)
        # A pre-token ends where the next one starts or at a space; spaces inside the gap are cut off the slice's end.
        starts = np.flatnonzero(marks)
        if not len(starts):
            return
        gaps = (kinds == SPACE) | (kinds == RESET)
        stop = np.append(np.flatnonzero(gaps), len(flat))
        nearest = stop[np.searchsorted(stop, starts)]
        finish = np.minimum(np.append(starts[1:], len(flat)), nearest)
        first, which, odd = distinct_spans(points, starts, finish)
        found = np.array([self.word(flat[a:b]) for a, b in zip(starts[first].tolist(), finish[first].tolist(), strict=True)], np.int64)
        counts = found[which]
        for k in odd.tolist():
            counts[k] = self.word(flat[starts[k] : finish[k]])
        piece = np.searchsorted(ends, starts)
        sums = np.bincount(piece, counts, len(pieces)).astype(np.int64).tolist()
        for owner, n in zip(owners, sums, strict=True):
            out[owner] += n


@cache
def _counter(path: str) -> TokenCounter:
    with open(path, encoding="utf-8") as f:
        return TokenCounter(f.read())


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit for every whole text.

    vocabulary: path of a tokenizer description (.json), installed at the same place on every machine; it is parameter
    data, read once by each Python worker. A null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens
    inside a text count as one token each, as the library's default does. Repeated rows stay; other columns stay, and
    columns of the same names as the new ones are replaced. An empty table gives an empty table.
    """
    need(docs, text_col)
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(vocabulary)
        for texts in batches:
            yield pd.Series(counter.counts(texts), dtype="int64")

    return docs.select(*keep, utf8_bytes(text_col).alias("n_bytes"), tokens(F.col(text_col)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
