"""Counts of the terms of texts, for a batch of texts at once: words of two or more characters, pairs of neighbouring ones, and
character n-grams within a word that has a space on either side.

A term is named by a 64-bit code, so that a task needs no strings to look it up.  Each distinct word of a batch is cut into n-grams
once; code points are handled as one array, so nothing runs per n-gram.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD, CHARACTERS = 0, 1
BLOCKS = ("word", "char")
GRAMS = (2, 3, 4)
_WORDS = re.compile(r"\w{2,}")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _STEP + second)


def gram_codes(padded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams of padded words, which word each is of, and its first character's place among all characters."""
    text = "".join(padded)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in padded], np.int64)
    start, end = np.cumsum(length) - length, np.repeat(np.cumsum(length), length)
    owner, place = np.repeat(np.arange(len(padded)), length), np.arange(len(points))
    codes, owners, places = [], [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = place[: len(value)] + n <= end[: len(value)]
            codes.append(mixed(value[inside] ^ np.uint64(n)))
            owners.append(owner[: len(value)][inside])
            places.append(place[: len(value)][inside])
    return tuple(np.concatenate(x) for x in (codes, owners, places)) if len(start) else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))


def term_code(block: str, term: str) -> int:
    """The code of one term."""
    if block == "word":
        words = word_codes(term.split(" "))
        return int(words[0] if len(words) == 1 else pair_codes(words[:1], words[1:])[0])
    return int(gram_codes([term])[0][-1])


class Terms:
    """The distinct terms of a batch: ``codes`` and their ``block``; and (row, term, count) of each text's terms."""

    def __init__(self, texts: list[str | None], known: np.ndarray | None = None):
        """``known``: sorted codes; other terms are left out."""
        lowered = [(t or "").lower() for t in texts]
        rows_w, words, place_w = self._occurrences([_WORDS.findall(t) for t in lowered])
        single = word_codes(words)
        together = np.flatnonzero(rows_w[1:] == rows_w[:-1])
        pairs = pair_codes(single[place_w[together]], single[place_w[together + 1]])
        rows_c, spoken, place_c = self._occurrences([t.split() for t in lowered])
        grams, owner, _ = gram_codes([f" {w} " for w in spoken])
        # terms are looked up once per distinct word, pair and n-gram of a distinct word, and then dealt out to the texts
        if known is None:
            self.codes, index, term = np.unique(np.concatenate([single, pairs, grams]), return_index=True, return_inverse=True)
            self.block = np.where(index < len(single) + len(pairs), WORD, CHARACTERS)
        else:
            self.codes = known
            at, found = _find(known, np.concatenate([single, pairs, grams]))
            term = np.where(found, at, -1)
        of_word, of_pair, of_gram = np.split(term, [len(single), len(single) + len(pairs)])
        order = np.argsort(owner, kind="stable")
        order = order[of_gram[order] >= 0]
        size = np.bincount(owner[order], minlength=len(spoken))
        of_gram, first = of_gram[order], np.cumsum(size) - size
        per, times = np.unique(rows_c * max(len(spoken), 1) + place_c, return_counts=True)
        row, word = per // max(len(spoken), 1), per % max(len(spoken), 1)
        many = size[word]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[word], many)
        rows = np.concatenate([rows_w, rows_w[together], np.repeat(row, many)])
        term = np.concatenate([of_word[place_w], of_pair, of_gram[at]])
        count = np.concatenate([np.ones(len(rows_w) + len(together), np.int64), np.repeat(times, many)])
        there = term >= 0
        self.row, self.term, self.count = _summed(rows[there], term[there], count[there], max(len(self.codes), 1))

    @staticmethod
    def _occurrences(lists: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Row of each word, the distinct words, and which of them each is."""
        index: dict[str, int] = {}
        place = np.fromiter((index.setdefault(w, len(index)) for ws in lists for w in ws), np.int64)
        return np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]), list(index), place


def _summed(row: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, term) once, with its counts added up, in order."""
    key = row * terms + term
    if not len(key):
        return key, key, count
    bits = 20
    if count.max() < 1 << bits and key.max() < 1 << (63 - bits):  # one sort of plain numbers, key before count
        packed = np.sort(key << bits | count)
        key, count = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(key)
        key, count = key[order], count[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new] // terms, key[new] % terms, np.add.reduceat(count, new)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the key there is the wanted one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def named(texts: list[str | None], codes: np.ndarray) -> dict[int, tuple[str, str]]:
    """Block and text of those of the (sorted) codes that stand in the texts."""
    out: dict[int, tuple[str, str]] = {}
    for text in texts:
        words = _WORDS.findall((text or "").lower())
        spoken = list(dict.fromkeys((text or "").lower().split()))
        if words:
            single = word_codes(words)
            pairs = pair_codes(single[:-1], single[1:])
            for found, terms in ((single, words), (pairs, None)):
                for k in np.flatnonzero(_find(codes, found)[1]).tolist():
                    out.setdefault(int(found[k]), ("word", terms[k] if terms else f"{words[k]} {words[k + 1]}"))
        if spoken:
            padded = [f" {w} " for w in spoken]
            grams, owner, place = gram_codes(padded)
            joined = "".join(padded)
            size = np.concatenate([np.full(sum(max(len(w) - n + 1, 0) for w in padded), n) for n in GRAMS])
            for k in np.flatnonzero(_find(codes, grams)[1]).tolist():
                out.setdefault(int(grams[k]), ("char", joined[place[k] : place[k] + size[k]]))
    return out
