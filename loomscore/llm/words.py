"""Words of many documents side by side: hashes, repeats, n-gram buckets."""

from __future__ import annotations

import struct

import numpy as np
import xxhash

WINDOW = 8
MARKS = b".,;:!?\"'()[]{}"
#: Words held with their hashes.
HELD = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Codes(dict):
    """64-bit hashes of words: of the word itself, and of its form (lower-cased, without marks at its ends)."""

    def __missing__(self, word: bytes) -> bytes:
        code = struct.pack("<QQ", xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word.lower().strip(MARKS), 1))
        if len(word) < 64:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> bytes:
        if len(self) > HELD:
            self.clear()
        return b"".join(map(self.__getitem__, words))


class Words:
    """``split``: each text's runs without ASCII white space; ``own``, ``form``: their hashes, all texts in a row."""

    def __init__(self, texts: list[bytes], codes: Codes):
        self.split = [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in self.split], np.int64)
        pairs = np.frombuffer(b"".join([codes.of(w) for w in self.split]), np.uint64).reshape(-1, 2)
        self.own, self.form = pairs[:, 0], pairs[:, 1]
        self.text = np.repeat(np.arange(len(texts)), self.lengths)

    def repeat_words(self) -> np.ndarray:
        """For each text, the words in windows of WINDOW words that it has twice or more."""
        out = np.zeros(len(self.split), np.int64)
        if len(self.own) < WINDOW:
            return out
        h, step = self.own, 1
        while step < WINDOW:
            h = (h[:-step] * _MIX) ^ (h[:-step] >> np.uint64(31)) ^ (h[step:] * _MIX2 + h[step:])
            step *= 2
        inside = self.text[: len(h)] == self.text[WINDOW - 1 :]
        h, of = h[inside] ^ self.text[: len(h)][inside].astype(np.uint64) * _MIX2, self.text[: len(h)][inside]
        order = np.argsort(h, kind="stable")
        s = h[order]
        starts = np.concatenate([[0], np.cumsum(self.lengths)])
        for k in np.unique(of[order[1:][s[1:] == s[:-1]]]).tolist():
            out[k] = exact_repeats(self.own[starts[k] : starts[k + 1]])
        return out

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words and pairs of adjacent words, and the text of each."""
        same = self.text[1:] == self.text[:-1]
        pairs = self.form[:-1] * _MIX ^ (self.form[1:] >> np.uint64(7)) * _MIX2
        pairs = (pairs ^ pairs >> np.uint64(29))[same]
        found = (np.concatenate([self.form, pairs]) >> np.uint64(24)).astype(np.int64) & (buckets - 1)
        return found, np.concatenate([self.text, self.text[:-1][same]])


def exact_repeats(codes: np.ndarray) -> int:
    """As ``repeat_words``, of one text; windows of 1, 2, 4, 8 words are numbered, so none are taken for another."""
    ids = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < WINDOW:
        ids = np.unique(ids[:-step] * (len(codes) + 1) + ids[step:], return_inverse=True)[1].astype(np.int64)
        step *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())
