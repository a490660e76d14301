"""Byte-level BPE: encoding by contiguous rank arrays, and decoding.

``encode`` and ``decode`` are DataFrame operators; ``ByteBpe`` does the work
inside a task.  Ids are kept as bytes, four for each id, little-endian.

A text is first cut into pieces by the tokenizer's own pattern.  A piece's
bytes are the first parts; the piece holds the ranks of all adjacent pairs in
one contiguous array.  The smallest rank is found by a scan, its boundary is
deleted, and the ranks of the two neighbours are looked up anew, until no pair
is in the merge table.  Many short pieces go through these steps side by side,
as the rows of one matrix; a long piece, for which scans would be quadratic,
takes a heap of ranks over linked parts.  Results of short pieces are held in
a cache of bounded size.

Nulls are encoded like empty texts (no ids); null ids decode to an empty text.
Rows keep their other columns and repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import batches

# The piece pattern of byte-level BPE as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than the space and the line feed.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Pieces of more bytes take the heap.
SHORT = 96
#: Cells of one matrix of parts.
CELLS = 1 << 18
#: Ids that are decoded side by side, if a single text has no more.
TOGETHER = 1 << 17
#: Bytes of texts that ``round_trip`` has in hand: chunks of the text, as strings in lists, take some twelve times as much.
TEXT_BYTES = 1 << 20
#: Entries of each generation of a cache.
CACHED = 60_000
NONE = np.int32((1 << 31) - 1)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 60), np.append(order, 0).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pieces = Cache()  # by piece
        self.chunks = Cache()  # by what follows a space, up to the next one

    # -- ranks ---------------------------------------------------------------

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where the table has no such pair."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most SHORT bytes, side by side."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start) * len(words[order[end]]) < CELLS:
                end += 1
            self._merge_block(words, order[start:end], out)
            start = end
        return out

    def _merge_block(self, words: list[bytes], rows: list[int], out: list[bytes]) -> None:
        size = np.array([len(words[i]) for i in rows], np.int64)
        width = int(size.max())
        parts = np.zeros((len(rows), width), np.int32)
        parts[np.arange(width) < size[:, None]] = self.first[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        ranks = np.full((len(rows), width), NONE)
        inside = np.arange(width - 1) < size[:, None] - 1
        ranks[:, :-1][inside] = self.rank(parts[:, :-1][inside], parts[:, 1:][inside])
        live = np.arange(len(rows))
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            go = best < NONE
            if not go.all():
                done, many = live[~go].tolist(), size[~go]
                flat = parts[~go][np.arange(parts.shape[1]) < many[:, None]].astype("<u4").tobytes()
                stop = np.cumsum(many * 4).tolist()
                for k, a, b in zip(done, [0, *stop], stop, strict=False):
                    out[rows[k]] = flat[a:b]
                live, parts, ranks, size, at, best = live[go], parts[go], ranks[go], size[go], at[go], best[go]
                if not len(live):
                    return
            # delete the boundary after part `at`
            n, cells = np.arange(len(at)), np.arange(parts.shape[1] - 1)
            parts[n, at] = self.made[best]
            parts = np.take_along_axis(parts, cells + (cells > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, cells + (cells >= at[:, None]), 1)
            size = size - 1
            # refresh the ranks on both sides of the new part
            k = n[at > 0]
            ranks[k, at[k] - 1] = self.rank(parts[k, at[k] - 1], parts[k, at[k]])
            k = n[at + 1 < size]
            ranks[k, at[k]] = self.rank(parts[k, at[k]], parts[k, at[k] + 1])
            k = n[at + 1 >= size]
            k = k[at[k] < ranks.shape[1]]
            ranks[k, at[k]] = NONE

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word in O(n log n)."""
        parts = self.first[np.frombuffer(word, np.uint8)]
        ranks = self.rank(parts[:-1], parts[1:])
        heap = [(int(ranks[i]), i) for i in np.flatnonzero(ranks < NONE)]
        heapq.heapify(heap)
        part, n = parts.tolist(), len(parts)
        now: list[int] = [*ranks.tolist(), int(NONE)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = nxt[i]
            part[i], now[j], nxt[i] = int(self.made[r]), -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            part[j] = -1
            for a in (prv[i], i):
                if a < 0:
                    continue
                b = nxt[a]
                now[a] = int(self.rank(np.array([part[a]]), np.array([part[b]]))[0]) if b < n else int(NONE)
                if now[a] < NONE:
                    heapq.heappush(heap, (now[a], a))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    # -- pieces --------------------------------------------------------------

    def learn_pieces(self, pieces: set[str]) -> None:
        self.pieces.turn()
        new = self.pieces.missing(pieces)
        raw = [p.encode() for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= SHORT]
        for i, ids in zip(short, self.merge_short([raw[i] for i in short]), strict=True):
            self.pieces[new[i]] = ids
        for i, r in enumerate(raw):
            if len(r) > SHORT:
                self.pieces[new[i]] = self.merge_long(r)

    def encode_all(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, cut into pieces by the pattern itself."""
        cut = [self.pattern.findall(p) for p in parts]
        self.learn_pieces(set().union(*cut))
        ids = [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        self.pieces.forget_long(set().union(*cut))
        return ids

    def learn_chunks(self, chunks: set[str]) -> None:
        """A chunk of letters is one piece with its space; marks that end it are another. Others take the pattern."""
        plain: list[tuple[str, str, str]] = []
        rest: list[str] = []
        for c in self.chunks.missing(chunks):
            core = c.rstrip(PUNCTUATION)
            if core.isalpha():
                plain.append((c, " " + core, c[len(core) :]))
            else:
                rest.append(c)
        self.learn_pieces({p[1] for p in plain} | {p[2] for p in plain if p[2]})
        pieces = self.pieces
        for c, core, marks in plain:
            self.chunks[c] = pieces[core] + pieces[marks] if marks else pieces[core]
        pieces.forget_long({p[1] for p in plain} | {p[2] for p in plain})
        self.chunks.update(zip(rest, self.encode_all([" " + c for c in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes.

        Where spaces are single and line feeds are the only other white space,
        no piece spans a space other than at its start.  So a text is the sum
        of its first chunk and of a space with each further chunk, and those
        come from a cache.  Other texts go through the pattern whole.
        """
        out: list[bytes] = [b""] * len(texts)
        whole: list[tuple[int, str | int]] = []
        easy: list[tuple[int, list[str]]] = []
        unseen: set[str] = set()
        for i, text in enumerate(texts):
            if self.cut and "<|" in text and self.cut.search(text):
                whole += [(i, self.special.get(p, p)) for p in self.cut.split(text) if p]
            elif "  " in text or OTHER_SPACE.search(text):
                whole.append((i, text))
            elif text:
                chunks = text.split(" ")
                whole.append((i, chunks[0]))
                unseen.update(chunks[1:])
                easy.append((i, chunks))
        self.chunks.turn()
        self.learn_chunks(unseen)
        ids = iter(self.encode_all([p for _, p in whole if isinstance(p, str)]))
        for i, p in whole:
            out[i] += next(ids) if isinstance(p, str) else p.to_bytes(4, "little")
        for i, chunks in easy:
            chunks[0] = ""
            out[i] += b"".join(map(self.chunks.__getitem__, chunks[1:]))
        self.chunks.forget_long(unseen)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 of the texts; bytes that aren't UTF-8 become U+FFFD, ids outside the table vanish."""
        out: list[bytes] = []
        start = 0
        while start < len(ids):
            end, held = start + 1, len(ids[start])
            while end < len(ids) and held + len(ids[end]) <= 4 * TOGETHER:
                held += len(ids[end])
                end += 1
            out += self._decode_some(ids[start:end])
            start = end
        return out

    def _decode_some(self, ids: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        size = np.where(flat < len(self.lengths), self.lengths[np.minimum(flat, len(self.lengths) - 1)], 0)
        stops = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(stops[-1], dtype=np.int64) + np.repeat(self.starts[np.minimum(flat, len(self.lengths) - 1)] - stops[:-1], size)
        raw = self.blob[source].tobytes()
        cut = [raw[stops[a] : stops[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x.decode("utf-8", "replace").encode() for x in cut]


class Cache(dict):
    """A dict of bounded size: a full generation is kept, and dropped when the next one is full."""

    def __init__(self, size: int = CACHED) -> None:
        super().__init__()
        self.old: dict = {}
        self.size = size

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """Those of ``keys`` without a value; all others are ready for lookups until the next turn."""
        new = keys.difference(self)
        again = self.old.keys() & new
        self.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return list(new - again)

    def forget_long(self, keys: set) -> None:
        """Drop those of ``keys`` with more than SHORT letters, so that the cache's size is bounded in bytes too."""
        if max(map(len, keys), default=0) > SHORT:
            for k in keys:
                if len(k) > SHORT:
                    self.pop(k, None)


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """One table and cache for each Python worker, kept from task to task."""
    return ByteBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """``df`` with the ids of ``text`` in binary column ``ids`` (an existing one is replaced)."""
    return batches.append(df, text, ids, T.BinaryType(), lambda: lambda v: loaded(path).encode(batches.texts(v)), (text,) if drop_text else ())


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in string column ``decoded`` (an existing one is replaced)."""

    def factory():
        bpe = loaded(path)
        return lambda v: [x.decode() for x in bpe.decode([i or b"" for i in v])]

    return batches.append(df, ids, decoded, T.StringType(), factory)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop_text: bool = False) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task has one Python worker in place of two."""

    def factory():
        bpe = loaded(path)

        def both(v: list) -> list[list]:
            found = bpe.encode(batches.texts(v))
            return [found, [x.decode() for x in bpe.decode(found)]]

        return both

    return batches.append_all(df, text, {ids: T.BinaryType(), decoded: T.StringType()}, factory, (text,) if drop_text else (), TEXT_BYTES)
