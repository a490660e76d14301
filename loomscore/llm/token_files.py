"""Token ids in binary files of patched frame-of-reference blocks.

A *segment* is one self-contained byte string:

    magic "LPF1", block size, documents, documents without an id, ids,
    position of its first id in its shard, blocks            (header)
    document ids, int64 each; documents' lengths, uint32 each
    start of each block in what follows, uint32 each         (block index)
    blocks: minimum (uint32), width (uint8), values (uint16),
            exceptions (uint16), values less the minimum packed at the
            width, positions of exceptions (uint16 each), their full
            values less the minimum (uint32 each)

The width of a block is the bit length of a percentile of its values less the
minimum; larger values are exceptions, stored whole in its exception list.

``write`` puts segments, as rows of a Parquet table that any store can hold,
into shards by ascending document id; ``read`` gives the ids back with each
document's place in the whole.  A shard is a range of document ids.  Only the
shards' bounds and totals, one row for each, pass through a single task or a
broadcast, and the number of shards is a parameter.

Null texts count as empty ones (only the end id is stored); documents without
an id come first; equal ids stand in the order of their tokens; other columns
are ignored; texts are taken whole whatever their length; an empty table gives
no segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import batches
from .bpe import Cache

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = b"LPF1"
HEADER = struct.Struct("<4sIIIQQI")
BLOCK = struct.Struct("<IBHH")
BLOCK_IDS, SEGMENT_IDS, PERCENTILE, MAX_SHARDS = 256, 1 << 19, 90, 100_000
#: Entries of each generation of a cache of ids; rows of which the different words are looked up together.
HELD, ROWS = 600_000, 700
# Letters that normal forms leave alone and lower-casing treats one by one.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
WORD = re.compile(LETTERS)
#: Runs of such letters that another ASCII character or the end follows, so that a piece ends there; and what else is without white space.
UNITS = re.compile(LETTERS + r"(?=[\x00-@\[-`{-\x7f]|\Z)|\S+")
#: What \\s is in UNITS but the tokenizer's pattern doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# The set-up of a tokenizer whose pieces never span white space, as its file spells it.
SEPARABLE = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


# -- segments ----------------------------------------------------------------


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.left_shift(np.int64(1), np.arange(33)), x, side="right")


def pack_blocks(ids: np.ndarray, size: int = BLOCK_IDS, percentile: int = PERCENTILE) -> list[bytes]:
    """One byte string for each ``size`` ids (the last may be shorter)."""
    full = len(ids) // size
    out = _pack(ids[: full * size].reshape(full, size), percentile) if full else []
    return out + (_pack(ids[full * size :].reshape(1, -1), percentile) if len(ids) % size else [])


def _pack(rows: np.ndarray, percentile: int) -> list[bytes]:
    n = rows.shape[1]
    low = rows.min(1)
    rest = rows.astype(np.int64) - low[:, None]
    widths = bit_length(np.partition(rest, k := min(n - 1, n * percentile // 100), 1)[:, k])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        part = rest[which]
        over = part >> width > 0
        body = packed_bits(np.where(over, 0, part), width)
        size, packed = body.shape[1], body.tobytes()
        row, at = np.nonzero(over)
        cuts = np.searchsorted(row, np.arange(len(which) + 1)).tolist()
        places, values = at.astype("<u2").tobytes(), part[over].astype("<u4").tobytes()
        for k, (i, base) in enumerate(zip(which.tolist(), low[which].tolist(), strict=True)):
            a, z = cuts[k], cuts[k + 1]
            out[i] = b"".join((BLOCK.pack(base, width, n, z - a), packed[k * size : (k + 1) * size], places[2 * a : 2 * z], values[4 * a : 4 * z]))
    return out


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values of ``width`` bits each, highest bit first, as rows of bytes: eight values fill ``width`` bytes."""
    rows, n = values.shape
    eights = np.zeros((8, rows, -(-n // 8)), np.int64)
    for k in range(min(8, n)):
        eights[k, :, : len(range(k, n, 8))] = values[:, k::8]
    out = np.zeros((rows, eights.shape[2], width), np.uint8)
    for j in range(width):
        for k in range(8 * j // width, (8 * j + 7) // width + 1):  # values with bits in byte j
            shift = 8 * (j + 1) - width * (k + 1)
            out[:, :, j] |= (eights[k] << shift if shift >= 0 else eights[k] >> -shift).astype(np.uint8)
    return out.reshape(rows, -1)[:, : (n * width + 7) // 8]


def unpacked_bits(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The ``n`` values of each row of ``packed_bits``."""
    rows, groups = len(raw), -(-n // 8)
    held = np.zeros((rows, groups * width), np.uint8)
    held[:, : raw.shape[1]] = raw
    held = np.ascontiguousarray(held.reshape(rows, groups, width).transpose(2, 0, 1)).astype(np.int64)
    out = np.zeros((rows, groups, 8), np.int64)
    for k in range(8 if width else 0):
        first, last = width * k // 8, (width * (k + 1) - 1) // 8
        value = held[first] & ((1 << 8 * (first + 1) - width * k) - 1)
        for j in range(first + 1, last + 1):
            value = value << 8 | held[j]
        out[:, :, k] = value >> 8 * (last + 1) - width * (k + 1)
    return out.reshape(rows, -1)[:, :n]


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    heads = [BLOCK.unpack_from(b) for b in blocks]
    stops = np.cumsum([0, *(h[2] for h in heads)])
    out = np.zeros(stops[-1], np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, width, n, _) in enumerate(heads):
        groups.setdefault((width, n), []).append(i)
    for (width, n), which in groups.items():
        size = (n * width + 7) // 8
        raw = np.frombuffer(b"".join([blocks[i][BLOCK.size : BLOCK.size + size] for i in which]), np.uint8).reshape(len(which), size)
        values = unpacked_bits(raw, width, n)
        odd = [heads[i][3] for i in which]
        at = np.frombuffer(b"".join([blocks[i][BLOCK.size + size : BLOCK.size + size + 2 * k] for i, k in zip(which, odd, strict=True)]), "<u2")
        values[np.repeat(np.arange(len(which)), odd), at] = np.frombuffer(b"".join([blocks[i][BLOCK.size + size + 2 * k :] for i, k in zip(which, odd, strict=True)]), "<u4")
        values += np.array([heads[i][0] for i in which], np.int64)[:, None]
        starts = stops[which]
        out[(starts[:, None] + np.arange(n)).ravel()] = values.ravel()
    return out


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> bytes:
    """``doc_ids`` ascending, null ones first."""
    blocks = pack_blocks(np.concatenate(ids)) if ids else []
    index = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4").tobytes()
    none = sum(d is None for d in doc_ids)
    head = HEADER.pack(MAGIC, BLOCK_IDS, len(doc_ids), none, sum(map(len, ids)), first, len(blocks))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(i) for i in ids], "<u4").tobytes(), index, *blocks])


class Segment:
    """A view of a segment; ``ids`` decodes only the blocks that a range needs."""

    def __init__(self, raw: bytes):
        magic, self.size, docs, none, self.n_ids, self.first, blocks = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = HEADER.size
        self.doc_ids: list[int | None] = [None] * none + np.frombuffer(raw, "<i8", docs, at).tolist()[none:]
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
        self.index = np.frombuffer(raw, "<u4", blocks, at + 12 * docs).astype(np.int64)
        self.raw, self.base = raw, at + 12 * docs + 4 * blocks

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int64)
        a, b = start // self.size, (stop + self.size - 1) // self.size
        ends = [*self.index[1:], len(self.raw) - self.base]
        found = unpack_blocks([self.raw[self.base + self.index[i] : self.base + ends[i]] for i in range(a, b)])
        return found[start - a * self.size : stop - a * self.size]


# -- the library's ids -------------------------------------------------------


def places_of_none(values: list) -> list[int]:
    """Where ``values`` has None; most lists have few."""
    out = []
    for _ in range(values.count(None)):
        out.append(values.index(None, out[-1] + 1 if out else 0))
    return out


class LibraryIds:
    """Ids of whole texts as the tokenizers library gives them, without special tokens around.

    If the tokenizer normalises and splits so that no piece spans white space,
    a text's ids are those of its words and marks in a row, and the library encodes each
    different one once while a bounded cache holds it.  Any other tokenizer
    or text goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = (file.get("normalizer") or {}).get("normalizers", [])
        split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.separable = ([s["type"] for s in steps], split.get("pattern", {}).get("Regex")) == SEPARABLE
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in file["model"]["vocab"].items():
            self.ends[i] = token.endswith("</w>")
        self.kind = "<u2" if len(self.ends) <= 1 << 16 else "<u4"
        self.units = Cache(HELD)
        self.plain = self.without_normal_forms() if self.separable else self.tokenizer

    def without_normal_forms(self) -> Tokenizer:
        """The same model for lower-case words of WORD with white space between: each is one piece, and normal forms leave it alone."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        plain = Tokenizer.from_str(self.tokenizer.to_str())
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words; only the last token of each ends a word, so many are encoded as one text."""
        out: dict[str, bytes] = {}
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(stops) == len(some):
                out.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops)), strict=True))
            else:
                out.update(zip(some, self.whole(some), strict=True))
        return out

    def learn(self, units: set[str]) -> None:
        """A word of LETTERS has the ids of its lower case; all else goes through the library as it is."""
        new = self.units.missing(units)
        plain = [a and (b or bool(WORD.fullmatch(u))) for a, b, u in zip(map(str.isalpha, new), map(str.isascii, new), new, strict=True)]
        rest = [u for u, p in zip(new, plain, strict=True) if not p]
        self.units.update(zip(rest, self.whole(rest), strict=True))
        words = list(compress(new, plain))
        lows = list(map(str.lower, words))
        found = self.of_words(list(set(lows)))
        self.units.update(zip(words, map(found.__getitem__, lows), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        easy = [self.separable and "<|" not in t and not any(c in t for c in SEPARATORS) for t in texts]
        cut = [UNITS.findall(t) if e else [] for t, e in zip(texts, easy, strict=True)]
        self.units.turn()
        found = [list(map(self.units.get, c)) for c in cut]
        # places without ids yet: one look-up for most units, a second one for these only
        gaps = list(map(places_of_none, found))
        unseen = {c[i] for c, g in zip(cut, gaps, strict=True) for i in g}
        self.learn(unseen)
        for c, f, g in zip(cut, found, gaps, strict=True):
            for i in g:
                f[i] = self.units[c[i]]
        out = list(map(b"".join, found))
        hard = [i for i, e in enumerate(easy) if not e]
        for i, ids in zip(hard, self.whole([texts[i] for i in hard]), strict=True):
            out[i] = ids
        self.units.forget_long(unseen)
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryIds:
    return LibraryIds(path)


# -- the operator ------------------------------------------------------------


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of ``text``, each document's followed by ``end_id``, in ascending ``doc_id`` order."""
    spark = df.sparkSession
    n = min(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_SHARDS)
    cuts = df.agg(F.percentile_approx(F.col(doc_id), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = library(tokenizer)
        end = np.array([end_id], ids.kind).tobytes()
        for b in batches.slices(it, ROWS):
            docs = b.column(0)
            shard = np.searchsorted(bounds, docs.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            body = [x + end for x in ids.encode(batches.texts(b.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), docs, pa.array(body, pa.binary())], ["shard", "doc_id", "ids"])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = library(tokenizer).kind
        shard, seq, first, held = -1, 0, 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            body = pack_segment(docs, ids, first)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())], ["shard", "seq", "n_docs", "n_ids", "segment"])

        for b in batches.slices(it):
            for s, d, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if docs and (s != shard or held >= SEGMENT_IDS):
                    yield flush()
                    seq, first = (seq + 1, first + held) if s == shard else (0, 0)
                    docs, ids, held = [], [], 0
                shard = s
                docs.append(d)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
        if docs:
            yield flush()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(encoded, "shard int, doc_id long, ids binary")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    dealt.mapInArrow(packed, "shard int, seq int, n_docs long, n_ids long, segment binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (binary, uint32 each, little-endian) from the files."""
    files = spark.read.schema("shard int, seq int, n_docs long, n_ids long, segment binary").parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard, MAX_SHARDS at most
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for raw, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Segment(raw)
                ids = s.ids().astype("<u4")
                stops = np.cumsum(s.lengths).tolist()
                cut = [ids[i:j].tobytes() for i, j in zip([0, *stops], stops, strict=False)]
                start = np.array([0, *stops[:-1]], np.int64) + base + s.first
                for a in range(0, len(cut), batches.ROWS):
                    z = slice(a, a + batches.ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[z], pa.int64()), pa.array(start[z]), pa.array(cut[z], pa.binary())], ["doc_id", "start", "ids"])

    return files.join(F.broadcast(bases), "shard").select("segment", "base").mapInArrow(unpacked, "doc_id long, start long, ids binary")
