"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``BITS`` = 4 bits agree in at
least ``MATCHES`` = 4 of their 8 bytes.  The index has a posting list for each
choice of four byte positions and the bytes there, so every such pair meets in
a list.  Within a list the bytes shared at the same position are tallied for
each pair met; a pair counts in the one list whose positions are the first
four that it shares, needs the guaranteed minimum, and is then verified by its
differing bits.  A long list, as a large group of near copies makes, is not
compared pairwise at once: its members agree in 32 bits, so those of a pair
within four bits agree in at least four of the eight half-bytes left, and the
list is split by positions and values of four half-bytes in the same way; a
part that is still long agrees in 48 bits and is split by two-bit fields.

A list gives links of each fingerprint to the smallest one that it reaches
there, never all pairs; so no group's pairs are emitted.  Lists are runs of a
sorted, spilled partition and hold different fingerprints only; 32 agreeing
bits keep them short, whatever the number of copies.  Components come from
alternating large and small stars, with the links kept in the shared folder
from round to round.  Texts are taken whole whatever their length; a bit that
is set in just half of the hashes isn't set in the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, joins, scratch

BITS, MATCHES, BYTES = 4, 4, 8
LISTS = list(combinations(range(BYTES), MATCHES))
#: Fingerprints of a list up to which all pairs are tallied; longer ones are split by finer fields first, with the same links.
PAIRWISE = 1024


def fingerprint(text: bytes, size: int = 4) -> int:
    """Words are runs without ASCII white space, A-Z lower-cased; a bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, 42)
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), stops[size - 1 :].tolist(), strict=True)], ">u8")
    set_bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        set_bits += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` without ``text`` and with the fingerprint as a signed long."""
    return batches.append(df, text, out, T.LongType(), lambda: lambda v: [signed(fingerprint(x or b"")) for x in v], (text,))


class Forest:
    """Union of positions, each tree's root its smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shared(x: np.ndarray) -> np.ndarray:
    """For each difference of fingerprints, a mask of the byte positions without a difference (bit 7: the first)."""
    return np.packbits(x.astype(">u8").reshape(*x.shape, 1).view(np.uint8) == 0, axis=-1)[..., 0]


TALLY = np.array([bin(m).count("1") for m in range(256)])
#: The first four shared positions of each mask, as a list's number.
FIRST = np.array([LISTS.index(s) if len(s := tuple(p for p in range(BYTES) if m >> (7 - p) & 1)[:MATCHES]) == MATCHES else -1 for m in range(256)])
#: Bits of the fields that a list is split by at each depth.
FIELDS = (8, 4, 2)


def linked(fps: np.ndarray, which: int) -> Iterator[tuple[int, int]]:
    """Positions of a list's members and of the smallest that they reach, without those that reach none smaller."""
    forest = Forest(len(fps))
    free = [8 * (7 - p) for p in range(BYTES) if p not in LISTS[which]]  # lowest bits of the bytes that may differ
    tally(fps, np.arange(len(fps)), free, 0, which, forest)
    for i in range(len(fps)):
        if (r := forest.root(i)) != i:
            yield i, r


def tally(fps: np.ndarray, members: np.ndarray, free: list[int], depth: int, which: int, forest: Forest) -> None:
    """Join all pairs of ``members`` within BITS bits; they agree but for the fields of FIELDS[depth] bits that start at ``free``."""
    n = len(members)
    if n <= PAIRWISE or depth + 1 == len(FIELDS):
        own = fps[members]
        for a in range(0, n, 256):
            x = own[a : a + 256, None] ^ own[None, :]
            mask = shared(x)
            for i, j in np.argwhere((TALLY[mask] >= MATCHES) & (FIRST[mask] == which) & (np.bitwise_count(x) <= BITS)).tolist():
                if a + i < j:
                    forest.join(int(members[a + i]), int(members[j]))
        return
    size = FIELDS[depth + 1]
    fields = [at + k for at in free for k in range(0, FIELDS[depth], size)]
    for some in combinations(range(len(fields)), MATCHES):
        key = sum((fps[members] >> np.uint64(fields[f]) & np.uint64((1 << size) - 1)) << np.uint64(size * k) for k, f in enumerate(some))
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        rest = [at for f, at in enumerate(fields) if f not in some]
        for k in np.flatnonzero(np.diff(cut) > 1).tolist():
            tally(fps, members[order[cut[k] : cut[k + 1]]], rest, depth + 1, which, forest)


def index_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b), a > b, between fingerprints that differ in at most four bits, enough to reach all that are linked."""

    def byte_at(p: int) -> F.Column:
        return F.shiftrightunsigned(F.col(fp), 8 * (7 - p)).bitwiseAND(F.lit(255))

    def key(n: int) -> F.Column:
        positions = LISTS[n]
        bits = F.lit(n).cast("long") * (1 << 32)
        for k, p in enumerate(positions):
            bits = bits + byte_at(p) * (1 << 8 * (MATCHES - 1 - k))
        return bits

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the list that may go on in the next batch

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for k in np.flatnonzero(np.diff(cut) > 1):
                some = fps[cut[k] : cut[k + 1]]
                for i, j in linked(some.view(np.uint64), int(keys[cut[k]] >> 32)):
                    x, y = int(some[i]), int(some[j])
                    a.append(max(x, y))
                    b.append(min(x, y))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in it:
            keys, fps = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            if held and keys[-1] == held[0][0][0]:  # all of the batch belongs to the list held
                held.append((keys, fps))
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:last], fps[:last]))
            yield links(*joined())
            held = [(keys[last:], fps[last:])]
        if held:
            yield links(*joined())

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of tasks: each row becomes 70, so AQE must not fold the small input into a few
    lists = distinct.repartition(n, fp).select(F.explode(F.array(*(key(n) for n in range(len(LISTS))))).alias("key"), F.col(fp))
    dealt = lists.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def stars(links: DataFrame) -> DataFrame:
    """(node, root): every node in a link with the smallest that it reaches, by large and small stars in turn."""
    now = scratch.written(links)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = scratch.written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        done = same(now, after)
        scratch.drop(now)
        if done:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after


def same(x: DataFrame, y: DataFrame) -> bool:
    def digest(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    return digest(x) == digest(y)


def placed(docs: DataFrame) -> DataFrame:
    """(fp, first, root) of each fingerprint of (doc_id, fp): its smallest doc_id and its component's smallest fingerprint."""
    firsts = scratch.written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stars(index_links(firsts.select("fp")))
    return scratch.written(firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def representatives(df: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (unique in ``df``) of one row of each component.

    It is the row with the smallest id, a null one last; of an id's rows that
    with the smallest hash of its text.  Components are told by their
    fingerprints, as an id with two texts can be the smallest of two of them,
    and components without an id have none.
    """
    columns = (F.col(key).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    docs = scratch.written(fingerprints(df.select(*columns)))
    least = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "key")).alias("m"))
    of_root = least.join(placed(docs).select("fp", "root"), "fp").groupBy("root").agg(F.min("m").alias("m"))
    return of_root.select(F.col("m.key").alias(key))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row.

    A null text counts as an empty one (fingerprint zero, linked like any
    other).  Null ids are never a component's id unless it has no other.
    Repeated rows are returned as often as they come.  Other columns of ``df``
    are ignored, so their names can't clash.  An empty table gives no rows.
    """
    docs = scratch.written(fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))))
    roots = placed(docs)
    of_root = scratch.written(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    # written tables, so that both joins read plain exchanges, whose skewed partitions (a fingerprint of very many copies, a root of very many fingerprints) AQE splits
    found = scratch.written(roots.join(joins.sized(of_root), "root").select("fp", "component_id"))
    return docs.join(joins.sized(found), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
