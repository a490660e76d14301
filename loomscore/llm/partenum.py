"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Sets are taken in bands of near-equal sizes: a band's largest size is its
smallest divided by the similarity, so two linked sets lie in the same band or
in neighbouring ones.  Each band is an instance for the pairs whose larger set
it holds; a set takes part in its own band's instance and in the next one.
There linked sets differ in at most ``k`` shingles, and the feature domain is
cut into ``k + 1 + spare`` parts by a hash: at least ``spare + 1`` parts have
no difference, and the hash of what a set holds of such a part is a signature
that both have.

Signatures that more than ``COMMON`` different sets share (parts that are
empty, or hold only passages that many documents share) are void: they are
counted and make no pairs.  A pair may then be missed only if both sets have
over ``spare`` void signatures in the instance.  Such sets go through the
finer enumeration: the domain in ``ceil((k + 1) / 3)`` parts of five cells
each; one part has at most two differences, so three of its cells have none,
and the signatures are the hashes of each choice of three cells.  There all
shared signatures count.

Equal sets are one before anything is paired, and of lists with the same
members one is kept.  In a list of sets that share a
signature only links to the smallest are looked at, and of these for each set
that to its smallest partner is tried first.  Lists whose members are still in
different components then give a forest: each member is compared with the
``NEAR`` ones before it in a hashed order, and one pair is tried for any two
components that seem to touch.  Last come the pairs between components that
are left.  Lists with one smallest member are dealt together, up to some
thousands of rows, and a pair is told once for all of them.  Pairs whose sizes or parity sketches (at least half a bit for each
shingle; a difference flips one bit, so no more bits differ than there are
differences, and of sets far apart nearly half do) can't be similar enough fall away where they are
met; all others are verified by their whole sets.  So no list's pairs are made
as long as its members are linked, and no link between different texts is
lost.

A shingle is known by 64 bits, made of its words' XXH64, and a set by 128; two
shingles of one pair that share their 64 bits count as one.

Results at the edges: a null text counts as an empty one, and a text without
words is linked with nothing; fewer words than a shingle's are one shingle;
null ids are never a component's id unless it has no other; repeated rows and
ids are returned as often as they come; texts are taken whole whatever their
length; other columns are ignored, so their names can't clash; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches, joins, scratch
from .simhash import stars

SIZE, PERCENT = 4, 85
#: Different sets that may share a signature before it is void.
COMMON = 64
#: Finer enumeration: differences that a part may have, and its cells.
LEFT, CELLS = 2, 5
CHOICES = np.array(list(combinations(range(CELLS), CELLS - LEFT)))
#: Members before it that a list's member is compared with for the forest.
NEAR = 128
#: Rows of lists with one smallest member that are compared in one task, and pairs that it remembers.
TOGETHER, SEEN = 20_000, 1_000_000
#: Words held with their hashes.
HELD = 200_000
#: Bits of the smallest sketch, as a power of two.
LEAST = 8
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a signature below its instance's number: each one more is shuffled with every signature, and lists that share one by chance only make pairs that fall away.
BITS = 40


class Instance(NamedTuple):
    """Pairs whose larger set has ``low`` to ``high`` members differ in at most ``k``."""

    number: int
    low: int
    high: int
    k: int
    spare: int


@lru_cache(1 << 16)
def instances(n: int, percent: int) -> tuple[Instance, ...]:
    """Those that a set of ``n`` shingles takes part in; none where similar sets are equal."""
    number, low = 0, 1
    while (high := max(low, 100 * low // percent)) < n:
        number, low = number + 1, high + 1
    found = [(number, low, high), (number + 1, high + 1, max(high + 1, 100 * (high + 1) // percent))]
    out = [Instance(i, a, b, k, 1 + k // 8) for i, a, b in found if 100 * n >= percent * a and (k := 2 * b * (100 - percent) // (100 + percent))]
    return tuple(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return (x ^ (x >> np.uint64(29))) * M2


def salt(seed: int) -> np.uint64:
    return np.uint64(seed * int(M2) % (1 << 64))


class Shingles(dict):
    """Hashes of words; called with a text (bytes), gives its sorted distinct shingles' hashes."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = code
        return code

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self) > HELD:
            self.clear()
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(codes))
        h = np.full(len(codes) - size + 1, size, np.uint64)
        for k in range(size):
            h = mixed(h ^ codes[k : len(codes) - size + 1 + k])
        return np.unique(h)


def dealt(x: np.ndarray, seed: int, parts: int) -> np.ndarray:
    """The part of each feature."""
    return ((mixed(x + salt(seed)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def sums(x: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros(parts, np.uint64)
    np.add.at(out, part, x)
    return out


def labelled(values: np.ndarray, at: np.ndarray, i: Instance, seed: int) -> np.ndarray:
    """Signatures: hashes of the features' sums and their place, below the instance's number."""
    h = mixed(values ^ mixed(at.astype(np.uint64) + salt(seed))) >> np.uint64(64 - BITS)
    return (np.uint64(i.number << BITS) | h).astype(np.int64)


def signatures(x: np.ndarray, percent: int) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for i in instances(len(x), percent):
        parts = i.k + 1 + i.spare
        out.append(labelled(sums(x, dealt(x, 2 * i.number, parts), parts), np.arange(parts), i, 1))
    return np.concatenate(out)


def finer(x: np.ndarray, percent: int, only: set[int]) -> np.ndarray:
    """Signatures of the finer enumeration in the instances ``only``."""
    out = [np.zeros(0, np.int64)]
    for i in instances(len(x), percent):
        if i.number in only:
            parts = -(-(i.k + 1) // (LEFT + 1))
            cells = sums(x, dealt(x, 2 * i.number + 1, parts * CELLS), parts * CELLS).reshape(parts, CELLS)
            out.append(labelled(cells[:, CHOICES].sum(2, dtype=np.uint64).ravel(), np.arange(parts * len(CHOICES)), i, 2))
    return np.concatenate(out)


def sketch(x: np.ndarray) -> bytes:
    """Parities of the features in classes by their lowest bits, at least one for two features."""
    n = 1 << max(LEAST, ((len(x) - 1) // 2).bit_length())
    return np.packbits((np.bincount((x & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, the longer one folded: no more than the sets have differences."""
    u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def described(df: DataFrame, size: int, percent: int) -> DataFrame:
    """``df`` (text and others) with n, digest, sketch and signatures in place of the text; null but n where it has no words."""

    def factory():
        of = Shingles(size)

        def run(texts: list[bytes | None]) -> list[list]:
            out: list[list] = [[], [], [], []]
            for t in texts:
                x = of(t)
                found = (len(x), digest(x), sketch(x), signatures(x, percent).tobytes()) if len(x) else (0, None, None, None)
                for o, v in zip(out, found, strict=True):
                    o.append(v)
            return out

        return run

    kinds = {"n": T.LongType(), "digest": T.BinaryType(), "sketch": T.BinaryType(), "sigs": T.BinaryType()}
    return batches.append_all(df, "text", kinds, factory, ("text",))


def exploded(df: DataFrame, sigs: str = "sigs") -> DataFrame:
    """(sig, row, n) for each signature of (row, n, sigs)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(it):
            found = [np.frombuffer(x or b"", np.int64) for x in b.column(2).to_pylist()]
            times = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), *(pa.array(np.repeat(c.to_numpy(), times)) for c in b.columns[:2])], ["sig", "row", "n"])

    return df.select("row", "n", sigs).mapInArrow(run, "sig long, row long, n long")


def lists(rows: DataFrame, common: int | None) -> DataFrame:
    """(sig, pivot, n_pivot, row, n, own): members of each list beside its smallest; pivot is null in lists of more than ``common``, which name all members.

    ``own`` is a hash of the members, or of the signature where they weren't
    in hand together.

    Lists are runs of a sorted partition.  What is in hand is a batch and at
    most ``COMMON`` rows of the run that may go on in the next.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        over = None  # the signature of a void list that goes on
        part = None  # that of a list of which a part is out

        def out(sig: np.ndarray, row: np.ndarray, n: np.ndarray, goes_on: bool = False) -> pa.RecordBatch:
            begins = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            lengths = np.diff([*begins, len(sig)])
            first = np.repeat(begins, lengths)
            void = np.repeat(lengths > common, lengths) if common else np.zeros(len(sig), bool)
            if over is not None:
                void |= sig == over
            take = void | (np.arange(len(sig)) != first)
            pivot = pa.array(row[first][take], pa.int64(), mask=void[take])
            own = np.bitwise_xor.reduceat(mixed(row.astype(np.uint64) + salt(3)), begins)
            own = np.where((sig == part) | goes_on, sig, np.repeat(own, lengths).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(sig[take]), pivot, pa.array(n[first][take]), pa.array(row[take]), pa.array(n[take]), pa.array(own[take])], ["sig", "pivot", "n_pivot", "row", "n", "own"])

        for b in it:
            if not b.num_rows:
                continue
            sig, row, n = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True))
            last = int(np.searchsorted(sig, sig[-1]))
            if last:
                yield out(sig[:last], row[:last], n[:last])
            if len(sig) - last <= COMMON and over != sig[-1]:
                held = sig[last:], row[last:], n[last:]
                over = None
                continue
            yield out(sig[last:], row[last:], n[last:], True)
            keep = 0 if common else 1  # the smallest goes on beside the others
            part = int(sig[-1])
            over = part if common else None
            held = sig[last : last + keep], row[last : last + keep], n[last : last + keep]
        if len(held[0]):
            yield out(*held)

    return rows.repartition("sig").sortWithinPartitions("sig", "row").mapInArrow(run, "sig long, pivot long, n_pivot long, row long, n long, own long")


def single(rows: DataFrame) -> DataFrame:
    """``rows`` (lists) without those lists that have the members of another one."""
    once = scratch.written(rows.groupBy("pivot", "own").agg(F.min("sig").alias("sig")).select("sig").distinct())
    return scratch.written(rows.join(joins.sized(once), "sig", "left_semi").drop("own"))


def could_link(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with what ``values`` (row, value) has for each: x and y.

    Values too large to broadcast meet the pairs, which are smaller, where they
    lie; they are shuffled by b only, those of a once a pair and those of b once.
    """
    if joins.fits(values):
        held = F.broadcast(values)
        return pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    theirs = values.toDF("b", "y").join(joins.sized(pairs.select("b").distinct()), "b", "left_semi")
    return values.toDF("a", "x").join(joins.sized(pairs), "a").join(theirs, "b")


def sketches(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, sketch) of ``rows`` (row, repeats allowed)."""
    return scratch.written(docs.select("row", "sketch").join(joins.sized(scratch.written(rows.distinct())), "row", "left_semi"))


def sifted(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b, n_a, n_b) whose sketches differ in no more bits than linked sets do."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(it):
            n = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()).tolist()
            keep = [(100 + percent) * apart(x, y) <= (100 - percent) * m for x, y, m in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), n, strict=True)]
            yield b.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))

    both = beside(pairs, sketches(docs, pairs.select(F.explode(F.array("a", "b")).alias("row"))))
    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long, n_a long, n_b long")


def texts_of(df: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, digest, text) of ``rows`` (row) for each of ``df`` with the row's id and its text's hash; the digest tells whether it is the row's."""
    wanted = scratch.written(rows.join(docs.select("row", "digest", F.col("doc_id").alias("id"), F.col("h").alias("of")), "row"))
    return df.join(joins.sized(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("of"))).select("row", "digest", "text")


def sets(df: DataFrame, docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(row, set) of each of ``rows``, sets made again from the texts."""

    def factory():
        of = Shingles(size)

        def run(texts: list[bytes | None]) -> list[list]:
            found = [of(t) for t in texts]
            return [[x.tobytes() for x in found], [digest(x) for x in found]]

        return run

    made = batches.append_all(texts_of(df, docs, rows), "text", {"set": T.BinaryType(), "own": T.BinaryType()}, factory, ("text",))
    found = scratch.written(made.filter("own = digest").select("row", "set"))
    return found if found.count() == rows.count() else scratch.written(found.dropDuplicates(["row"]))  # rows that repeat id and text


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar enough."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(it):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside(pairs.select("a", "b"), found).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def folded(found: list[bytes]) -> np.ndarray:
    """Sketches of one list as rows of words, folded to the length of the shortest."""
    least = min(map(len, found))
    out = np.empty((len(found), least // 8), np.uint64)
    for i, x in enumerate(found):
        v = np.frombuffer(x, np.uint64)
        while len(v) > least // 8:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


class Members:
    """A list's members so far that others are compared with: at most ``NEAR``, or all that are apart."""

    def __init__(self, percent: int, forest: bool):
        self.percent, self.forest = percent, forest
        self.rows: list[tuple[int, int, int, bytes]] = []
        self.up: dict[int, int] = {}

    def root(self, of: int) -> int:
        while (up := self.up.get(of, of)) != of:
            of = up
        return of

    def pairs(self, row: int, n: int, of: int, own: bytes) -> list[tuple[int, int]]:
        """(a, b) of ``row`` and members in other components that may be linked with it; for a forest one a component."""
        some = [r for r in self.rows if self.root(r[2]) != self.root(of) and 100 * min(n, r[1]) >= self.percent * max(n, r[1])]
        if not some:
            return []
        words = folded([own, *(r[3] for r in some)])
        bits = np.bitwise_count(words[1:] ^ words[0]).sum(1, dtype=np.int64)
        close = (100 + self.percent) * bits <= (100 - self.percent) * (n + np.array([r[1] for r in some]))
        out = []
        for k in np.flatnonzero(close).tolist():
            a, b = self.root(some[k][2]), self.root(of)
            if a == b:
                continue  # a pair of this component is tried already
            if self.forest:
                self.up[max(a, b)] = min(a, b)
            out.append((max(row, some[k][0]), min(row, some[k][0])))
        return out

    def add(self, row: int, n: int, of: int, own: bytes, apart: bool) -> None:
        if self.forest:
            self.rows = [*self.rows[1 - NEAR :], (row, n, of, own)]
        elif apart:
            self.rows.append((row, n, of, own))


def unlike(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, sig): pairs of a list's members in different components whose sketches don't tell that they aren't linked.

    ``members`` is (pivot, part, sig, row, n, of, apart, sketch), dealt by
    pivot and part; ``of`` is the component, ``apart`` whether it isn't that
    of the list's smallest.  For a
    forest (each member with those before it, one pair a component) what is in
    hand of a list are ``NEAR`` members, else those that are still apart.
    Lists with one smallest member and part come one after another, and a pair
    is told for the first of them that has it; a forest tells the others as
    (null, null, sig).
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near, held = None, None, Members(percent, forest)
        seen: set[tuple[int, int]] = set()
        said = False  # whether the list has a row
        for b in batches.slices(it, 10_000):
            out: list[tuple[int | None, int | None, int]] = []
            for pivot, part, sig, row, n, of, apart, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (pivot, part) != near or len(seen) > SEEN:
                    near, seen = (pivot, part), set()
                if sig != now:
                    now, held, said = sig, Members(percent, forest), False
                found = held.pairs(row, n, of, own)
                new = [(*p, sig) for p in found if p not in seen]
                out += new or ([(None, None, sig)] if forest and found and not said else [])
                said = said or bool(found)
                seen.update(found)
                held.add(row, n, of, own, apart)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["a", "b", "sig"])

    order = [F.xxhash64("row")] if forest else [F.desc("apart")]
    dealt = members.sortWithinPartitions("pivot", "part", "sig", *order, "row")
    return dealt.select("pivot", "part", "sig", "row", "n", "of", "apart", "sketch").mapInArrow(run, "a long, b long, sig long")


def linked(df: DataFrame, docs: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of the rows of ``docs`` that are linked with others; ``found``: their lists."""
    # sets that have so many void signatures in an instance that a pair could be missed
    number = F.shiftright("sig", BITS)
    void = found.filter("pivot IS NULL").groupBy("row", number.cast("int").alias("number"), "n").agg(F.count("*").alias("void"))
    spares = F.create_map(*(F.lit(v) for i in table(percent) for v in (i.number, i.spare)))
    more = scratch.written(void.filter(F.col("void") > F.element_at(spares, F.col("number"))).groupBy("row", "n").agg(F.collect_set("number").alias("numbers")))
    out = found.filter("pivot <> row")
    if not more.isEmpty():
        out = out.unionByName(scratch.written(lists(exploded(finely(df, docs, more, size, percent)), None)).filter("pivot <> row"))
    out = single(out)
    pairs = out.filter(could_link(F.col("n_pivot"), F.col("n"), percent)).select(F.col("row").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a"), F.col("n_pivot").alias("n_b")).distinct()
    pairs = scratch.written(sifted(scratch.written(pairs), docs, percent))
    first = scratch.written(pairs.groupBy("a").agg(F.min("b").alias("b")))
    links = checked(df, docs, first, size, percent)
    tried = first
    for forest in (True, False):
        found, more = open_pairs(out, pairs, stars(links), docs, percent, forest)
        if forest:
            out = out.join(joins.sized(scratch.written(more)), "sig", "left_semi")
        rest = scratch.written(found.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links, tried = links.unionByName(checked(df, docs, rest, size, percent)), tried.unionByName(rest)
    return stars(links)


def open_pairs(out: DataFrame, pairs: DataFrame, roots: DataFrame, docs: DataFrame, percent: int, forest: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b) in different components of ``roots``: of ``pairs``, and of the lists' other members; and (sig) of the lists that may have more.

    A list has no more links if no pair of it is found here and each of its
    members is compared with all others: sketches tell apart only what isn't
    linked, and components only grow.
    """
    of = joins.sized(roots)

    def component(rows: DataFrame, row: str, name: str) -> DataFrame:
        return rows.join(of.toDF(row, name), row, "left").withColumn(name, F.coalesce(name, row))

    others = component(component(pairs, "a", "of_a"), "b", "of_b").filter("of_a <> of_b").select("a", "b")
    placed = component(component(out, "row", "of"), "pivot", "of_pivot")
    placed = scratch.written(placed.select("sig", "pivot", "row", "n", "of", (F.col("of") != F.col("of_pivot")).alias("apart")))
    undone = placed.groupBy("sig", "pivot").agg(F.count("*").alias("members"), F.min("of").alias("least"), F.max("of").alias("most")).filter("least <> most")
    parts = 1 + F.floor(F.sum("members").over(W.partitionBy("pivot")) / TOGETHER)
    undone = scratch.written(undone.select("sig", "members", F.pmod(F.xxhash64("sig"), parts).alias("part")))
    members = placed.join(joins.sized(undone.select("sig", "part")), "sig")
    # a row's lists with one smallest member are one row until they are dealt, so that its sketch is shuffled once for all of them
    members = scratch.written(members.groupBy("pivot", "part", "row", "n", "of", "apart").agg(F.collect_list("sig").alias("sigs")))
    scratch.drop(placed)
    beside_sketches = members.join(joins.sized(sketches(docs, members.select("row"))), "row").repartition("pivot", "part")
    found = scratch.written(unlike(beside_sketches.withColumn("sig", F.explode("sigs")).drop("sigs"), percent, forest))
    scratch.drop(members)
    more = found.select("sig").unionByName(undone.filter(F.col("members") > NEAR + 1).select("sig")).distinct()
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(others).distinct(), more


@lru_cache(8)
def table(percent: int) -> tuple[Instance, ...]:
    """All instances up to the longest text that a row can hold."""
    found, n = {}, 1
    while n < 1 << 31:
        for i in instances(n, percent):
            found[i.number] = i
        n = 100 * n // percent + 1
    return tuple(found.values())


def finely(df: DataFrame, docs: DataFrame, more: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, n, sigs) of the finer enumeration for ``more`` (row, n, numbers)."""
    rows = sets(df, docs, more.select("row"), size).join(more, "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(it):
            found = [finer(np.frombuffer(x, np.uint64), percent, set(only)).tobytes() for x, only in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["row", "n", "sigs"])

    return rows.select("row", "n", "set", "numbers").mapInArrow(run, "row long, n long, sigs binary")


def checked(df: DataFrame, docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs that are links."""
    rows = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    held = sets(df, docs, rows, size)
    out = scratch.written(verified(pairs, held, percent))
    scratch.drop(held)
    return out


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row."""
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = scratch.written(described(df.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("text")}), size, percent))
    equal = docs.filter("n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("times")).filter("times > 1")
    equal = scratch.written(equal.drop("times"))
    whole = docs.select("row", "doc_id", "n", "digest").join(joins.sized(equal), "digest", "left")
    whole = scratch.written(whole.select("row", "doc_id", "n", F.coalesce("rep", "row").alias("rep"), F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("first")))
    copies = joins.sized(whole.filter("row <> rep").select("row"))
    found = scratch.written(lists(exploded(docs.filter("n > 0").join(copies, "row", "left_anti")), COMMON))
    slim = scratch.written(docs.drop("sigs"))
    scratch.drop(docs)  # the signatures are the largest of the tables
    roots = scratch.written(linked(df, slim, found, size, percent))
    scratch.drop(found)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    smallest = whole.filter("row = rep").select(F.col("rep").alias("node"), "first").join(joins.sized(scratch.written(nodes)), "node").groupBy("root").agg(F.min("first").alias("least"))
    names = scratch.written(nodes.join(joins.sized(scratch.written(smallest)), "root").select(F.col("node").alias("rep"), "least"))
    placed = whole.join(joins.sized(names.withColumn("linked", F.lit(True))), "rep", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
