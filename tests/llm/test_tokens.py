"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from loomscore.llm import batches, bpe, queries, token_files  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "  ", "a", "a  b", "a   b\n\n c", "don't 's it's", " lead", "trail ", "trail  ", "\n", "x\n y", "x \n y", "\t a", "a　b  c", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "a" * 3000, "日本語テキスト", "é x ΣΑΣ İx",
    "a\xa0 b", "123 4567 8", "²x ªb", "😀 😀😀", "ab\r\n cd", "\x85x \x85", "\x1ca", "q\u200b z", " \n", "\n ", "we'll'll 'LL", "x" * 97 + " " + "é" * 200, "foo,bar foo,", "ÀÉ ß ÿŸ",
]


def strange(n, seed=3):
    r, letters = random.Random(seed), " \n\ta.,'sSéÉ1 \u0301　Σ<|endoftext|>"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)]


def spaced(n, seed=5):
    """Texts of all Unicode white space, separators, combining marks and letters that change length or depend on their place in lower case."""
    r = random.Random(seed)
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace()) + "\x1c\x1d\u200b\u2060\ufeff\u180e"
    marks = "\u0301\u0327\u0300\u0345\u05bf\u0653\u1100\u1161\u11a8\u0307\u0130\u0399\u03a3\u03c2\u1e9e"
    letters = "aAb\xe9\xdf\u03a3\u03c3\u0130\u0131\u01c51\xb2\u0663.,'sSdD<|>_-"
    return ["".join(r.choice(r.choice([spaces, marks, letters, letters])) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encode_and_decode_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.ByteBpe(BYTES)
    texts = ODD + strange(1500) + spaced(3000)
    ids = own.encode(texts)
    for text, raw, back in zip(texts, ids, own.decode(ids), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == expected, text
        assert back.decode() == library.decode(expected, skip_special_tokens=False), text


def test_short_and_long_merges_agree():
    own = bpe.ByteBpe(BYTES)
    words = [w.encode() for w in strange(300, 9) if w] + [b"abcabcabc" * 9]
    assert own.merge_short(words) == [own.merge_long(w) for w in words]


def test_cache_generations_keep_results_right(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    own, fresh = bpe.ByteBpe(BYTES), Tokenizer.from_file(BYTES)
    own.pieces.size = own.chunks.size = 5
    for text in ODD * 2:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_columns_of_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, None, "z"), (3, "", "w")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert sorted((r["doc_id"], len(r["ids"]), r["decoded"]) for r in out) == [(1, 8, "a b"), (1, 8, "a b"), (2, 0, ""), (3, 0, "")]
    assert bpe.encode(df.limit(0), BYTES).count() == 0
    both = bpe.round_trip(df.withColumn("decoded", df["ids"]), BYTES)
    assert sorted(map(tuple, both.select("doc_id", "ids", "decoded").collect())) == sorted((r["doc_id"], r["ids"], r["decoded"]) for r in out)


def test_library_ids_equal_whole_texts():
    own, library = token_files.LibraryIds(WORDS), Tokenizer.from_file(WORDS)
    assert own.separable
    own.units.size = 50
    for block in (ODD, strange(1500), spaced(3000), ODD):
        for text, raw in zip(block, own.encode(block), strict=True):
            assert np.frombuffer(raw, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
@pytest.mark.parametrize("high", [1, 7, 50_000, 2**32])
def test_segments_give_back_their_ids(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    s = token_files.Segment(token_files.pack_segment([None, 7], [ids[: n // 3], ids[n // 3 :]], 5))
    assert s.ids().tolist() == ids.tolist() and s.ids(100, 300).tolist() == ids[100:300].tolist()
    assert (s.doc_ids, s.lengths.tolist(), s.first) == ([None, 7], [n // 3, n - n // 3], 5)


@pytest.mark.parametrize("n", [1, 7, 8, 100, 256])
def test_packed_bits_are_those_of_each_value_in_a_row(n):
    r = np.random.default_rng(n)
    for width in range(33):
        values = r.integers(0, 1 << width, (3, n))
        bits = ["".join(f"{v:0{width}b}" for v in row) if width else "" for row in values.tolist()]
        plain = [bytes(int(b[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(b), 8)) for b in bits]
        found = token_files.packed_bits(values, width)
        assert [x.tobytes() for x in found] == plain
        assert (token_files.unpacked_bits(found, width, n) == values).all()


def test_places_without_ids():
    assert [token_files.places_of_none(x) for x in ([], [None], [b"", None, b"a", None], [b""])] == [[], [0], [1, 3], []]


def test_outliers_are_exceptions():
    ids = np.array([5] * 250 + [4_000_000_000] * 6)
    (block,) = token_files.pack_blocks(ids)
    low, width, n, odd = token_files.BLOCK.unpack_from(block)
    assert (low, width, n, odd) == (5, 0, 256, 6) and len(block) == token_files.BLOCK.size + 6 * 6


def test_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_files.write(df.selectExpr("*", "1 AS shard", "2 AS ids"), str(tmp_path / "f"), WORDS, end_id=1, shards=4)
    library = Tokenizer.from_file(WORDS)
    expected = sorted(((d is not None, d or 0, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in rows), key=lambda x: x[:2])
    got = token_files.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [d if known else None for known, d, _ in expected]
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sorted(bytes(r["ids"]) for r in got) == sorted(x[2] for x in expected)


def test_empty_table_gives_no_segments(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"), WORDS, end_id=1)
    assert token_files.read(spark, str(tmp_path / "f")).count() == 0


def test_bpe_query_digests(spark):
    library = Tokenizer.from_file(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = queries.op7_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 50, 3, 3, 3, 0, 0)] + [None]), pa.array(range(8))], ["t", "n"])
    parts = list(batches.slices([batch], rows=3, most=9))
    assert [p.column(1).to_pylist() for p in parts] == [[0], [1], [2, 3, 4], [5, 6, 7]]
    assert list(batches.slices([batch.slice(0, 0)])) == []


def test_very_long_texts_equal_the_library():
    text = ("Words, of many kinds: éß 'll 12 " * 40_000) + "x" * 300_000
    ids = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    own = token_files.LibraryIds(WORDS)
    assert np.frombuffer(own.encode([text])[0], own.kind).tolist() == ids
    assert max(map(len, own.units)) <= bpe.SHORT
    short = text[: 1_200_000]
    assert np.frombuffer(bpe.ByteBpe(BYTES).encode([short])[0], "<u4").tolist() == Tokenizer.from_file(BYTES).encode(short, add_special_tokens=False).ids


def test_query_digests(spark):
    library = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    at = 0
    for r in queries.op3_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        ids = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
