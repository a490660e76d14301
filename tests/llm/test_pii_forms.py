"""Addresses and numbers in the forms that texts have them, and what only looks like them."""

import re

from loomscore.llm import pii

ADDRESSES = ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3::8a2e:370:7334", "fd00::", "64:ff9b::c000:201", "2001:DB8:0:0:1::1", "2001:db8:85a3:0:0:8a2e:370:7334")
PHONES = (
    "06 12 34 56 78", "06.12.34.56.78", "+33 6 12 34 56 78", "+49 30 123456", "+49 170 1234567", "030 1234567", "030/1234567", "(030) 1234567", "+44 7911 123456", "+1 5551234567", "07911 123456", "+34 91 123 45 67", "91 123 45 67", "612 34 56 78",
    "+49 (0)30 123456", "(555) 5550123", "+1 (988) 555-2485", "+19885552485",
)
CLEAN = (
    "std::vector and a[1::2] at 12:30:45, x[::2], Foo::Bar, face::add", "numbers 01 02 03 04 05 06 07 and 10 20 30 40 50", "costs 1234567 or 12.50, 1,234,567", "pages 100-2000, 2019-2024, on 2024-01-05", "in 1999 12345 people, 90 100 20 30 units",
    "version 1.02.03.04.05", "a+b = +12, -7; 007 agents", "0.123 45678",
)


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return pii.replace(df, "key").orderBy("i").collect()


def test_each_form_is_replaced(spark):
    for kind, values in (("ipv6", ADDRESSES), ("phone", PHONES)):
        for v, r in zip(values, replaced(spark, [f"see {v}, or: {v}." for v in values]), strict=True):
            assert (r["n_pii"], r["pii_kinds"]) == (2, kind), v
            one, other = re.fullmatch(r"see (.*), or: (.*)\.", r["text"]).groups()
            assert one == other != v and (kind == "ipv6" or re.sub("[0-9]", "0", one) == re.sub("[0-9]", "0", v)), (v, one)


def test_clean_numbers_stay(spark):
    assert [(r["text"], r["n_pii"]) for r in replaced(spark, CLEAN)] == [(t, 0) for t in CLEAN]


def test_an_address_is_one_however_it_is_written(spark):
    rows = replaced(spark, ["2001:db8::1", "2001:db8:0:0:0:0:0:1", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8::1", "::ffff:192.0.2.1"])
    assert len({r["text"].lower() for r in rows[:4]}) == 1
    assert rows[4]["pii_kinds"] == "ipv4" and rows[4]["text"].startswith("::ffff:")
