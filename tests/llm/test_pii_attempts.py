"""Values that have few or no surrogates of their own form."""

import re

from loomscore.llm import pii


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r["text"] for r in pii.replace(df, "key").orderBy("i").collect()]


def test_values_without_letters_or_digits_stay(spark):
    texts = ["Password: ________", "token=------", "secret: ......", "pwd=" + "-" * 5000]
    assert replaced(spark, *texts) == texts


def test_a_surrogate_is_found_when_all_of_the_form_are_in_use(spark):
    """Ten values with one digit, which are all of their form, and one number that keeps its only digit."""
    values = [f"_____{d}" for d in range(10)]
    new = [t.removeprefix("password=") for t in replaced(spark, *(f"password={v}" for v in values))]
    assert len(set(new)) == 10 and not set(new) & set(values)
    assert all(re.fullmatch("_____[0-9]{2,}", v) for v in new)
    (number,) = replaced(spark, "token=1......")
    assert re.fullmatch(r"token=1\.{6}[0-9]+", number)
