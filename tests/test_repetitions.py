"""Words repeated in a row, against Python's re with the reference's pattern."""

import re

from loomline.functions import text as T

TEXTS = ["or the the the.\nThen", "De de de.", "of of of ern", "the the the the.", "go go go gopher", "Of of OF of, of of of of", "x the the the", "a a a a a a a a b b b b", ""]


def test_three_in_a_row_are_none(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", T.repetitions(df["t"]).alias("n")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [len(re.findall(r"(\b\w+\b)( \1){3,}", t, re.I)) for t in TEXTS]
    assert got[0] == got[1] == 0
