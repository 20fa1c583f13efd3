"""Text and vector similarity as Spark expressions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.columns import let


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the common length over both lengths; 0 where the characters that both have can't reach ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if least and 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return 0.0
    return 2.0 * common_length(a, b) / total


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")


def similarity(least: float = 0.0):
    """A function of (a, b, a_sorted, b_sorted) columns: 1 for equal keys, else the larger ratio of the keys and of their
    sorted words.

    An Arrow function: the same table by nested higher-order functions took about 50 times as long here. Sorting words
    keeps characters, so pairs whose characters can't reach ``least`` get 0 without a comparison.
    """

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        def one(x: str, y: str, s: str, t: str) -> float:
            if x == y:
                return 1.0
            first = ratio(x, y, least)
            return max(first, ratio(s, t)) if first else first

        return pd.Series([one(*r) for r in zip(a, b, sa, sb)], dtype="float64")

    return run


def reachable(a: Column, b: Column, threshold: float) -> Column:
    """Whether lengths allow the ratio: twice the shorter over the sum bounds it, and sorting words keeps lengths."""
    return 2.0 * F.least(a, b) >= F.lit(threshold) * (a + b)


def letter_bits(key: Column) -> Column:
    """{lo, hi, over}: how often a text has the characters of each of 32 groups, up to four times, as unary numbers of four
    bits; over counts the characters beyond. Two texts can't have more characters in common than ``in_common`` tells."""

    def counts(groups: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda g: F.size(F.filter(groups, lambda x: x == g)))

    def packed(n: Column, half: int) -> Column:
        ones = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(4), F.element_at(n, k + 1 + 16 * half))) - 1
        return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", ones(k), 4 * k)))

    def bits(n: Column) -> Column:
        over = F.aggregate(n, F.lit(0), lambda s, x: s + F.greatest(x - 4, F.lit(0)))
        return F.struct(packed(n, 0).alias("lo"), packed(n, 1).alias("hi"), over.alias("over"))

    letters = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(32)))
    return let(let(letters, counts), bits)


def in_common(a: Column, b: Column) -> Column:
    """No less than the number of characters that two texts share, from their ``letter_bits``."""
    shared = lambda half: F.bit_count(a[half].bitwiseAND(b[half]))
    return shared("lo") + shared("hi") + F.least(a["over"], b["over"])


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; -1 for vectors of different or no length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(F.lit(-1.0))
