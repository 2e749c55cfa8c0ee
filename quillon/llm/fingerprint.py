"""Homomorphic document fingerprints, in built-in functions only.

A document is the multiset of its paragraphs.  Each paragraph is hashed to a wide vector and the
vectors are added lane by lane, modulo powers of two.  The sum does not depend on the order of the
paragraphs, and putting in or taking out a paragraph adds or subtracts its vector.

The vector has a dense part, ``EQUAL`` lanes whose equality stands for equality of the multisets, and
a sketch of ``SKETCH`` lanes.  To a lane of the sketch each occurrence of a paragraph adds a number
that the paragraph draws from a Cauchy distribution.  Sums of such numbers are Cauchy again, with a
spread that is the sum of the weights; so the lanes of a difference of two fingerprints spread as
many units as there are occurrences that the two documents do not share, for texts of any length.
All lanes have 32 bits and are sums, so that the sketch too is exact under ``combine``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL, SKETCH = 16, 96
DENSE = EQUAL + SKETCH  # lanes of 32 bits
WIDTH = DENSE + 1  # the last lane counts the paragraphs
#: What a draw of 1 adds to a lane: fine enough for one paragraph, and 40 million that differ do not wrap around.
UNIT = 16
#: Rounds in which the estimated spread settles.
ROUNDS = 6
#: Paragraphs end at line breaks and after the end of a sentence: a part of a text that is not
#: touched by an edit must show, also in prose without line breaks.
PARAGRAPH = r"\n+|(?<=[.!?])\x20+"

_DENSE_BITS = (1 << 32) - 1


def paragraphs(text: Column, separator: str = PARAGRAPH) -> Column:
    """The non-empty paragraphs of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator, -1), lambda p: p != "")


def _sum(dense: Column, more: Column) -> Column:
    return F.zip_with(dense, more, lambda a, b: (a + b).bitwiseAND(F.lit(_DENSE_BITS)))


def _draw(b: Column, lane: Column) -> Column:
    """Cauchy quantile, in units, of a chance that is hashed from a paragraph's hash and the lane."""
    return (F.tan(F.xxhash64(b, lane) * (math.pi * 2.0**-64)) * float(UNIT)).cast("long")


def vector(text: Column, separator: str = PARAGRAPH) -> Column:
    """The fingerprint of a text as an array of ``WIDTH`` longs."""
    return vector_of(paragraphs(text, separator))


def vector_of(paragraphs: Column) -> Column:
    """The fingerprint of an array of paragraphs."""
    # One strong hash a paragraph; the lanes expand it.
    hashed = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    dense = F.aggregate(
        hashed,
        F.array_repeat(F.lit(0).cast("long"), EQUAL),
        lambda s, h: _sum(s, F.array(*[x for i in range(EQUAL // 2) for x in (F.xxhash64(h, F.lit(i)).bitwiseAND(F.lit(_DENSE_BITS)), F.shiftrightunsigned(F.xxhash64(h, F.lit(i)), 32))])),
    )
    sketch = F.aggregate(
        F.transform(hashed, lambda h: F.xxhash64(h, F.lit("sketch"))),
        F.array_repeat(F.lit(0).cast("long"), SKETCH),
        lambda s, b: F.transform(s, lambda x, lane: (x + _draw(b, lane)).bitwiseAND(F.lit(_DENSE_BITS))),
    )
    return F.concat(dense, sketch, F.array(F.size(hashed).cast("long")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets, or with ``sign`` -1 of what is left when b is taken out of a."""
    mask = lambda i: F.when(i < DENSE, F.lit(_DENSE_BITS)).otherwise(F.lit((1 << 62) - 1))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] + sign * x["b"]).bitwiseAND(mask(i)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of paragraphs that two fingerprints have in common, 0 to 1; equal fingerprints give 1.

    Occurrences are counted: 1 - |a - b| / (|a| + |b|) of the two multisets.  The estimate of
    |a - b| has a standard error of about ``sqrt(2 / SKETCH)``, one seventh, of itself.
    """
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
    lane = lambda x, y: (signed((x - y).bitwiseAND(F.lit(_DENSE_BITS))) / F.lit(float(UNIT)))
    squares = F.transform(F.zip_with(F.slice(a, EQUAL + 1, SKETCH), F.slice(b, EQUAL + 1, SKETCH), lane), lambda x: x * x)
    # Likeliest spread t (squared): half of the sum of t / (t + x * x) over the lanes; from the median on, this round converges.
    half = F.lit(SKETCH / 2)
    over = lambda t, of: F.aggregate(of, F.lit(0.0), lambda s, x: s + x / (t + x))
    settle = lambda t, of: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), t, lambda u, _: u * over(u, of) / half)
    first = lambda of: F.element_at(F.array_sort(of), SKETCH // 2)
    # A lambda binds the squares: they are not computed anew in each round.
    spread = F.get(F.transform(F.array(squares), lambda of: F.when(first(of) > 0, settle(first(of), of)).otherwise(F.lit(0.0))), F.lit(0))
    estimate = F.sqrt(spread)
    both = F.element_at(a, -1) + F.element_at(b, -1)
    share = F.greatest(F.lit(0.0), 1 - estimate / F.greatest(both, F.lit(1)))
    return F.when(F.transform(a, lambda x: x) == b, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def to_hex(fp: Column) -> Column:
    """8 digits for each lane and for the count."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text, row by row; equal texts have equal ones.

    Null texts count as empty: all lanes are 0.  Ties and repeated rows get equal values; a column
    named ``out_col`` is replaced.
    """
    return df.withColumn(out_col, vector(F.col(text_col)))


def fingerprints_of_edit(df: DataFrame, text_col: str, edited_col: str, out_col: str, edited_out_col: str) -> DataFrame:
    """``df`` with the fingerprints of a text and of its edited version.

    The sum is homomorphic: the paragraphs with which both begin are hashed once, and each text adds
    its own.  Nulls count as empty.  Columns of the given names and ``fp_own, fp_new, fp_same, fp_both``
    are replaced.
    """
    split = df.withColumn("fp_own", paragraphs(F.col(text_col))).withColumn("fp_new", paragraphs(F.col(edited_col)))
    first = F.array_position(F.zip_with("fp_own", "fp_new", lambda a, b: a.eqNullSafe(b)), False)  # the shorter one is filled with nulls
    split = split.withColumn("fp_same", F.when(first > 0, first - 1).otherwise(F.size("fp_own")).cast("int"))
    both = split.withColumn("fp_both", vector_of(F.slice("fp_own", F.lit(1), F.col("fp_same"))))
    rest = lambda c: vector_of(F.slice(c, F.col("fp_same") + 1, F.greatest(F.size(c) - F.col("fp_same"), F.lit(0))))
    out = both.withColumn(out_col, combine(F.col("fp_both"), rest("fp_own"))).withColumn(edited_out_col, combine(F.col("fp_both"), rest("fp_new")))
    return out.drop("fp_own", "fp_new", "fp_same", "fp_both")
