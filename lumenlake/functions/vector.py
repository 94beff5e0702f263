"""Vector, hash and score expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalize(a: Column | str) -> Column:
    """The vector at length 1; one without length as it is."""
    a = _double(a)
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def midpoint(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: (x + y) / 2)


def hex_words(hex_: Column | str, words: int) -> Column:
    """A hash in hex as `words` longs of 16 digits each."""
    col = F.col(hex_) if isinstance(hex_, str) else hex_
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.conv(F.substring(col, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex hashes; null if their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    # digit by digit: any length works, and no digit exceeds four bits
    digits = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.bit_count(F.conv(x, 16, 10).cast("int").bitwiseXOR(F.conv(y, 16, 10).cast("int"))))
    return F.when(F.length(a) == F.length(b), F.when(a == b, F.lit(0)).otherwise(F.aggregate(digits, F.lit(0), lambda s, x: s + x)))


def hamming_longs(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of longs."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def average_bits(values: Column | str) -> Column:
    """The average hash of an array as a string of bits: 1 where a value is at least the mean."""
    v = _double(values)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.array_join(F.transform(v, lambda x: F.when(x >= mean, F.lit("1")).otherwise(F.lit("0"))), "")


def average_hash(values: Column | str) -> Column:
    """average_bits in lower-case hex, first value in the highest bit; sizes are multiples of four."""
    bits = average_bits(values)
    each = F.transform(F.sequence(F.lit(0), (F.length(bits) / 4).cast("int") - 1), lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)))
    return F.array_join(each, "")


def guarded(top: Column, bottom: Column, empty: float) -> Column:
    """top / bottom, or `empty` where bottom is 0."""
    return F.when(bottom == 0, F.lit(float(empty))).otherwise(top / bottom)
