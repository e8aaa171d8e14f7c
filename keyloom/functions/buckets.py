"""Histogram buckets of non-negative integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR = 64  # fine buckets below hold one value each
PER_OCTAVE = 64


def bits(value: Column) -> Column:
    return F.length(F.bin(value))


def log2_bucket(value: Column) -> Column:
    """0 for 0, else the number of bits: 65 buckets."""
    return F.when(value == 0, 0).otherwise(bits(value)).cast("int")


def log2_lower(bucket: Column) -> Column:
    """Least value of a bucket."""
    return F.when(bucket == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bucket, F.lit(1)) - 1))


def log2_upper(bucket: Column) -> Column:
    """Greatest value of a bucket (the last one is open and gives the largest long)."""
    full = F.lit((1 << 63) - 1)
    return F.when(bucket == 0, F.lit(0).cast("long")).when(bucket >= 63, full).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(bucket, F.lit(62))) - 1)


def fine_bucket(value: Column) -> Column:
    """Exact below 64, then 64 buckets an octave."""
    octave = bits(value) - 7
    over = F.lit(LINEAR) + PER_OCTAVE * octave + F.call_function("shiftright", value, octave) - PER_OCTAVE
    return F.when(value < LINEAR, value).otherwise(over).cast("int")
