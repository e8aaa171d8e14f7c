from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import buckets, keys

values = st.one_of(st.integers(0, 2**64 - 1), st.text(), st.binary())


@given(st.lists(values, max_size=4))
def test_ordered_codec_round_trip(row):
    kinds = [type(v) for v in row]
    assert keys.decode_ordered(keys.encode_ordered(*row), kinds) == tuple(row)


@given(st.binary(), st.binary(), st.integers(0, 9), st.integers(0, 9))
def test_ordered_codec_keeps_order(a, b, m, n):
    assert (keys.encode_ordered(a, m) < keys.encode_ordered(b, n)) == ((a, m) < (b, n))


@given(st.binary(max_size=4), st.binary(max_size=6))
def test_prefix_successor(prefix, key):
    end = keys.prefix_successor(prefix)
    assert key.startswith(prefix) == (key >= prefix and (end is None or key < end))


@pytest.mark.parametrize("data", [b"\0", b"\0\x02", b"abc", b"x\0\1y"])
def test_malformed_ordered_key(data):
    with pytest.raises(ValueError):
        keys.decode_ordered(data, [bytes])


def test_literals():
    assert keys.literal_key("hex:00ff") == b"\0\xff"
    assert keys.literal_key('"a\\n"') == b"a\n"
    assert keys.literal_key("plain") == b"plain"


def test_physical_key(spark):
    df = spark.createDataFrame([(1, b"k"), (keys.MAX_KEYSPACE, b"")], "ks int, k binary")
    rows = df.select("ks", "k", keys.physical_key(F.col("ks"), F.col("k")).alias("p")).withColumn("d", keys.decode_key(F.col("p"))).collect()
    assert [bytes(r.p) for r in rows] == [b"r\0\0\1k", b"r\xff\xff\xff"]
    assert all((r.d.mode, r.d.keyspace_id, bytes(r.d.user_key)) == ("r", r.ks, bytes(r.k)) for r in rows)
    with pytest.raises(Exception, match="keyspace id"):
        spark.createDataFrame([(1 << 24, b"k")], "ks int, k binary").select(keys.physical_key(F.col("ks"), F.col("k"))).collect()
    bad = spark.createDataFrame([(b"x\0\0\1k",), (b"r\0",)], "k binary").select(keys.decode_key(F.col("k")).alias("d")).collect()
    assert [r.d for r in bad] == [None, None]


def test_two_epoch_rules_differ_for_a_newer_request(spark):
    row = spark.range(1).select(keys.fresh(F.lit(2), F.lit(9), F.lit(1), F.lit(3)).alias("a"), keys.exact_epoch(F.lit(2), F.lit(9), F.lit(1), F.lit(3), F.lit(False)).alias("b")).first()
    assert row.a and not row.b


def test_open_ranges(spark):
    df = spark.createDataFrame([(5, 0, None), (5, 0, 5), (5, 6, None)], "k int, s int, e int")
    assert [r[0] for r in df.select(keys.in_range(F.col("k"), F.col("s"), F.col("e"))).collect()] == [True, False, False]
    inner = df.select(keys.range_in_range(F.lit(0), F.lit(None).cast("int"), F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in inner] == [True, False, False]


def test_bucket_bounds(spark):
    values_ = [0, 1, 2, 3, 63, 64, 65, 127, 128, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values_], "v long").withColumn("b", buckets.log2_bucket(F.col("v")))
    rows = df.select("v", "b", buckets.log2_lower(F.col("b")).alias("lo"), buckets.log2_upper(F.col("b")).alias("hi"), buckets.fine_bucket(F.col("v")).alias("f")).collect()
    for r in rows:
        assert r.b == r.v.bit_length() and r.lo <= r.v <= r.hi
        e = r.v.bit_length() - 7
        assert r.f == (r.v if r.v < 64 else 64 * (e + 1) + (r.v >> e) - 64)
