import random

import pytest
from pyspark.sql import functions as F

import linewright as lw

SETTINGS = "key string, value string, seq bigint"
SIZES = [{}, {"max_broadcast_bytes": 0}]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(params=["default", "sort-merge"])
def joins(spark, request):
    """With and without Spark's own broadcasts of small tables."""
    if request.param == "sort-merge":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("sizes", SIZES)
def test_append_if_absent(spark, joins, sizes):
    base = spark.createDataFrame([("A", "old", 0)], SETTINGS)
    incoming = spark.createDataFrame(
        [("A", "new", 1), ("B", "second", 3), ("B", "first", 2), (None, "x", 4), (None, "y", 5)],
        SETTINGS,
    )
    once = lw.append_if_absent(base, incoming, "key", "seq", **sizes)
    expected = [("A", "old", 0), ("B", "first", 2), (None, "x", 4)]
    assert rows(once) == sorted(expected, key=str)
    twice = lw.append_if_absent(once, incoming, "key", "seq", **sizes)
    assert rows(twice) == rows(once)
    assert lw.rows_to_append(once, incoming, "key", "seq", **sizes).isEmpty()


@pytest.mark.parametrize("sizes", SIZES)
def test_append_equals_brute_force_with_two_part_keys(spark, joins, sizes):
    rng = random.Random(3)

    def table(count, seq):
        part = [None, "a", "b", "c", "d"]
        return [(rng.choice(part), rng.choice([None, 1.0, 2.0, 0.0]), seq + i) for i in range(count)]

    base_rows, incoming_rows = table(8, 0), table(60, 100)
    schema = "k1 string, k2 double, seq bigint"
    base = spark.createDataFrame(base_rows, schema)
    incoming = spark.createDataFrame(incoming_rows, schema)
    expected, seen = list(base_rows), {row[:2] for row in base_rows}
    for row in incoming_rows:
        if row[:2] not in seen:
            seen.add(row[:2])
            expected.append(row)
    found = lw.append_if_absent(base, incoming, ["k1", "k2"], "seq", **sizes)
    assert rows(found) == sorted(expected, key=str)


@pytest.mark.parametrize("hint", ["broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl"])
def test_struct_keys_join_null_safely_by_every_join(spark, hint):
    """The operators rely on this."""
    from linewright.plans.keys import key_struct

    left = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    right = spark.createDataFrame([(None,), (2,)], "k int").select(
        key_struct("k").alias("other")
    )
    kind = "inner" if hint == "shuffle_replicate_nl" else "left_semi"
    joined = left.join(right.hint(hint), key_struct("k") == F.col("other"), kind)
    assert rows(joined.select("k")) == [(2,), (None,)]


@pytest.mark.parametrize("sizes", SIZES)
def test_keys_of_different_integer_types_meet(spark, joins, sizes):
    base = spark.createDataFrame([(1, 0)], "key int, seq int")
    incoming = spark.createDataFrame([(1, 5), (2, 6)], "key bigint, seq bigint")
    found = lw.append_if_absent(base, incoming, "key", "seq", **sizes)
    assert rows(found) == [(1, 0), (2, 6)]
    assert rows(lw.missing_inputs(incoming, base, "key", **sizes)) == [(2,)]


def test_rows_with_types_that_cannot_be_sorted(spark):
    df = spark.sql(
        "SELECT 'a' AS key, map('v', 1) AS props, 1 AS seq UNION ALL SELECT 'a', map('v', 2), 2"
    )
    assert lw.latest_per_key(df, "key", "seq").first().props == {"v": 2}
    new = lw.rows_to_append(df.limit(0), df, "key", "seq")
    assert new.first().props == {"v": 1}


def test_base_rows_are_kept_as_they_are(spark):
    base = spark.createDataFrame([("A", "1", 0), ("A", "1", 0), (None, None, None)], SETTINGS)
    incoming = spark.createDataFrame([], SETTINGS)
    assert rows(lw.append_if_absent(base, incoming, "key", "seq")) == rows(base)


def test_latest_per_key(spark):
    df = spark.createDataFrame(
        [("p", "1", 1, 1), ("p", "2", 1, 2), ("q", "1", None, 1), (None, "3", 5, 1), ("q", "0", None, 0)],
        "product string, version string, at bigint, id bigint",
    )
    found = lw.latest_per_key(df, "product", ["at", "id"])
    assert found.columns == df.columns
    assert rows(found.select("product", "version")) == [("p", "2"), ("q", "1"), (None, "3")]


@pytest.mark.parametrize("sizes", SIZES)
def test_lookup_with_default(spark, joins, sizes):
    codes = spark.createDataFrame([("-r",), ("-x",), (None,), ("-r",)], "code string")
    dim = spark.createDataFrame([("-r", "red"), ("-b", "blue"), (None, "never")], "code string, label string")
    found = lw.lookup_with_default(codes, dim, "code", "green", **sizes)
    assert found.columns == ["code", "label"]
    assert rows(found) == [("-r", "red"), ("-r", "red"), ("-x", "green"), (None, "green")]


def test_lookup_defaults_by_column(spark):
    codes = spark.createDataFrame([("-r",), ("-x",)], "code string")
    dim = spark.createDataFrame([("-r", "red", 1)], "code string, label string, rank int")
    found = lw.lookup_with_default(codes, dim, "code", {"label": "green", "rank": 0})
    assert rows(found) == [("-r", "red", 1), ("-x", "green", 0)]


def test_lookup_refuses_repeated_keys_and_clashing_columns(spark):
    codes = spark.createDataFrame([("-r", "x")], "code string, label string")
    dim = spark.createDataFrame([("-r", "red"), ("-r", "dark")], "code string, label string")
    with pytest.raises(ValueError, match="unique"):
        lw.lookup_with_default(codes.select("code"), dim, "code", "green")
    with pytest.raises(ValueError, match="both"):
        lw.lookup_with_default(codes, dim, "code", "green")
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "code string, label string")
    found = lw.lookup_with_default(codes.select("code"), nulls, "code", "green")
    assert rows(found) == [("-r", "green")]


def test_lookup_keeps_nulls_of_known_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    dim = spark.createDataFrame([("a", None, 1)], "key string, label string, n int")
    for size in (1 << 20, 0):
        found = lw.lookup_with_default(
            df, dim, "key", {"label": "dflt", "n": 7}, max_broadcast_bytes=size
        )
        assert found.schema["n"].dataType.simpleString() == "int"
        rows = sorted(map(tuple, found.collect()), key=str)
        assert rows == [("a", None, 1), ("b", "dflt", 7), (None, "dflt", 7)]
    with pytest.raises(ValueError, match="no default"):
        lw.lookup_with_default(df, dim, "key", {"label": "x"})


def test_names_with_dots(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "`my.key` string, `n.o` int")
    assert [tuple(r) for r in lw.latest_per_key(df, "my.key", "n.o").collect()] == [("a", 2)]
    assert lw.append_if_absent(df, df, "my.key", "n.o").count() == 2
    assert lw.missing_inputs(df, df.limit(0), "my.key").count() == 1
