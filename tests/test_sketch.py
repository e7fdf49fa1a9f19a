import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.plans import pruning, sketch


def _passing(df, keys, key, blocks):
    return sketch.passing(df, sketch.sketch(keys, key, blocks), key, blocks)


@pytest.mark.parametrize("rows", [0, 1, 500, 60_000])
def test_all_keys_pass_and_few_strangers(spark, rows):
    keys = spark.range(rows).select((F.col("id") * 3).alias("k"))
    both = spark.range(200_000).select(F.col("id").alias("k"))
    passed = {r.k for r in _passing(both, keys, "k", sketch.blocks_for(rows)).collect()}
    mine = {3 * n for n in range(rows) if 3 * n < 200_000}
    assert mine <= passed
    assert len(passed - mine) <= 0.03 * (200_000 - len(mine))


def test_keys_of_several_columns_and_nulls(spark):
    schema = "a string, `b.c` decimal(9,2), d date"
    draw = random.Random(1)
    pick = lambda *options: draw.choice([None, *options])
    rows = [
        (pick("x", "y", ""), pick(Decimal("1.50"), Decimal("2")), pick(date(2020, 1, 1), date(1, 1, 1)))
        for _ in range(40)
    ]
    keys = spark.createDataFrame(rows, schema)
    passed = _passing(keys, keys, ["a", "b.c", "d"], 1)
    assert passed.count() == 40
    few = spark.createDataFrame([(None, None, None)], schema)
    assert {tuple(r) for r in _passing(keys, few, ["a", "b.c", "d"], 1).collect()} >= {(None, None, None)} & set(rows)


def test_only_keys_of_one_type_are_sketched(spark):
    longs, ints = spark.range(1), spark.range(1).select(F.col("id").cast("int"))
    floats = spark.range(1).select(F.col("id").cast("double"))
    assert sketch.can_sketch(longs, longs, "id")
    assert not sketch.can_sketch(longs, ints, "id") and not sketch.can_sketch(floats, floats, "id")


def test_sizes_are_known_before(spark):
    assert sketch.sketch_bytes(26_000_000) <= sketch.SKETCH_BYTES < sketch.sketch_bytes(28_000_000)


@pytest.mark.parametrize("known", [0, 300, 3000])
def test_shuffled_keys_fall_by_the_share_of_strangers(spark, known):
    """Of the larger side's 100,000 keys all that the smaller has stay, and few others."""
    small = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    large = spark.range(100_000).select((F.col("id") + 3000 - known).alias("k"), F.lit(0).alias("n"))
    keys, all_ = pruning.keys_worth_comparing(large, small, "k", max_broadcast_bytes=1)
    assert not all_ and known <= keys.count() <= known + 0.03 * 100_000
    found = lw.rows_to_append(large, small, "k", "n", max_broadcast_bytes=1)
    assert sorted(r.k for r in found.collect()) == list(range(3000 - known))
    missing = lw.missing_inputs(small, large, "k", max_broadcast_bytes=1)
    assert sorted(r.k for r in missing.collect()) == list(range(3000 - known))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan or "bit_get" in plan


def test_without_room_for_a_sketch_all_keys_are_compared(spark):
    small, large = spark.range(10), spark.range(100)
    keys, _ = pruning.keys_worth_comparing(large, small, "id", 1, max_sketch_bytes=0)
    assert keys.count() == 100
    found = lw.missing_inputs(large, small, "id", max_broadcast_bytes=1, max_sketch_bytes=0)
    assert found.count() == 90


def test_null_and_repeated_keys_by_sketch(spark):
    base = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, n int")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("b", 4), (None, 6), ("c", 7)], "k string, n int")
    found = lw.rows_to_append(base, new, "k", "n", max_broadcast_bytes=1)
    assert sorted(map(tuple, found.collect())) == [("b", 4), ("c", 7)]
    again = lw.append_if_absent(base.unionByName(found), new, "k", "n", max_broadcast_bytes=1)
    assert again.count() == 5
