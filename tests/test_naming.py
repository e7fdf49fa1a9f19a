import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.operators import naming


def one_by_one(requests, taken):
    """The documented behaviour, literally."""
    used, names = set(taken), {}
    for place, base in sorted(requests):
        number = 0
        while (name := f"{base}{number or ''}") in used:
            number += 1
        used.add(name)
        names[place] = name
    return names


def allocated(spark, requests, taken, **sizes):
    df = spark.createDataFrame(requests, "id bigint, base string")
    names = spark.createDataFrame([(name,) for name in taken], "name string")
    found = lw.allocate_free_names(df, names, "base", "id", **sizes)
    assert found.columns == ["id", "base", "name"]
    return {row.id: row.name for row in found.collect()}


@pytest.mark.parametrize("sizes", [{}, {"hot_rows": 1}, {"hot_rows": 2}])
def test_sequence(spark, sizes):
    requests = [(1, "x"), (2, "x"), (3, "x")]
    assert allocated(spark, requests, ["x", "x2", "x01"], **sizes) == {
        1: "x1", 2: "x3", 3: "x4",
    }
    assert allocated(spark, requests, [], **sizes) == {1: "x", 2: "x1", 3: "x2"}


@pytest.mark.parametrize(
    "sizes",
    [
        {},
        {"max_broadcast_bytes": 0},
        {"hot_rows": 7},
        {"hot_rows": 7, "max_broadcast_bytes": 0},
        {"hot_bytes": 2000},
        {"hot_bytes": 1},
    ],
)
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_by_one(spark, seed, sizes):
    rng = random.Random(seed)
    bases = ["hot", "a", "b\n", "ü", "a1b", "only taken"]
    weights = [30, 5, 2, 3, 1, 0]
    requests = [(i, rng.choices(bases, weights)[0]) for i in range(250)]
    rng.shuffle(requests)
    taken = [
        f"{rng.choices(bases, [30, 5, 2, 3, 1, 9])[0]}{rng.choice(['', rng.randrange(300)])}"
        for _ in range(200)
    ]
    taken += ["hot7"] * 50 + ["hot007", "12", "", "hot-1", "hot" + "9" * 18, "hot" + "9" * 25, None]
    found = allocated(spark, requests, taken, **sizes)
    assert found == one_by_one(requests, [t for t in taken if t is not None])
    assert len(set(found.values())) == len(found)
    assert not set(found.values()) & set(taken)


@pytest.mark.parametrize("taken", [range(400), range(5, 300), range(0, 400, 2), []])
def test_one_base_cut_into_blocks(spark, taken):
    requests = [(i, "x") for i in range(200)]
    names = [f"x{number or ''}" for number in taken]
    assert allocated(spark, requests, names, hot_rows=16) == one_by_one(requests, names)


def test_one_base_is_ranked_by_many_tasks(spark):
    """No task of the split path sees more than a share of the one base."""
    from linewright.operators import naming

    seen = []
    original = naming.durable

    def spy(df):
        result = original(df)
        seen.append(result)
        return result

    naming.durable = spy
    try:
        df = spark.range(4000).selectExpr("id", "'x' AS base")
        none = spark.createDataFrame([], "name string")
        found = lw.allocate_free_names(df, none, "base", "id", hot_rows=500)
        assert found.selectExpr("count(DISTINCT name)").first()[0] == 4000
    finally:
        naming.durable = original
    sizes = Counter(row["__piece"] for row in seen[0].select("__piece").collect())
    assert len(sizes) >= 8
    assert max(sizes.values()) <= 1000


def test_names_nobody_asks_for_are_not_shuffled(spark, capsys):
    requests = spark.createDataFrame([(1, "x")], "id int, base string")
    names = spark.range(1000).selectExpr("concat('n', id, '_', id) AS name")

    def plan(**sizes):
        capsys.readouterr()
        lw.allocate_free_names(requests, names, "base", "id", **sizes).explain()
        return capsys.readouterr().out

    assert "LeftSemi" in plan()
    assert "Join" not in plan(max_broadcast_bytes=0)


def test_order_may_have_several_columns_and_ties(spark):
    df = spark.createDataFrame([(2, "x", 1), (1, "x", 1), (3, "x", 0)], "id int, base string, at int")
    none = spark.createDataFrame([], "name string")
    for sizes in ({}, {"hot_rows": 1}):
        found = lw.allocate_free_names(df, none, "base", "at", **sizes)
        assert {row.id: row.name for row in found.collect()} == {3: "x", 1: "x1", 2: "x2"}


@pytest.mark.parametrize("base", ["x1", "", None])
def test_bases_are_checked(spark, base):
    with pytest.raises(ValueError, match="digit"):
        allocated(spark, [(1, "fine"), (2, base)], [])


def test_columns_are_checked(spark):
    df = spark.createDataFrame([(1, "x")], "id int, base string")
    with pytest.raises(ValueError, match="one column"):
        lw.allocate_free_names(df, df, "base", "id")
    named = df.withColumnRenamed("id", "name")
    with pytest.raises(ValueError, match="already"):
        lw.allocate_free_names(named, df.select("base"), "base", "name")


def test_stem_counts(spark):
    paths = ["/a/b.tar.gz", "x", ".bashrc", "a/", "a.b/c", None, "", "y/x.txt", "p/q.\n.z"]
    df = spark.createDataFrame([(path,) for path in paths], "path string")
    found = {row.stem: row.n for row in lw.stem_counts(df, "path", "none").collect()}
    assert found == {"b.tar": 1, "x": 2, "": 3, "c": 1, "none": 1, "q.\n": 1}


def test_no_more_bases_are_listed_than_the_ceiling(spark, monkeypatch):
    monkeypatch.setattr(naming, "MOST_HOT", 3)
    requests = [(i, "abcdefg"[i % 7]) for i in range(70)] + [(100 + i, "c") for i in range(9)]
    asked = spark.createDataFrame(requests, "id bigint, base string").groupBy("base").count()
    asked = asked.toDF("__base", "__rows").withColumn("__bytes", F.lit(1).cast("bigint"))
    none = spark.createDataFrame([], "__base string, __number bigint")
    hot = naming._hot_bases(asked, none, 1, 1 << 20)
    assert [(base, rows) for base, rows, _, _ in hot] == [("c", 19), ("a", 10), ("b", 10)]
    assert allocated(spark, requests, ["a1", "c5"], hot_rows=1) == one_by_one(requests, ["a1", "c5"])


def test_a_base_of_wide_rows_goes_through_several_tasks(spark):
    df = spark.range(200).selectExpr("id", "'x' AS base", "repeat('w', 10000) AS wide")
    none = spark.createDataFrame([], "name string")
    found = lw.allocate_free_names(df, none, "base", "id", hot_bytes=500_000)
    per_task = found.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("wide"))).collect()
    assert len(per_task) > 2
    assert {row.name for row in found.collect()} == {"x", *(f"x{n}" for n in range(1, 200))}
