"""The physical plans the operators are meant to get."""

import re

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.plans.durable import fresh_dir, shared_dir
from linewright.plans.sizing import fits_broadcast
from linewright.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def no_auto_broadcast(spark):
    """Only broadcasts that an operator asks for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Tasks of these open files of any size themselves; all that follows stays in the JVM.
OPEN_FILES = {"read_texts", "reconcile_files", "reconcile_chunks", "read_member_lines"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_rows_or_leaves_the_jvm(spark, capsys, name):
    text = plan(QUERIES[name](spark, SF_DIR), capsys)
    for node in ("Cartesian", "NestedLoop", "SinglePartition"):
        assert node not in text
    for node in ("Python", "Pandas", "FlatMap", *(() if name in OPEN_FILES else ("Arrow",))):
        assert node not in text


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("count_matching_lines", 0),
        ("having_marker", 0),
        ("neutralise_lines", 0),
        ("lookup_labels", 0),
        ("count_matching_rows", 1),
        ("latest_per_key", 1),
        ("stem_counts", 1),
        ("classify_replies", 1),
        ("reconcile_digests", 1),
        ("missing_inputs", 1),
        # Bases asked for, then both windows by base.
        ("allocate_free_names", 2),
    ],
)
def test_shuffles(spark, capsys, name, shuffles):
    text = plan(QUERIES[name](spark, SF_DIR), capsys)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == shuffles


def test_marker_is_looked_for_by_the_scan(spark, capsys):
    text = plan(QUERIES["having_marker"](spark, SF_DIR), capsys)
    assert "StringContains(text,License)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize(
    ("name", "schema"),
    [
        ("stem_counts", "struct<url:string>"),
        ("classify_replies", "struct<event_id:bigint,event_type:string>"),
        ("latest_per_key", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>"),
    ],
)
def test_only_needed_columns_are_read(spark, capsys, name, schema):
    assert f"ReadSchema: {schema}" in plan(QUERIES[name](spark, SF_DIR), capsys)


def test_texts_are_not_shuffled_to_guard_headers(spark, capsys, no_auto_broadcast):
    documents = table(spark, "documents").select("doc_id", "source", "text")
    text = plan(lw.ensure_header(documents, "source", "text", "GNU", ["GNU"]), capsys)
    kept = text[: text.index("BroadcastExchange")]
    assert "Exchange" not in kept
    assert "SortMergeJoin" not in text


def test_counting_reduces_before_the_shuffle(spark, capsys):
    for name in ("count_matching_rows", "stem_counts", "classify_replies", "latest_per_key"):
        assert "partial_" in plan(QUERIES[name](spark, SF_DIR), capsys)


def append_plan(spark, capsys, **sizes):
    events = table(spark, "events").select(F.col("user_id").alias("person"), "event_id")
    orders = table(spark, "orders").select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("event_id")
    )
    return plan(lw.rows_to_append(events, orders, "person", "event_id", **sizes), capsys)


def test_few_incoming_keys_are_broadcast_to_the_base(spark, capsys, no_auto_broadcast):
    text = append_plan(spark, capsys)
    reduced = re.search(r"BroadcastHashJoin .*LeftSemi", text)
    # The plan is printed from the result down: the scan comes after what reads it.
    assert text.rindex("Exchange", 0, reduced.start()) < reduced.start()
    base_scan = text[reduced.start() :].splitlines()[1]
    assert "user_id" in base_scan and "FileScan" in base_scan


def test_many_incoming_keys_meet_distinct_base_keys_in_one_shuffle_each(
    spark, capsys, no_auto_broadcast
):
    text = append_plan(spark, capsys, max_broadcast_bytes=0)
    assert "Broadcast" not in text
    assert "SortMergeJoin" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    # Base keys are made distinct on both sides of their shuffle.
    assert len(re.findall(r"HashAggregate\(keys=\[__present", text)) == 2


def test_big_lookup_tables_are_not_broadcast(spark, capsys, no_auto_broadcast):
    documents = table(spark, "documents").select("doc_id")
    labels = table(spark, "labels").select("doc_id", "quality")
    small = lw.lookup_with_default(documents, labels, "doc_id", -1)
    assert "BroadcastHashJoin" in plan(small, capsys)
    big = lw.lookup_with_default(documents, labels, "doc_id", -1, max_broadcast_bytes=100)
    text = plan(big, capsys)
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_hot_lookup_keys_are_split(spark):
    """A third of the rows have one key; the sort-merge join divides them among tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.shuffle.partitions": "24",
    }
    kept = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr(
            "if(id % 3 = 0, 0, id) AS key", "sha2(cast(id AS string), 256) AS payload"
        )
        labels = spark.range(0, 60_000, 2, 8).selectExpr("id AS key", "'even' AS label")
        found = lw.lookup_with_default(rows, labels, "key", "odd", max_broadcast_bytes=0)
        result = found.groupBy("label").agg(F.count("*").alias("n"), F.max("payload"))
        counts = {row.label: row.n for row in result.collect()}
        text = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert counts == {"even": 40_000, "odd": 20_000}
    assert "SortMergeJoin(skew=true)" in text


def test_fits_broadcast(spark):
    df = spark.createDataFrame([("x" * 1000,), (None,)], "name string")
    assert not fits_broadcast(df, 1000)
    assert fits_broadcast(df, 2000)
    assert not fits_broadcast(df, 0)
    assert fits_broadcast(df.limit(0), 1)
    nested = df.select(F.array("name").alias("names"))
    assert not fits_broadcast(nested, 1000)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    own = f"{shared_dir(spark)}/linewright-{spark.sparkContext.applicationId}"
    assert fresh_dir(spark, "x").startswith(own + "/x-")


def test_a_cluster_must_name_the_shared_folder():
    class Conf(dict):
        def get(self, name, default=None):
            return dict.get(self, name, default)

        def set(self, name, value):
            self[name] = value

    class Context:
        def __init__(self, folder):
            self.getCheckpointDir = lambda: folder

    class Session:
        def __init__(self, folder=None, **conf):
            self.conf, self.sparkContext = Conf(conf), Context(folder)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(**{"spark.master": "yarn"}))
    named = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_dir(named) == "hdfs:///shared"
    assert shared_dir(Session("hdfs:///set", **{"spark.master": "yarn"})) == "hdfs:///set"
    local = Session(**{"spark.master": "local[2]"})
    assert "linewright-" in shared_dir(local) and shared_dir(local) == shared_dir(local)


@pytest.mark.parametrize(
    "name", [n for n in sorted(QUERIES) if n.startswith("lookup_") and n.endswith("_by_shuffle")]
)
def test_shuffled_lookups_are_not_broadcast_by_spark_itself(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in final and "BroadcastHashJoin" not in final


def test_shuffled_appends_are_not_broadcast_by_spark_itself(spark):
    found = QUERIES["append_if_absent_by_shuffle"](spark, SF_DIR)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in final and "BroadcastHashJoin" not in final
