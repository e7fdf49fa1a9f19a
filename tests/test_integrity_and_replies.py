import hashlib
import random

import pytest

import linewright as lw
from linewright.functions import reply_outcome

SIZES = [{}, {"max_broadcast_bytes": 0}]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def statuses(df):
    found = df.collect()
    assert len({row.key for row in found}) == len(found)
    return {row.key: row.status for row in found}


def test_reconcile_digests(spark):
    data = spark.createDataFrame(
        [("same", "é"), ("altered", "b"), ("extra", "c"), ("upper", "d"), ("null", None), ("unstated", "e")],
        "key string, body string",
    )
    manifest = spark.createDataFrame(
        [("same", md5("é")), ("altered", md5("B")), ("gone", md5("x")), ("upper", md5("d").upper()),
         ("null", None), ("unstated", None)],
        "key string, md5 string",
    )
    assert statuses(lw.reconcile_digests(data, manifest, "key", content="body")) == {
        "same": "ok", "altered": "failed", "gone": "missing", "extra": "unlisted",
        "upper": "ok", "null": "failed", "unstated": "failed",
    }


def test_repeated_keys_give_one_status(spark):
    data = spark.createDataFrame(
        [("a", "1")] * 50 + [("b", "1"), ("b", "2"), ("c", "1"), (None, "1")], "key string, body string"
    )
    manifest = spark.createDataFrame(
        [("a", md5("1")), ("a", md5("1")), ("b", md5("1")), ("c", md5("1")), ("c", md5("2")), (None, md5("1"))],
        "key string, md5 string",
    )
    found = statuses(lw.reconcile_digests(data, manifest, "key", content="body"))
    assert found == {"a": "ok", "b": "failed", "c": "failed", None: "ok"}


@pytest.mark.parametrize("sizes", SIZES)
def test_missing_inputs(spark, sizes):
    expected = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "key string")
    landed = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "key string")
    found = lw.missing_inputs(expected, landed, "key", **sizes)
    assert sorted((row.key for row in found.collect()), key=str) == [None, "b", "c"]


@pytest.mark.parametrize("sizes", SIZES)
def test_missing_inputs_equals_brute_force_with_two_part_keys(spark, sizes):
    rng = random.Random(4)
    expected, landed = (
        {(rng.randrange(9), rng.randrange(9)) for _ in range(40)} for _ in range(2)
    )
    schema = "folder int, file int"
    found = lw.missing_inputs(
        spark.createDataFrame(sorted(expected), schema),
        spark.createDataFrame(sorted(landed), schema),
        ["folder", "file"],
        **sizes,
    )
    assert {tuple(row) for row in found.collect()} == expected - landed


def test_assert_complete(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "key string")
    landed = spark.createDataFrame([("b",), ("a",), ("c",)], "key string")
    assert lw.missing_inputs(expected, landed, "key").isEmpty()
    lw.assert_complete(expected, landed, "key")
    with pytest.raises(lw.IncompleteInputs, match="'b'"):
        lw.assert_complete(expected, landed.where("key <> 'b'"), "key")


YES = ["y", "Y", "yes", "YES", " yEs ", "\ty"]
NO = ["yes please", "n", "no", "", None, "y\n", " y", "ye", "yy"]


def test_classify_replies(spark):
    replies = [(reply, optional) for reply in YES + NO for optional in (True, False)]
    df = spark.createDataFrame(replies, "reply string, optional boolean")
    found = {row.outcome: row.n for row in lw.classify_replies(df, "reply", "optional").collect()}
    assert found == {"proceed": 2 * len(YES), "skip": len(NO), "abort": len(NO)}


@pytest.mark.parametrize(("optional", "otherwise"), [(True, "skip"), (False, "abort")])
def test_outcome_of_each_reply(spark, optional, otherwise):
    df = spark.createDataFrame([(reply,) for reply in YES + NO], "reply string")
    found = df.select("reply", reply_outcome("reply", optional).alias("outcome")).collect()
    assert {row.reply: row.outcome for row in found} == {
        **dict.fromkeys(YES, "proceed"),
        **dict.fromkeys(NO, otherwise),
    }


def test_replies_may_all_be_optional(spark):
    df = spark.createDataFrame([("n",), ("y",), (None,)], "reply string")
    found = lw.classify_replies(df, "reply", True).collect()
    assert {tuple(row) for row in found} == {("proceed", 1), ("skip", 2)}


def test_unknown_whether_optional_means_abort(spark):
    df = spark.createDataFrame([("n", None)], "reply string, optional boolean")
    assert lw.classify_replies(df, "reply", "optional").first().outcome == "abort"
