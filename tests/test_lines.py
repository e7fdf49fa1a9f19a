import random

import pytest
from pyspark.sql import functions as F

import linewright as lw
from linewright.functions import matching_lines, neutralised


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


def column(df, name, by="id"):
    return [row[name] for row in df.orderBy(by).collect()]


def random_texts(seed, count):
    rng = random.Random(seed)
    return [
        "".join(rng.choice(["K", "a", "#", " ", "\n", "\n", "\r", "é", "😀"])
                for _ in range(rng.randrange(40)))
        for _ in range(count)
    ]


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("x K\n#K\nKK\n", 3),
        (None, 0),
        ("", 0),
        ("\n\n", 0),
        ("a\rK\nb", 1),
        ("no\nmatch", 0),
        ("k", 0),
    ],
)
def test_count_matching_lines(spark, text, count):
    df = lw.count_matching_lines(texts(spark, [text]), "id", "text", "K")
    assert df.columns == ["id", "n"]
    assert column(df, "n") == [count]


@pytest.mark.parametrize("needle", ["K", "a K", "Ka", "é", "#", "😀", "$.^[", "\\E"])
def test_count_equals_brute_force(spark, needle):
    values = random_texts(1, 300) + [f"x{needle}\n{needle}{needle}\n\n{needle}", None]
    found = column(lw.count_matching_lines(texts(spark, values), "id", "text", needle), "n")
    assert found == [
        sum(needle in line for line in (value or "").split("\n")) for value in values
    ]


def test_count_matching_rows_sums_over_the_rows_of_a_file(spark):
    lines = spark.createDataFrame(
        [("f", "K"), ("f", "no"), ("f", "aKaK"), ("g", "no"), ("g", None)],
        "file string, value string",
    )
    found = lw.count_matching_rows(lines, "file", "value", "K").collect()
    assert {(row.file, row.n) for row in found} == {("f", 2), ("g", 0)}


def test_having_marker(spark):
    df = texts(spark, ["a\nK b", "k", None, "K", ""])
    assert column(lw.having_marker(df, "text", "K"), "id") == [0, 3]


NEUTRALISED = [
    ("a K", "#a K"),
    ("#a K", "#a K"),
    ("K", "K"),
    ("K K", "#K K"),
    (" # K", "# # K"),
    ("", ""),
    (None, None),
    ("a K\n\nK\nb\nc K\n", "#a K\n\nK\nb\n#c K\n"),
    ("a\rK\nb", "#a\rK\nb"),
    ("#\nKK\n#K", "#\n#KK\n#K"),
]


@pytest.mark.parametrize(("text", "expected"), NEUTRALISED)
def test_neutralise_lines(spark, text, expected):
    df = lw.neutralise_lines(texts(spark, [text]), "text", "K")
    assert df.columns == ["id", "text"]
    assert column(df, "text") == [expected]


@pytest.mark.parametrize("mark", ["#", "--", "$1", "\\"])
def test_neutralise_equals_brute_force_and_is_idempotent(spark, mark):
    def comment_out(line):
        return mark + line if not line.startswith(mark) and "K" in line[1:] else line

    values = random_texts(2, 300)
    once = lw.neutralise_lines(texts(spark, values), "text", "K", mark)
    found = column(once, "text")
    assert found == ["\n".join(map(comment_out, v.split("\n"))) for v in values]
    assert column(lw.neutralise_lines(once, "text", "K", mark), "text") == found


def test_long_lines_are_no_trouble(spark):
    df = spark.range(1).select(
        F.concat(F.repeat(F.lit("ab "), 500_000), F.lit("K\n"), F.repeat(F.lit("K"), 500_000))
        .alias("text")
    )
    row = df.select(
        matching_lines("text", "K").alias("n"),
        F.length(neutralised("text", "K")).alias("grown"),
        F.length("text").alias("length"),
    ).first()
    assert row.n == 2
    assert row.grown == row.length + 2


@pytest.mark.parametrize("needle", ["", "a\nb"])
def test_needle_must_fit_in_a_line(spark, needle):
    df = texts(spark, ["a"])
    for call in (
        lambda: lw.count_matching_lines(df, "id", "text", needle),
        lambda: lw.having_marker(df, "text", needle),
        lambda: lw.neutralise_lines(df, "text", needle),
        lambda: lw.neutralise_lines(df, "text", "a", needle),
    ):
        with pytest.raises(ValueError):
            call()


GROUPS = [
    ("marked", 1, "has M here"),
    ("marked", 2, "and not"),
    ("marked", 3, None),
    ("bare", 4, "nothing"),
    ("bare", 5, "m"),
    ("empty", 6, None),
    (None, 7, "M"),
]
BIG_ENOUGH = [{}, {"max_broadcast_bytes": 0}, {"max_broadcast_bytes": 0, "hot_rows": 1}]
BIG_ENOUGH += [{"max_broadcast_bytes": 0, "hot_bytes": 8}]


@pytest.mark.parametrize("sizes", BIG_ENOUGH)
def test_ensure_header(spark, sizes):
    df = spark.createDataFrame(GROUPS, "file string, place int, value string")
    once = lw.ensure_header(df, "file", "value", "M", ["M first", "second"], **sizes)
    kept = [GROUPS[i] for i in (0, 1, 2, 6)]
    added = [(g, None, v) for g in ("bare", "empty") for v in ("M first", "second")]

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    assert once.columns == df.columns
    assert rows(once) == sorted(kept + added, key=str)
    twice = lw.ensure_header(once, "file", "value", "M", ["M first", "second"], **sizes)
    assert rows(twice) == rows(once)


def test_a_null_group_without_marker_is_replaced_too(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y")], "file string, value string")
    for sizes in BIG_ENOUGH:
        found = lw.ensure_header(df, "file", "value", "M", ["M"], **sizes).collect()
        assert list(map(tuple, found)) == [(None, "M")]


def test_header_columns_by_name(spark):
    df = spark.createDataFrame(GROUPS, "file string, place int, value string")
    header = [{"place": 0, "value": "M"}]
    found = lw.header_rows(df, "file", "value", "M", header).collect()
    assert {tuple(row) for row in found} == {("bare", 0, "M"), ("empty", 0, "M")}
    with pytest.raises(ValueError, match="unknown"):
        lw.header_rows(df, "file", "value", "M", [{"plaice": 0, "value": "M"}])


@pytest.mark.parametrize("header", [["no marker"], [], [{"place": 1}]])
def test_header_must_contain_the_marker(spark, header):
    df = spark.createDataFrame(GROUPS, "file string, place int, value string")
    with pytest.raises(ValueError, match="marker"):
        lw.ensure_header(df, "file", "value", "M", header)
