import hashlib

import pytest

import linewright as lw


def test_read_lines_splits_at_newlines_only(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"a\rb\nc\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two").write_bytes(b"\n\r\nlast")
    found = lw.read_lines(spark, str(tmp_path))
    assert found.columns == ["file", "value"]
    assert sorted((row.file, row.value) for row in found.collect()) == [
        ("one", "a\rb"), ("one", "c"), ("sub/two", ""), ("sub/two", "\r"), ("sub/two", "last"),
    ]


def test_one_big_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big").write_text("some K line\nanother\n" * 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = lw.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        assert lw.count_matching_rows(lines, "file", "value", "K").first().n == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_digests_of_files_against_a_manifest(spark, tmp_path):
    files, lists = tmp_path / "files", tmp_path / "lists"
    files.mkdir()
    lists.mkdir()
    for name, content in (("good", b"\x00\xff"), ("bad file", b"x"), ("new", b"n"), ("empty", b"")):
        (files / name).write_bytes(content)
    good, other = (hashlib.md5(c).hexdigest() for c in (b"\x00\xff", b"other"))
    (lists / "sums.md5").write_text(
        f"{good.upper()} *good\n{other}  bad file\n{other}  gone\nnot a checksum line\n"
        f"{hashlib.md5(b'').hexdigest()}  empty\n"
    )
    status = lw.reconcile_digests(
        lw.digest_files(spark, str(files)), lw.read_manifest(spark, str(lists), strict=False), "key"
    )
    assert {tuple(row) for row in status.collect()} == {
        ("good", "ok"), ("bad file", "failed"), ("gone", "missing"), ("new", "unlisted"),
        ("empty", "ok"),
    }


def test_append_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    lw.append_rows(df, path)
    lw.append_rows(df, path)
    assert spark.read.parquet(path).count() == 4


def test_appending_absent_rows_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    lw.append_rows(spark.createDataFrame([("a", 1)], "key string, n int"), path)
    incoming = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3), (None, 4)], "key string, n int")
    for _ in range(2):
        lw.append_rows(lw.rows_to_append(spark.read.parquet(path), incoming, "key", "n"), path)
    found = spark.read.parquet(path).collect()
    assert sorted(map(tuple, found), key=str) == [("a", 1), ("b", 2), (None, 4)]


def test_replacing_groups_in_place(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame(
        [("marked", "has M"), ("marked", "more"), ("bare", "a"), ("bare", "b")],
        "file string, value string",
    )
    lw.append_rows(df, path, partition_by=["file"])
    kept = sorted(p.name for p in (tmp_path / "table" / "file=marked").glob("*.parquet"))
    for _ in range(2):
        table = spark.read.parquet(path)
        lw.replace_groups(lw.header_rows(table, "file", "value", "M", ["M"]), path, "file")
        spark.catalog.refreshByPath(path)
        found = spark.read.parquet(path).select("file", "value").collect()
        assert sorted(map(tuple, found)) == [("bare", "M"), ("marked", "has M"), ("marked", "more")]
    assert kept == sorted(p.name for p in (tmp_path / "table" / "file=marked").glob("*.parquet"))


def test_files_that_spark_would_pass_over_are_an_error(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in (".bash_profile", "_conf", "sub/.hidden"):
        (tmp_path / name).write_text("line\n")
    for path in (tmp_path / ".bash_profile", tmp_path / "_conf", tmp_path / "sub", tmp_path):
        for read in (lw.read_lines, lw.digest_files):
            with pytest.raises(ValueError, match="pass over"):
                read(spark, str(path))


def test_both_forms_of_checksum_lists(spark, tmp_path):
    digest = "0" * 32
    (tmp_path / "crlf").write_bytes(f"{digest}  a b\r\n\r\n{digest} *s1/x.txt\r\n".encode())
    (tmp_path / "tagged").write_text(f"MD5 (tag (1)) = {digest}\n")
    found = lw.read_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("a b", digest), ("s1/x.txt", digest), ("tag (1)", digest)]
    (tmp_path / "other").write_text("no entry\n")
    with pytest.raises(Exception, match="no checksum entry"):
        lw.read_manifest(spark, str(tmp_path)).collect()


def test_replacing_groups_is_refused_where_it_would_hide_rows(spark, tmp_path):
    flat, laid = str(tmp_path / "flat"), str(tmp_path / "laid")
    df = spark.createDataFrame([("01", "has M"), ("2", "bare")], "file string, value string")
    lw.append_rows(df, flat)
    with pytest.raises(ValueError, match="not laid out"):
        lw.replace_groups(df, flat, "file")
    assert spark.read.parquet(flat).count() == 2
    lw.append_rows(df, laid, partition_by=["file"])
    with pytest.raises(ValueError, match="no folder"):
        lw.replace_groups(df.selectExpr("cast(file AS int) AS file", "value"), laid, "file")
    lw.replace_groups(df.where("file = '01'").selectExpr("file", "'new' AS value"), laid, "file")
    found = spark.read.schema("value string, file string").parquet(laid).collect()
    assert sorted((row.file, row.value) for row in found) == [("01", "new"), ("2", "bare")]


def test_files_are_named_below_the_folder_read(spark, tmp_path):
    digest = {}
    for name in ("a b.txt", "s1/x+y%.txt", "s2/x+y%.txt", "s2/ö.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
        digest[name] = hashlib.md5(name.encode()).hexdigest()
    path = str(tmp_path)
    assert dict(map(tuple, lw.digest_files(spark, path).collect())) == digest
    assert {row.file for row in lw.read_lines(spark, path + "/").collect()} == set(digest)
    assert {tuple(row) for row in lw.read_lines(spark, path).collect()} == {(n, n) for n in digest}
    assert {row.file for row in lw.read_texts(spark, [f"{path}/s1", f"{path}/s2"]).collect()} == {
        "x+y%.txt", "ö.txt",
    }
    assert [row.key for row in lw.digest_files(spark, f"{path}/a b.txt").collect()] == ["a b.txt"]
    assert {row.key for row in lw.digest_files(spark, f"{path}/s*").collect()} == {
        "s1/x+y%.txt", "s2/x+y%.txt", "s2/ö.txt",
    }


def test_whole_files_keep_their_lines_in_order(spark, tmp_path):
    (tmp_path / "one").write_bytes("".join(f"{n} K\n" for n in range(999)).encode() + b"last\r")
    (tmp_path / "empty").write_bytes(b"")
    texts = lw.neutralise_lines(lw.read_texts(spark, str(tmp_path)), "text", "K")
    assert dict(map(tuple, texts.collect())) == {
        "one": "".join(f"#{n} K\n" for n in range(999)) + "last\r", "empty": "",
    }
