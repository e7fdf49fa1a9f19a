import gzip
import io
import random

import pytest

import linewright as lw
from linewright.sources import members


def _file(pieces):
    return b"".join(gzip.compress(piece) for piece in pieces)


def _cut(draw, data, most):
    pieces, at = [], 0
    while at < len(data):
        size = draw.randint(0, most)
        pieces.append(data[at : at + size])
        at += size
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_every_line_is_read_by_one_range(seed):
    """Any cutting of the members into ranges gives the lines of the file, each once."""
    draw = random.Random(seed)
    lines = ["x" * draw.choice([0, 0, 1, 3, 40]) for _ in range(60)]
    data = "\n".join(lines).encode() + draw.choice([b"", b"\n"])
    whole = data.split(b"\n")[: -1 if data.endswith(b"\n") else None]
    source = io.BytesIO(_file(_cut(draw, data, draw.choice([1, 5, 60]))) + b"\0" * draw.choice([0, 700]))
    index = {}
    for offset, raw in members.members(source, 0):
        index[offset] = index.get(offset, 0) + len(raw)
    offsets = [offset for offset, raw in index.items() if raw]
    for share in (1, 2, 7, 1000):
        found = []
        for at in range(0, len(offsets), share):
            end = offsets[at + share] if at + share < len(offsets) else 1 << 60
            found += members._lines(source, offsets[at - 1] if at else None, offsets[at], end)
        assert found == [line for line in whole] or (data == b"" and found == [])


def test_members_come_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(members, "READ_BYTES", 100)
    data = [b"a" * 5000, b"", b"b" * 7]
    source = io.BytesIO(_file(data))
    found = list(members.members(source, 0))
    assert all(len(raw) <= 100 for _, raw in found)
    joined = {}
    for offset, raw in found:
        joined[offset] = joined.get(offset, b"") + raw
    assert list(joined.values()) == data


@pytest.mark.parametrize("broken", [_file([b"abc" * 999])[:-9], _file([b"x"]) + b"tail"])
def test_broken_files_are_errors(broken):
    with pytest.raises(Exception, match="breaks off|header"):
        list(members.members(io.BytesIO(broken), 0))


@pytest.mark.parametrize("range_bytes", [1, 400, 1 << 30])
def test_lines_of_members_are_those_of_the_plain_file(spark, tmp_path, range_bytes):
    draw = random.Random(9)
    (tmp_path / "plain" / "sub").mkdir(parents=True)
    (tmp_path / "packed" / "sub").mkdir(parents=True)
    for name in ("a", "sub/b", "empty", "one"):
        size = {"empty": 0, "one": 1}.get(name, 400)
        text = "".join("ö\r" * draw.randint(0, 9) + "\n" for _ in range(size)) + ("" if name == "empty" else "end")
        (tmp_path / "plain" / f"{name}.gz").write_bytes(text.encode())
        (tmp_path / "packed" / f"{name}.gz").write_bytes(_file(_cut(draw, text.encode(), 90)))
    index = lw.index_members(spark, str(tmp_path / "packed"))
    assert index.columns == ["file", "uri", "offset", "size", "raw"]
    found = lw.read_member_lines(index, range_bytes)
    wanted = [
        (p.relative_to(tmp_path / "plain").as_posix(), line)
        for p in (tmp_path / "plain").rglob("*.gz")
        for line in p.read_bytes().decode().split("\n")[: None if p.read_bytes() else 0]
    ]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    spark_lines = lw.read_lines(spark, str(tmp_path / "packed"))
    assert sorted(map(tuple, spark_lines.collect())) == sorted(wanted)


def test_one_big_file_is_read_by_many_tasks(spark, tmp_path):
    lines = b"".join(b"%d %x\n" % (n, n * 7919) for n in range(200_000))
    (tmp_path / "big.gz").write_bytes(_file([lines[at : at + 50_000] for at in range(0, len(lines), 50_000)]))
    index = lw.index_members(spark, str(tmp_path))
    found = lw.read_member_lines(index, 100_000)
    assert found.rdd.getNumPartitions() >= 8
    assert found.count() == 200_000
    assert found.distinct().count() == 200_000
    assert {row.value for row in found.limit(5).collect()} <= set(lines.decode().split("\n"))
    kept = str(tmp_path / "index")
    index.write.parquet(kept)  # a later run reads the file by what an earlier one found out
    assert lw.read_member_lines(spark.read.parquet(kept), 100_000).count() == 200_000


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges far smaller than a task's share do not each take a task."""
    lines = [b"%d %x\n" % (n, n * 7919) for n in range(3000)]
    (tmp_path / "small.gz").write_bytes(_file(lines))
    found = lw.read_member_lines(lw.index_members(spark, str(tmp_path)), 1)
    assert 8 <= found.rdd.getNumPartitions() <= 40  # of 3,000 ranges
    wanted = sorted(("small.gz", line.decode().rstrip("\n")) for line in lines)
    assert sorted(map(tuple, found.collect())) == wanted


@pytest.mark.parametrize(("size", "tasks"), [(members.RANGE_BYTES, 50), (1 << 20, 8)])
def test_tasks_go_by_the_bytes_of_ranges(spark, size, tasks):
    rows = [("a", "file:///a", n * size, size, size) for n in range(50)]
    index = spark.createDataFrame(rows, "file string, uri string, offset long, size long, raw long")
    assert lw.read_member_lines(index, size).rdd.getNumPartitions() == tasks
