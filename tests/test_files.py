"""Numbered lines and digests of files read in many blocks."""

import hashlib
import os
import random

import pytest

from formline.sources import files


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


CONTENTS = {
    "ends.txt": b"a\nb\r\n\nc\n", "open.txt": b"a\nb", "mark.txt": b"\xef\xbb\xbfx\ny\n", "mark_open.txt": b"\xef\xbb\xbfx\ny", "one.txt": b"\n", "no_end.txt": b"x" * 70_000,
    "empty_lines.txt": b"\n\n\n", "cr.txt": b"a\rb\r\n",
}


def written(folder):
    rng = random.Random(1)
    contents = CONTENTS | {"bytes.bin": rng.randbytes(300_000), "long.txt": b"".join(b"line %d %s\n" % (i, b"z" * rng.randrange(60)) for i in range(20_000))}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return contents


def test_digests_equal_those_of_the_whole_file(spark, tmp_path, small_blocks):
    contents = written(tmp_path)
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {os.path.basename(r["file"]): (r["length"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


def test_lines_are_numbered_over_blocks(spark, tmp_path, small_blocks):
    contents = written(tmp_path)
    df = files.read_lines(spark, str(tmp_path / "long.txt"))
    want = [line.decode() for line in contents["long.txt"].split(b"\n")[:-1]]
    assert [(r["pos"], r["line"]) for r in df.orderBy("pos").collect()] == list(enumerate(want))
    assert files._raw(spark, str(tmp_path / "long.txt")).select("block").distinct().count() > 10
    got = {}
    for r in files.read_lines(spark, str(tmp_path / "*.txt")).collect():
        got.setdefault(os.path.basename(r["file"]), {})[r["pos"]] = r["line"]
    assert got["ends.txt"] == {0: "a", 1: "b", 2: "", 3: "c"} and got["mark.txt"] == {0: "x", 1: "y"} and got["cr.txt"] == {0: "a\rb"}
    assert len(got["long.txt"]) == len(want)
