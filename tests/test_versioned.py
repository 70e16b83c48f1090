"""Versioned table: whole versions for readers, only touched seasons written."""

from __future__ import annotations

import pytest
from duelframe.sources.artifacts import VersionedTable


def frame(spark, rows):
    return spark.createDataFrame(rows, "season string, k int, v string")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.versions() == [] and t.write(frame(spark, [])) is None and t.versions() == []
    first = [("s1", 1, "a"), ("s2", 2, "a"), (None, 3, "a"), ("s1", 4, "a")]
    assert t.write(frame(spark, first)) == 1
    reader = t.read()  # opened before the next write
    assert t.write(frame(spark, [("s2", 9, "b"), ("s3", 5, "b")])) == 2
    now = [("s1", 1, "a"), ("s1", 4, "a"), ("s2", 9, "b"), ("s3", 5, "b"), (None, 3, "a")]
    assert content(t.read()) == sorted(now, key=repr) and content(reader) == sorted(first, key=repr) == content(t.read(1))
    one, two = t.manifest(1)["parts"], t.manifest(2)["parts"]
    assert one["_part=s1"] == two["_part=s1"] and one["_part=s2"] != two["_part=s2"]
    assert content(t.read(parts=["s3"])) == [("s3", 5, "b")]
    assert t.write(frame(spark, [])) is None and t.versions() == [1, 2]
    assert t.expire(1) == 1 and t.versions() == [2] and content(t.read()) == sorted(now, key=repr)


def test_a_reader_during_a_write_sees_the_old_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(frame(spark, [("s1", 1, "a")]))
    seen = []
    publish = VersionedTable._publish
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, n, text: (seen.append(content(self.read())), publish(self, n, text)))
    t.write(frame(spark, [("s1", 2, "b"), ("s2", 3, "b")]))  # data files are there, the manifest isn't
    assert seen == [[("s1", 1, "a")]] and content(t.read()) == [("s1", 2, "b"), ("s2", 3, "b")]


def test_two_writers_of_one_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(frame(spark, [("s1", 1, "a")]))
    with pytest.raises(RuntimeError):
        t._publish(1, "{}")
    assert content(t.read()) == [("s1", 1, "a")]
