"""The versions of an index: readers during writes, replacing, deleting, conflicts, and what vacuum leaves."""

import pytest

from leafmill.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def index(spark, tmp_path):
    found = versions.Index(spark, str(tmp_path / "index"), 4)
    found.save({"a": spark.createDataFrame([(i, f"x{i}") for i in range(20)], "doc_id long, v string"), "b": spark.createDataFrame([(3, 1), (4, 2)], "doc_id long, n int")})
    return found


def test_versions(spark, index):
    assert index.versions() == [1] and len(index.manifest().folders) <= 8
    old = index.read("a")
    assert index.save({"a": spark.createDataFrame([(3, "new"), (30, "more")], "doc_id long, v string")}) == 2
    assert rows(old) == sorted((i, f"x{i}") for i in range(20))
    assert rows(index.read("a")) == sorted([(i, f"x{i}") for i in range(20) if i != 3] + [(3, "new"), (30, "more")])
    assert rows(index.read("b")) == [(4, 2)] and rows(index.read("b", version=1)) == [(3, 1), (4, 2)]  # the document was replaced as a whole
    assert index.delete([4, 5]) == 3 and index.delete([4]) is None and index.delete([99]) is None
    assert rows(index.read("b")) == [] and rows(index.read("a", doc_ids=[4, 6])) == [(6, "x6")]
    one = index.read("a", doc_ids=[6]).inputFiles()
    assert one and len({f.rsplit("/", 2)[1] for f in one}) == 1
    assert rows(index.read("never", "doc_id long, z string")) == []


def test_parts_that_came_later(spark, index):
    """A part that older versions lack, and a column that older rows lack."""
    index.save({"c": spark.createDataFrame([(7, "s")], "doc_id long, s string"), "a": spark.createDataFrame([(7, "y", 1)], "doc_id long, v string, w int")})
    assert rows(index.read("c")) == [(7, "s")] and rows(index.read("c", "doc_id long, s string", version=1)) == []
    assert sorted((r.doc_id, r.v, r.w) for r in index.read("a", doc_ids=[7, 8]).collect()) == [(7, "y", 1), (8, "x8", None)]


def test_conflict(spark, index, monkeypatch):
    """Two writers from one version: the second begins again from what the first has published."""
    publish, first = versions.Index._publish, []

    def late(self, before, folders):
        if not first:
            first.append(0)
            first[0] = versions.Index(spark, index.folder).save({"a": spark.createDataFrame([(1, "other")], "doc_id long, v string")})
        return publish(self, before, folders)

    monkeypatch.setattr(versions.Index, "_publish", late)
    assert index.save({"a": spark.createDataFrame([(2, "mine")], "doc_id long, v string")}) == 3 and first == [2]
    assert rows(index.read("a", doc_ids=[1, 2])) == [(1, "other"), (2, "mine")]


def test_vacuum(spark, index):
    index.save({"a": spark.createDataFrame([(1, "again")], "doc_id long, v string")})
    before = rows(index.read("a"))
    assert index.vacuum() >= 1 and index.versions() == [2] and rows(index.read("a")) == before and index.vacuum() == 0
