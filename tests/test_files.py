"""The listing source: every file once, empty ones too, folders shared out, filters that leave tasks out."""

import pytest

from partmill.sources import files, readers


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    for path, size in (("top.pdf", 3), ("empty.pdf", 0), ("a/x.pdf", 5), ("a/b/c/deep.PDF", 7), ("a/b/none.pdf", 0), ("b/long.pdf", 99), ("b/note.txt", 4), ("b/_SUCCESS", 1), (".hidden/y.pdf", 1), ("c d/é ü.pdf", 2)):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"x" * size)
    (root / "void").mkdir()
    return str(root)


WANT = [("", "empty.pdf", 0), ("", "top.pdf", 3), ("a", "deep.PDF", 7), ("a", "none.pdf", 0), ("a", "x.pdf", 5), ("b", "long.pdf", 99), ("b", "note.txt", 4), ("c d", "é ü.pdf", 2)]


def rows(df):
    return sorted((r.folder, r.name, r.length) for r in df.collect())


def test_every_file_once(spark, tree):
    for path in (tree, tree + "/", "file:" + tree, "file://" + tree):
        got = files.file_listing(spark, path)
        assert rows(got) == WANT
        assert all(r.path.startswith(f"file:{tree}/") for r in got.collect())
    shallow = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tree).select("path")
    spaced = {r.path.replace("%20", " ") for r in shallow.collect()}
    assert {p.rsplit("/", 1)[1] for p in spaced} == {n for _, n, size in WANT if size}


@pytest.mark.parametrize("folders", [1, 2, 3, 5, 256])
def test_shares_cover_the_tree(tree, folders):
    reader = files.ListingReader(tree, folders)
    found = [(r["folder"], r["name"], r["length"]) for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(found) == WANT


def test_filters_leave_tasks_out(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = files.file_listing(spark, tree)
        assert rows(got.filter("folder = 'a'")) == [w for w in WANT if w[0] == "a"]
        assert rows(got.filter("folder in ('b', 'c d') and length > 3")) == [("b", "long.pdf", 99), ("b", "note.txt", 4)]
        assert rows(got.filter("length = 0 and name like 'n%'")) == [("a", "none.pdf", 0)]
        assert rows(got.filter("folder = 'a' and folder = 'b'")) == [] and rows(got.filter("folder = 'nowhere'")) == []
        plan = got.filter("folder = 'a' and length >= 5")._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert rows(files.file_listing(spark, tree).filter("folder = 'a' and length >= 5")) == [("a", "deep.PDF", 7), ("a", "x.pdf", 5)]
    pruned = files.PruningReader(tree, 1)
    assert list(pruned.pushFilters([files.EqualTo(("folder",), "b")])) == []
    assert all("/b" in f for s in pruned.partitions() for f in s.alone + s.below)


def test_one_file_no_file_and_no_path(spark, tree, tmp_path):
    assert rows(files.file_listing(spark, f"{tree}/b/long.pdf")) == [("", "long.pdf", 99)]
    assert rows(files.file_listing(spark, f"{tree}/void")) == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.file_listing(spark, f"{tmp_path}/missing").collect()


def test_manifest_names_empty_files(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: r.status for r in readers.document_manifest(spark, tree, 50).collect()}
    assert got == {"empty.pdf": "empty", "none.pdf": "empty", "top.pdf": "accepted", "x.pdf": "accepted", "deep.PDF": "accepted", "long.pdf": "too_large", "note.txt": "bad_format", "é ü.pdf": "accepted"}
