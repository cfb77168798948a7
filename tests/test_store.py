"""Tables by key, files and reports."""

import pytest

from factloom.sources import store
from factloom.sources.store import Store


def test_tables_are_replaced_by_key(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for name in store.TABLES:
        assert s.read(name).count() == 0
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}", v) for i, v in ids], "doc_id long, title string, status string")
    s.replace("documents", rows((1, "queued"), (2, "queued"), (2, "queued")))
    s.replace("documents", rows((2, "failed"), (3, "queued")))
    assert sorted((r.doc_id, r.status) for r in s.read("documents").collect()) == [(1, "queued"), (2, "failed"), (3, "queued")]
    s.replace("facts", spark.createDataFrame([(1, 0, "title"), (2, 0, "title")], "doc_id long, no int, kind string"))
    s.delete(rows((2, "x")))
    assert [r.doc_id for r in s.read("documents").orderBy("doc_id").collect()] == [1, 3]
    assert [r.doc_id for r in s.read("facts").collect()] == [1] and s.read("pages").count() == 0
    s.replace("documents", rows())
    assert s.read("documents").count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, title string")
    base = one.snapshot()
    two.replace("documents", rows(1))
    with pytest.raises(store.Conflict):
        one.commit(base, {"documents": rows(2)})
    assert base.read("documents").count() == 0 and len(list((tmp_path / "s" / "documents").iterdir())) == 1
    raced = []

    def late(now):  # the first try is overtaken
        if not raced:
            raced.append(two.replace_all({"documents": rows(3), "pages": spark.createDataFrame([(3, 0)], "doc_id long, page int")}))
        return {"documents": now.read("documents").select("doc_id", "title").union(rows(4))}

    assert one.change(late) == 3 and sorted(r.doc_id for r in one.read("documents").collect()) == [1, 3, 4]
    with pytest.raises(store.Conflict):
        one.change(lambda now: (two.write("documents", rows(9)), {"documents": rows(8)})[1], tries=2)
    assert not [f for f in (tmp_path / "s" / "_log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_a_delete_that_dies_changes_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.replace_all({"documents": spark.createDataFrame([(1,), (2,)], "doc_id long"), "facts": spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, no int"), "pages": spark.createDataFrame([(1, 0)], "doc_id long, page int")})
    pinned, gone = s.snapshot(), spark.createDataFrame([(1,)], "doc_id long")
    broken = spark.createDataFrame([(1,)], "doc_id long").selectExpr("raise_error('killed') x")
    with pytest.raises(Exception, match="killed"):
        s.change(lambda now: {"documents": now.read("documents").join(gone, "doc_id", "left_anti"), "facts": broken})
    assert s.versions() == [1] and s.read("documents").count() == 2 and s.read("facts").count() == 2
    assert s.delete(gone) == 2 and [s.read(t).count() for t in ("documents", "pages", "facts", "obligations")] == [1, 0, 1, 0]
    assert pinned.read("documents").count() == 2 and s.snapshot(1).read("pages").count() == 1
    assert s.vacuum(keep=2) == [] and len(s.vacuum(keep=1)) == 3 and s.versions() == [2]
    assert [s.read(t).count() for t in ("documents", "pages", "facts", "obligations", "profiles")] == [1, 0, 1, 0, 0]
    (tmp_path / "s" / "facts" / "left-behind").mkdir()
    assert s.vacuum(keep=1) == [] and s.vacuum(keep=1, hours=0.0) == ["facts/left-behind"]


def test_derived_tables_are_kept_up(spark):
    from pyspark.sql import functions as F

    schema = "doc_id long, full_text string, n int"
    before = spark.createDataFrame([(i, f"text {i}", None) for i in range(50)] + [(7, "again", 1), (None, "x", 1)], schema)
    after = spark.createDataFrame([(i, f"text {i}" if i != 3 else "new", None) for i in range(1, 51)] + [(7, "again", 2), (None, "x", 1)], schema)
    assert {(r.doc_id, r.change) for r in store.changed_ids(before, after).collect()} == {(0, "removed"), (3, "changed"), (7, "changed"), (50, "added")}
    made = []

    def derive(docs):
        made.extend(r.doc_id for r in docs.collect())
        return docs.select("doc_id", F.length("full_text").alias("size"), F.upper("full_text").alias("key"))

    old = before.select("doc_id", F.length("full_text").alias("size"), F.upper("full_text").alias("key"))
    got = store.kept_up(before, after, old, derive)
    assert sorted(map(str, got.collect())) == sorted(map(str, derive(after).collect()))
    assert sorted(made[:4]) == [3, 7, 7, 50]


def test_files_are_dropped_and_deleted(spark, tmp_path):
    uri = f"file://{tmp_path}/inbox"
    files = spark.createDataFrame([(17, "a/b/x.txt", b"one"), (18, "y.txt", None)], "arrived_ms long, name string, content binary")
    assert sorted(r.name for r in store.dropped(files, uri).collect()) == ["17_x.txt", "18_y.txt"]
    store.dropped(files.limit(1), uri).collect()  # again: replaced, not doubled
    assert sorted(p.name for p in (tmp_path / "inbox").iterdir()) == ["17_x.txt", "18_y.txt"]
    assert (tmp_path / "inbox" / "17_x.txt").read_bytes() == b"one"
    names = spark.createDataFrame([("17_x.txt",), ("none",)], "name string")
    assert sorted(map(tuple, store.delete_files(names, uri).collect())) == [("17_x.txt", True), ("none", False)]


def test_report(spark):
    scores = spark.createDataFrame([(1, "Parties", 1.0, 2), (2, "Parties", 2.0, 2), (2, "Dates", 0.0, 0)], "doc_id long, field string, right double, total int")
    skipped = spark.createDataFrame([("bad", "not readable as JSON")], "name string, skipped_because string")
    got = {(r.part, r.name, r.field): (r.score, r.line) for r in store.report(scores, "rules", skipped).collect()}
    assert got["overall", "rules", "Parties"][0] == 0.75 and got["overall", "rules", "Parties"][1].endswith("   75%")
    assert got["document", "2", "Dates"][1].endswith("n/a") and ("skipped", "bad", "not readable as JSON") in got
