"""The inbox and label files as data sources: batch, stream, restart, errors."""

import pytest

from factloom.sources import formats


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batch(known, tmp_path):
    box = tmp_path / "box"
    read = lambda: known.read.format("inbox").option("path", str(box)).option("tasks", "3").load()
    assert read().count() == 0
    put(box, **{f"{i}_a__txt": b"text %d\r\nmore" % i for i in range(7)}, bad__txt=b"\xff\xfe", **{"8_": b" \n", ".9_part": b"x"})
    got = rows(read())
    assert got == sorted([(f"{i}_a.txt", "a.txt", i, f"text {i}\nmore", None) for i in range(7)] + [("bad.txt", "bad.txt", None, None, "not UTF-8"), ("8_", "", 8, None, "no text")], key=str)
    assert read().rdd.getNumPartitions() == 3


def test_stream_deletes_what_it_has_committed(known, tmp_path):
    box, out, check = tmp_path / "box", tmp_path / "out", tmp_path / "check"
    put(box, **{"5_b__txt": b"five", "3_a__txt": b"three"})

    def drain():
        stream = known.readStream.format("inbox").option("path", str(box)).load()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    drain()
    put(box, **{"1_late__txt": b"one"})  # earlier by its name, later by its coming
    drain()  # restarted from its checkpoint
    put(box, **{"9_x__txt": b"\xff"})
    drain()
    got = known.read.parquet(str(out)).select("file", "full_text", "error")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("1_late.txt", "one", None), ("3_a.txt", "three", None), ("5_b.txt", "five", None), ("9_x.txt", None, "not UTF-8")]))
    assert {p.name for p in box.iterdir()} <= {"9_x.txt"}  # the last batch is committed when the next one is planned


def test_labels(known, tmp_path):
    put(tmp_path / "l", **{"a__expected__json": b'{"total_amount": 5}', "b__expected__json": b"{nope", "c__expected__json": b"[1]", "d__txt": b"x"})
    got = rows(known.read.format("labels").option("path", str(tmp_path / "l")).load().select("name", "label", "skipped_because"))
    assert got[0] == ("a", '{"total_amount": 5}', None) and [g[2] for g in got[1:]] == ["not readable as JSON", "not a JSON object"]
