import hashlib
import random

import pytest
import zstandard

from factloom.llm import warc
from factloom.llm.warc import MIN_REVISIT, export_archives, read_archive, read_archives, read_files, write_archives

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark, n=80):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i} x", "<p>" + " ".join(rng.choice(["é", "abc", "x"]) for _ in range(rng.randrange(0, 200))) + "\r\n\r\n</p>") for i in range(n)]
    rows += [(n + i, "u", rows[i % 3][2] + "z" * 100) for i in range(30)] + [(500, None, None), (501, "u", ""), (502, "u", "short"), (503, "u", "short"), (None, "u", rows[0][2] + "z" * 100)]
    rows += [(3, "http://h/3", rows[3][2]), (900, "u", "y" * 300_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    data = [(r.page_id, (r.html or "").encode()) for r in rows]
    first = {}
    for i, p in data:
        if i is not None and len(p) >= MIN_REVISIT:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in data:
        revisit = len(p) >= MIN_REVISIT and first.get(p, i) != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    df = pages(spark)
    rows = df.collect()
    back = read_archives(write_archives(df)).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back) == brute(rows)
    texts = {r.page_id: (r.html or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in back if r.record_type == "response")


def test_frames_and_faults(spark, tmp_path):
    table = write_archives(pages(spark))
    content = bytes(table.first().content)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    records = list(read_archive(content))
    assert all(r.startswith(b"WARC/1.1\r\n") for r in records)
    with pytest.raises(ValueError):
        list(read_archive(content[:-5]))
    with pytest.raises(ValueError):
        list(read_archive(content[8:]))
    whole = next(r for r in records if b"WARC-Type: response" in r and b"</p>" in r)
    warc.parsed(whole)
    for old, new in ((b"</p>", b"</q>"), (b"\r\n\r\n\r\n", b""), (b"WARC/1.1", b"JUNK/1.1"), (b"WARC-Date: 1970-01-01T00:00:00Z", b"no field")):
        with pytest.raises(ValueError):
            warc.parsed(whole.replace(old, new) if new or old in whole else whole[:-4])
    names = export_archives(table, f"file://{tmp_path}/files").collect()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/files")
    assert files.count() == len(names) == table.count()
    assert read_archives(files).count() == pages(spark).count()
    assert sorted(map(str, read_files(spark, f"{tmp_path}/files").collect())) == sorted(map(str, read_archives(table).collect()))


def test_compressed_dictionary():
    words = zstandard.train_dictionary(2000, [b"some sample text %d " % i * 20 for i in range(300)]).as_bytes()
    lead = zstandard.ZstdCompressor().compress(words)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(b"some sample text 9 payload")
    content = (0x184D2A5D).to_bytes(4, "little") + len(lead).to_bytes(4, "little") + lead + frame
    assert list(read_archive(content)) == [b"some sample text 9 payload"]


def test_empty(spark):
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_large_archives_are_read_forward_in_pieces(monkeypatch):
    import io
    import time

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            return super().read(n)

    lead = (0x184D2A5D).to_bytes(4, "little") + (0).to_bytes(4, "little")
    coder = zstandard.ZstdCompressor()
    rng = random.Random(1)
    payloads = [rng.randbytes(rng.choice([0, 30, 300, 3000])) for _ in range(20_000)] + [rng.randbytes(5_000_000), b"x" * 3_000_000]
    archive = Counted(lead + b"".join(coder.compress(p) for p in payloads))
    began = time.process_time()
    assert list(read_archive(archive)) == payloads
    assert time.process_time() - began < 5 and archive.most <= warc.PIECE


def test_a_dictionary_always_leads(spark):
    few = spark.createDataFrame([(1, "u", "<p>a</p>", "c")], SCHEMA)
    content = bytes(write_archives(few).first().content)
    assert int.from_bytes(content[4:8], "little") > 100
    assert [r.payload for r in read_archives(write_archives(few)).collect()] == [b"<p>a</p>"]
