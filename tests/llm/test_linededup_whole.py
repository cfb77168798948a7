import random

import duckdb
import pytest

import corpus_pipeline as pipeline
from factloom.llm import linededup
from factloom.llm.linededup import ANY_SQL, OP10_SQL, line_chunks_any, line_dedup, op10_line_chunks

from .docs import SCHEMA, awkward, empty
from .test_linededup import brute, corpus


def chunked(text):
    """Chunks of two lines or more, by hand."""
    import hashlib

    lines = (text or "").split("\n")
    marks = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines]
    hit = [False] + [(a * 31 + b) % linededup.DIVISOR == 0 for a, b in zip(marks, marks[1:], strict=False)]
    out, begin, n = [], 0, len(lines)
    for i in range(1, n + 1):
        if i == n or (i != n - 1 and hit[i - 1] and not (i > 1 and hit[i - 2])):
            out.append(lines[begin:i])
            begin = i
    assert n == 1 or min(map(len, out)) >= 2
    return out


def test_matches_brute_force(spark, monkeypatch):
    docs = corpus(spark)
    rows = docs.select("doc_id", "text").collect()
    monkeypatch.setattr("tests.llm.test_linededup.chunked", chunked)
    got = line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    assert line_dedup(empty(spark)).count() == 0


def test_exact_multi_line_copies_leave_nothing(spark):
    rng = random.Random(2)
    texts = ["\n".join(f"line {i} {rng.randrange(9)}" for _ in range(rng.randrange(2, 40))) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert all(left[i] == "" for i in range(60, 120))
    assert any(r.text for r in line_dedup(docs, whole=False).where("doc_id >= 60").collect())  # what the other rule leaves


def test_one_document_per_copy_group_survives(spark, tmp_path):
    now = awkward(spark)
    group = {}
    for r in sorted((r for r in now.collect() if r.text and "\n" in r.text and r.doc_id is not None), key=lambda r: r.doc_id):
        group.setdefault(r.text, set()).add(r.doc_id)
    for name, stage in pipeline.STAGES:
        if name in ("line dedup", "n-gram Jaccard join"):
            now = spark.createDataFrame(stage(spark, now, "").collect(), SCHEMA)
    left = {r.doc_id for r in now.collect()}
    copied = [ids for ids in group.values() if len(ids) > 1]
    assert len(copied) > 10 and all(len(ids & left) <= 1 for ids in copied)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    for query, sql in ((op10_line_chunks, OP10_SQL), (line_chunks_any, ANY_SQL)):
        got = query(spark, f"/root/testdata/{sf}").collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(sql).fetchall())
