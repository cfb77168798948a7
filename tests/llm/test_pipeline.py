import ast
import re
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from factloom.llm.bpe import bpe
from factloom.llm.decontaminate import decontaminate
from factloom.llm.jaccard import jaccard_join
from factloom.llm.linededup import line_dedup
from factloom.llm.quality import quality

from .docs import SCHEMA, awkward, empty


def folder(spark, tmp_path, docs):
    path = str(tmp_path / "sf")
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    texts = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 70][::4]
    spark.createDataFrame([(i, " ".join(t.split()[20:40])) for i, t in enumerate(texts)], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    marks = [(r.doc_id, 1, 0) for r in docs.collect() if r.doc_id is not None and r.doc_id % 3 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_decide_as_operators(spark, tmp_path):
    docs = awkward(spark)
    path = folder(spark, tmp_path, docs)
    labels, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("labels", "benchmark"))
    key = lambda rows: sorted(str((r.doc_id, r.text)) for r in rows)
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, path)
        before = now.collect()
        if name == "quality rules":
            kept = quality(now, labels, keep_rows=True).where("kept").collect()
            assert key(out.collect()) == key(kept)
        elif name == "line dedup":
            want = [r for r in line_dedup(now).collect() if not r.n_removed or re.search(r"[^ \t\n\x0b\f\r]", r.text or "")]
            assert key(out.collect()) == key(want)
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        elif name == "n-gram Jaccard join":
            groups = {r.doc_id: r.component_id for r in jaccard_join(now, 5, 80, 100).collect()}
            assert key(out.collect()) == key(r for r in before if r.doc_id is None or groups[r.doc_id] == r.doc_id)
        elif name == "benchmark decontamination":
            hit = {(r.doc_id, r.text) for r in decontaminate(now, bench, keep_rows=True).where("contaminated").collect()}
            assert hit and key(out.collect()) == key(r for r in before if (r.doc_id, r.text) not in hit)
        else:
            assert sorted(map(str, out.collect())) == sorted(map(str, bpe(now).collect()))
            break
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), SCHEMA)
    assert sorted(map(str, pipeline.run(spark, path).collect())) == sorted(map(str, out.collect()))


def test_empty(spark, tmp_path):
    path = folder(spark, tmp_path, empty(spark))
    assert pipeline.run(spark, path).count() == 0


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and pipeline.ORACLE_SQL is None


def imported(path):
    """Names of the modules that a file imports."""
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (f"{node.module or ''}.{a.name}" for a in node.names)


@pytest.mark.parametrize("path", sorted(Path(pipeline.__file__).parent.glob("factloom/**/*.py")))
def test_nothing_else_imports_llm(path):
    if path.parent.name != "llm":
        assert not any("llm" in name.split(".") for name in imported(path))
