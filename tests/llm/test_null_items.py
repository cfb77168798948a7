import duckdb

from factloom.llm.decontaminate import OP6_SQL, op6_decontaminate

from .docs import awkward


def test_items_without_id_hit_as_in_sql(spark, tmp_path):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    source = [r.text for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 40]
    items = [(None, " ".join(source[0].split()[3:16])), (None, " ".join(source[1].split()[:12])), (7, " ".join(source[0].split()[20:34])), (8, " ".join(source[2].split()[:11])), (None, None)]
    path = str(tmp_path)
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, op6_decontaminate(spark, path).collect()))
    assert got == sorted(con.sql(OP6_SQL).fetchall())
    assert any(r[3] == 2 for r in got) and sum(r[5] for r in got) >= 3
