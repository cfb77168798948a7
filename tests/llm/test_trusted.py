from collections import Counter

from factloom.llm.quality import trusted

from .docs import awkward


def test_all_trusted_texts_count_and_ids_stay_off_the_driver(spark):
    docs = awkward(spark)
    ids = {r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id % 2 == 0}
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(i, 1) for i in ids] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    found = trusted(docs, labels)
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id in ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Limit" not in plan
