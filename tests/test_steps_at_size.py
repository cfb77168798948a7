"""Steps that must not move or read more than they need."""

from pyspark.sql import functions as F

from factloom.operators import lifecycle, model


def test_reminders_of_late_days_are_not_shuffled(spark):
    """Of a thousand days only the first ones are told apart; repeated rows and zones count once."""
    c = spark.range(2000).selectExpr("id % 1000 obligation_id", "'t' title", "'b' body", "date_add(date'2020-01-01', cast(id % 1000 as int)) due_date", "cast(null as string) frequency", "1 every", "cast(null as date) recurrence_end", "array(0) offsets", "true is_open", "if(id < 1000, 'Asia/Tokyo', 'America/Phoenix') zone")
    out = lifecycle.plan_reminders(c, F.lit("2020-01-01 00:00:00").cast("timestamp"), limit=5)
    assert "BroadcastNestedLoopJoin" in out._jdf.queryExecution().toString()
    assert [r["obligation_id"] for r in out.collect()] in ([0, 1, 2, 3, 4], [1, 2, 3, 4, 5])


def test_typing_reads_equal_values_once(spark, monkeypatch):
    rows = [(i, 0, *("notice_period" if n == "kind" else "30 days" if n == "raw" else None for n in model.RAW_NAMES)) for i in range(50)]
    raw = spark.createDataFrame(rows, "doc_id long, no int, " + model.RAW)
    assert {(r["term_value"], r["term_unit"]) for r in model.typed(raw).collect()} == {(30, "days")}
    assert set(model.READ) - {"month_first"} <= set(model.RAW_NAMES)


def test_values_are_sought_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"Rs. {i} due 5 May 2020") for i in range(1, 200)], "doc_id long, full_text string").coalesce(1)
    assert model.mentions(docs).select("doc_id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 1
