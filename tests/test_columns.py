from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, C.normalized(lit("  “Café”— ＡＢ​ c "))) == '"cafe"- ab c'
    assert one(spark, C.search_key(lit("  Été, ₹5! "))) == "ete ₹5 "
    assert one(spark, C.tokens(lit("a-b  C.d"))) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("a,b,want", [
    ("ABC Technologies Pvt Ltd", "abc technologies", 1.0), ("Rana Digital", "Rana Digital Studio", 0.9), ("Rana", "Harshit Rana", 0.65), ("Jo", "Jo Li", 0.4),
    ("Sunrise Dental Clinic", "Sunrlse Dental Clinic", 0.86), ("Alpha Beta", "Gamma Delta", 0.0), ("Ltd", "Acme", 0.0), ("Green Apple Farm", "Green Apples Mill", 0.8 * 2 / 3),
])
def test_names(spark, a, b, want):
    assert one(spark, C.name_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_calendar(spark):
    d = F.lit(date(2024, 1, 31))
    month = F.lit("monthly")
    got = one(spark, C.occurrences(d, month, F.lit(1), F.lit(None).cast("date"), F.lit(date(2024, 2, 1)), 3))
    assert got == [date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 30)]
    assert one(spark, C.next_occurrence(F.lit(date(2024, 3, 31)), d, month, F.lit(1), F.lit(date(2024, 4, 1)))) is None
    assert one(spark, C.derived_date(d, F.lit(12), F.lit("months"), F.lit(True), F.lit(True))) == date(2025, 1, 30)
    assert one(spark, C.first_on_day(F.lit(31), F.lit(date(2024, 2, 29)))) == date(2024, 2, 29)
    weeks = one(spark, C.occurrences(F.lit(date(2020, 1, 1)), F.lit("weekly"), F.lit(2), F.lit(None).cast("date"), F.lit(date(2024, 1, 1)), 2))
    assert [(x - date(2020, 1, 1)).days % 14 for x in weeks] == [0, 0] and weeks[0] >= date(2024, 1, 1) and (weeks[0] - date(2024, 1, 1)).days < 14


def test_instants_over_two_switches(spark):
    at = lambda day, hour, minute, zone: one(spark, F.date_format(C.instant_at(F.lit(day).cast("date"), hour, minute, F.lit(zone).cast("string")), "yyyy-MM-dd HH:mm"))
    ny = "America/New_York"
    assert [at("2024-03-10", 1, 30, ny), at("2024-03-10", 2, 30, ny), at("2024-03-10", 3, 30, ny)] == ["2024-03-10 06:30", "2024-03-10 07:30", "2024-03-10 07:30"]
    assert [at("2024-11-03", 0, 30, ny), at("2024-11-03", 1, 30, ny), at("2024-11-03", 2, 30, ny)] == ["2024-11-03 04:30", "2024-11-03 05:30", "2024-11-03 07:30"]
    assert [at("2024-07-01", 9, 0, z) for z in ("Asia/Kolkata", "UTC", None)] == ["2024-07-01 03:30", "2024-07-01 09:00", "2024-07-01 09:00"]


def test_money(spark):
    text = lambda minor, cur: one(spark, C.money_text(F.lit(minor).cast("long"), F.lit(cur)))
    assert text(12345678900, "INR") == "₹12,34,56,789" and text(-150, "USD") == "-$1.50" and text(99900, "INR") == "₹999" and text(123456700, "EUR") == "€1,234,567"
    assert one(spark, C.minor_units(F.lit("2.345").cast("decimal(10,3)"))) == 235


def test_search(spark):
    from factloom.operators.search import query_of

    q = query_of("Sept 1998")
    assert (q.month, q.year, q.minor) == (9, 1998, None)
    assert query_of("₹1.5 lakh").minor == 15_000_000 and query_of("80,000").minor == 8_000_000 and query_of("2024").minor is None
    assert query_of("12/05/2024").day == date(2024, 5, 12) and query_of("  ").tokens == ()


def test_rows_of_a_scan(spark):
    from factloom.operators.layout import scanned_rows

    rows = [(1, "Grand Total", 0.1, 0.5, 0.2, 0.04, 0.9), (1, "₹29,500", 0.7, 0.5, 0.1, 0.04, 0.6), (1, "Header", 0.1, 0.9, 0.3, 0.05, 0.8), (1, " ", 0.0, 0.7, 0.1, 0.1, 0.1)]
    got = scanned_rows(spark.createDataFrame(rows, "page_id long, text string, x double, y double, w double, h double, confidence double")).orderBy("row").collect()
    assert [(r.text, r.confidence) for r in got] == [("Header", 0.8), ("Grand Total  ₹29,500", 0.6)]


def test_sources_and_inbox(spark, tmp_path):
    from factloom.sources.documents import labels, paired, sniffed, text_pages
    from factloom.streaming.inbox import drain

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "17_a.txt").write_text("RENT AGREEMENT\r\nThe total fee is Rs. 500.\fpage two")
    (tmp_path / "in" / "18_b.txt").write_text("QUOTATION\nTotal Amount: Rs. 900")
    lines = text_pages(spark, str(tmp_path / "in")).collect()
    assert len(lines) == 5 and {r.page for r in lines} == {0, 1}
    assert {r.kind for r in sniffed(spark, str(tmp_path / "in")).collect()} == {"text"}
    (tmp_path / "17_a.expected.json").write_text('{"document_type": "contract", "total_amount": 5}')
    (tmp_path / "bad.expected.json").write_text("{nope")
    found = labels(spark, str(tmp_path / "*.expected.json"))
    assert {(r.name, r.skipped_because is None) for r in found.collect()} == {("17_a", True), ("bad", False)}
    assert paired(spark.createDataFrame([("x/17_a.pdf",), ("x/17_a.txt",)], "path string"), found).first().path == "x/17_a.txt"
    for _ in range(2):  # a second drain finds nothing new
        drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    facts = spark.read.parquet(str(tmp_path / "out"))
    assert facts.where("kind = 'total_amount'").count() == 2
    (tmp_path / "in" / "19_bad.txt").write_bytes(b"  \n")
    drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "anew"), delete=True)  # a stream begun anew reads all again, beside the first one's rows
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'total_amount'").count() == 4
    assert [(r.file, r.error) for r in spark.read.parquet(str(tmp_path / "out-errors")).collect()] == [("19_bad.txt", "no text")]
    assert list((tmp_path / "in").glob("*.txt")) == []
