"""Search by postings against the search that reads every row."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import postings as I
from factloom.operators import search as S

SCHEMA = (
    "doc_id long, title string, filename string, tags array<string>, kind string, parties array<string>, fields array<struct<label:string,value:string,minor:bigint,day:date>>, "
    "obligations array<struct<title:string,status:string,minor:bigint,day:date>>, body_key string, text_amounts array<bigint>"
)
WORDS = ["invoice", "invoices", "rent", "₹500", "rs₹5", "Élan", "50", "500", "sept", "september", "paid", "x-ray", "naïve", "12", "a", "Σ"]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    day = lambda: rng.choice([None, date(2024, 9, 1 + rng.randrange(28)), date(2023, 9, 5), date(2024, 3, 5)])
    worth = lambda: rng.choice([None, 50_000, 1_200, 500])
    rows = []
    for i in range(300):
        fields = [(say(3), say(3), worth(), day()) for _ in range(rng.randrange(4))]
        duties = [(say(3), rng.choice(["pending", "paid"]), worth(), day()) for _ in range(rng.randrange(3))]
        rows.append((i, say(4), rng.choice([None, say(3)]), rng.choice([None, [], ["rent", "a"]]), say(2), rng.choice([None, [], [say(3), say(2)]]), fields, duties, None, [v for v in (worth(), worth()) if v]))
    rows.append((999, None, None, None, None, None, None, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("body_key", F.when(F.col("doc_id") % 3 > 0, S.C.search_key(F.concat_ws(" ", "title", F.lit("rent body invoice")))))
    return S.indexed(df).cache()


QUERIES = ["invoice", "inv", "rent inv", "₹500", "500", "Rs 12", "5", "sept", "Sept 2024", "5 March 2024", "rent invoice", "invoice rent", "paid a", "élan", "na", "x ray", "x-ray", "rs₹5", "", "  ", "nothing here", "12 sept", "₹12.00 rent", "body", "a a"]


def test_finds_what_a_scan_finds(spark, index, tmp_path):
    made = I.postings(index)
    made.write(str(tmp_path / "i"), 3)
    stored = I.Postings.read(spark, str(tmp_path / "i"))
    full = index.withColumns({c: F.coalesce(c, F.array().cast(index.schema[c].dataType)) for c in ("fields", "obligations", "text_amounts", "k_fields", "k_obligations")})
    for raw in QUERIES:
        want = [tuple(r) for r in S.search(full, raw).collect()]
        assert [tuple(r) for r in I.search(stored, raw).collect()] == want, raw
        if raw == "rent invoice":
            assert len(want) > 20 and [tuple(r) for r in I.search(made, raw, 5).collect()] == want[:5]


def test_reads_the_ranges_of_its_words_only(spark, index, tmp_path):
    I.postings(index).write(str(tmp_path / "i"), 4)
    stored = I.Postings.read(spark, str(tmp_path / "i"))
    plan = I.word_scores(stored.words, ("rent",))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(token), StringStartsWith(token,rent)" in plan
    plan = I.word_scores(stored.words, ("rent", "in"))._jdf.queryExecution().toString()
    assert "EqualTo(token,rent)" in plan and "StringStartsWith(token,in)" in plan


def test_empty(spark, index):
    none = I.postings(index.where("false"))
    assert I.search(none, "invoice rent").count() == I.search(none, "₹500").count() == 0
